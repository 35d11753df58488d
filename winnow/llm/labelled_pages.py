"""The small labelled table that the block classifier learns from.

Pages of common layouts, made for this purpose. ``{m12}`` stands for a block of 12 words of main text, ``{r3}`` for 3
words of something else. In ``NAMED`` pages elements say what they are, in ``BARE`` ones only words and links can.
"""

from __future__ import annotations

import random
import re

_MENU = "<ul><li><a href='/1'>{r1}</a></li><li><a href='/2'>{r1}</a></li><li><a href='/3'>{r2}</a></li></ul>"

NAMED = [
    # a page of landmarks, paragraphs of all lengths
    f"<body><header><a href='/'>{{r2}}</a><p>{{r9}}</p></header><nav>{_MENU}</nav><main><article><h1>{{m8}}</h1><p>{{m60}}</p><p>{{m2}}</p><p>{{m1}}</p><p>{{m25}}</p>"
    f"<h2>{{m3}}</h2><p>{{m90}}</p><ul><li>{{m4}}</li><li>{{m12}}</li></ul><blockquote>{{m18}}</blockquote></article></main><aside><h3>{{r2}}</h3><p>{{r30}}</p>{_MENU}</aside><footer>{{r20}} <a href='/t'>{{r1}}</a></footer></body>",
    # an article between a menu, an advert and a footer, nothing but its tags around it
    f"<body><nav>{_MENU}</nav><div class='ad'>{{r8}}</div><article><h1>{{m10}}</h1><p>{{m120}}</p><p>{{m3}}</p><p>{{m1}}</p></article><footer>{{r12}}</footer></body>",
    f"<body><nav>{_MENU}</nav><div class='ad'>{{r45}}</div><article><h1>{{m1}}</h1><p>{{m1}}</p></article><footer>{{r60}}</footer></body>",
    f"<body><nav>{_MENU}</nav><div class='advert'>{{r25}}</div><article><h1>{{m5}}</h1>{{m30}}<p>{{m2}} <a href='/x'>{{m2}}</a></p><p><a href='/y'>{{m5}}</a></p></article><footer>{{r4}}</footer></body>",
    # divisions that are named
    f"<body><div id='header'>{{r4}}<div class='search-form'>{{r2}}</div></div><div class='menu'>{_MENU}</div><div id='content'><h2>{{m6}}</h2><p>{{m45}}</p><p>{{m2}}</p><div class='share'>{{r3}} <a href='/s'>{{r1}}</a></div><p>{{m33}}</p></div>"
    f"<div class='sidebar'><p>{{r40}}</p><p>{{r6}}</p></div><div id='footer'><p>{{r26}}</p></div></body>",
    f"<body><div class='cookie-notice'><p>{{r24}}</p><button>{{r1}}</button></div><div class='post'><h1>{{m7}}</h1><div class='entry'><p>{{m30}}</p><p>{{m14}}</p><pre>{{m9}}</pre></div></div>"
    f"<div class='related'><h3>{{r2}}</h3><ul><li><a href='/r'>{{r8}}</a></li><li><a href='/q'>{{r7}}</a></li></ul></div><div class='newsletter'><form><p>{{r12}}</p><label>{{r2}}</label></form></div></body>",
    # readers' comments, long ones too, some in articles of their own
    f"<body><header>{{r3}}</header><article><h1>{{m6}}</h1><p>{{m80}}</p><p>{{m20}}</p><section class='comments'><h2>{{r2}}</h2><article class='comment'><p>{{r50}}</p></article><article><p>{{r90}}</p></article><article class='comment'><p>{{r4}}</p></article></section></article><footer>{{r9}}</footer></body>",
    f"<body><main><h1>{{m4}}</h1><p>{{m42}}</p><p>{{m6}}</p></main><div id='comments'><h3>{{r2}}</h3><div class='comment-body'>{{r70}}</div><div class='comment-body'><p>{{r15}}</p></div><article><p>{{r35}}</p></article></div><footer><p>{{r40}}</p></footer></body>",
    # things that stand inside the article
    f"<body><nav>{_MENU}</nav><article><h1>{{m5}}</h1><div class='byline'>{{r4}}</div><p>{{m50}}</p><aside><p>{{r28}}</p></aside><p>{{m3}}</p><div class='ad'><p>{{r16}}</p></div><p>{{m66}}</p><figure><figcaption>{{m8}}</figcaption></figure><form><p>{{r14}}</p></form><nav>{_MENU}</nav><p>{{m1}}</p></article></body>",
    f"<body><article><section><h2>{{m4}}</h2><p>{{m36}}</p></section><section><h2>{{m3}}</h2><p>{{m2}}</p><table><tr><td>{{m2}}</td><td>{{m1}}</td></tr></table></section><div class='promo'>{{r33}}</div><footer>{{r6}}</footer></article></body>",
    # a page of main content without an article, text with links in it, a page with notices only
    f"<body><div role='banner'>{{r6}}</div><div role='navigation'>{_MENU}</div><div role='main'><p>{{m25}} <a href='/w'>{{m8}}</a> {{m6}}</p><ul><li><a href='/v'>{{m3}}</a></li><li>{{m7}}</li></ul><p>{{m4}}</p></div><div role='contentinfo' class='footer'>{{r30}}</div></body>",
    f"<body><div class='notice'><p>{{r60}}</p></div><div class='login-form'>{{r5}}</div><footer><p>{{r11}}</p><a href='/z'>{{r1}}</a></footer></body>",
    f"<body><div class='layout has-sidebar'><main><article class='post'><p>{{m2}}</p><p>{{m44}}</p><p>{{m1}}</p></article></main><div class='sidebar'><div class='widget'>{{r21}}</div><article class='promo'><p>{{r38}}</p></article></div></div></body>",
    # short pages; menus with words between their links
    "<article><p>{m3}</p></article>", "<article><p>{m1}</p><p>{m2}</p></article>", "<article><p>{m9}</p></article><footer>{r3}</footer>", "<div class='content'><p>{m2}</p></div>",
    "<main>{m4}</main>", "<nav>{r5}</nav><article><ul><li><a href='/1'>{m2}</a></li><li><a href='/2'>{m1}</a></li></ul></article><aside>{r2}</aside>",
    "<article><h1>{m2}</h1></article><div class='comment'>{r7}</div>",
    # the article is the end of the page
    f"<body><nav>{_MENU}</nav><article><h1>{{m6}}</h1><p>{{m40}}</p><p>{{m1}}</p></article></body>",
    "<body><div class='banner'>{r20}</div><article><p>{m60}</p><p>{m4}</p><p>{m2}</p></article></body>",
    "<body><nav><a href='/'>{r2}</a></nav><article><h1>{m4}</h1><p>{m3}</p><ul><li><a href='/1'>{m4}</a></li><li><a href='/2'>{m2}</a></li></ul><p>{m3}</p></article><footer><a href='/c'>{r2}</a></footer></body>",
    "<body><aside>{r30}</aside><main><p>{m25}</p><p>{m3}</p></main></body>",
]

BARE = [
    f"<body><div>{_MENU}</div><div><h1>{{m9}}</h1><p>{{m70}}</p><p>{{m40}}</p><p>{{m5}}</p><p>{{m80}}</p><p>{{m35}} <a href='/x'>{{m2}}</a></p></div><div><a href='/a'>{{r2}}</a> <a href='/b'>{{r2}}</a></div><div>{{r5}}</div></body>",
    f"<body><div><a href='/'>{{r1}}</a><a href='/2'>{{r2}}</a><a href='/3'>{{r1}}</a></div><div><p>{{m50}}</p><p>{{m22}}</p><p>{{m64}}</p><p>{{m30}}</p></div><div><a href='/n'>{{r6}}</a></div><div><a href='/o'>{{r9}}</a></div><div>{{r4}}</div></body>",
    f"<body><table><tr><td><a href='/1'>{{r1}}</a></td><td><a href='/2'>{{r2}}</a></td></tr></table><table><tr><td>{{m110}}</td></tr><tr><td>{{m55}}</td></tr></table><table><tr><td>{{r6}}</td><td><a href='/c'>{{r2}}</a></td></tr></table></body>",
    f"<body><p>{{m48}}</p><p>{{m61}}</p><p>{{m29}}</p></body>",
    "<body><div><a href='/'>{r2}</a> {r1} <a href='/2'>{r1}</a></div><div><p>{m33}</p><p>{m52}</p><p>{m18}</p></div><div>{r3} <a href='/3'>{r4}</a></div></body>",
    "<body><div>{r1} <a href='/'>{r3}</a></div><div><p>{m75}</p><p>{m31}</p><p>{m44}</p></div><div><a href='/'>{r5}</a> {r2}</div><div>{r2}</div></body>",
    "<body><div><a href='/'>{r1}</a> <a href='/2'>{r1}</a></div><div><p>{m57}</p><p>{m3}</p><p>{m49}</p></div><div><a href='/3'>{r1}</a> <a href='/4'>{r1}</a></div></body>",
    "<body><div><a href='/'>{r2}</a></div><div><p>{m64}</p><p>{m2}</p><p>{m83}</p><p>{m60}</p></div><div><a href='/3'>{r3}</a></div><div>{r6}</div></body>",
]


def _varied(page: str, rng: random.Random, named: bool) -> str:
    """The page with other numbers of words: any where elements have names, else about as many."""
    def number(m: re.Match) -> str:
        n = round(90 ** rng.random()) if named else max(1, round(int(m[2]) * rng.uniform(0.6, 1.7)))
        return f"{{{m[1]}{n}}}"

    return re.sub(r"\{([mr])(\d+)\}", number, page)


def pages(variants: int = 8) -> list[str]:
    """Every page as it is and in ``variants`` others, the same on every call."""
    rng = random.Random(7)
    return [p for layouts, named in ((NAMED, True), (BARE, False)) for page in layouts for p in (page, *(_varied(page, rng, named) for _ in range(variants)))]
