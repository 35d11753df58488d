"""Main text of pages: layouts that the tree was not trained on, awkward markup, and the given pages against a plain reader."""

import re
from html import unescape

from pyspark.sql import types as T

from winnow.llm import html_text
from winnow.llm.queries import op11_html_extraction

FIELDS = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), *(T.StructField(c, T.StringType()) for c in ("kept", "page", "blocks", "text"))])

WORDS = "the river turned north here and then it slowly widened into a lake that no map had ever shown before"


def extracted(spark, pages):
    rows = [(i, f"http://x/{i}", p, "k", "p", "b", "t") for i, p in enumerate(pages)]
    got = html_text.main_text(spark.createDataFrame(rows, FIELDS).repartition(3))
    assert got.columns == ["page_id", "url", "text"]
    return [r["text"] for r in got.orderBy("page_id").collect()]


def test_layouts(spark):
    long, short = f"{WORDS}. {WORDS.title()}, {WORDS}.", "So it was."
    links = "".join(f"<li><a href='/{i}'>Topic {i}</a></li>" for i in range(8))
    pages = [
        f"<html><body><div id='top-nav'><ul>{links}</ul></div><div class='main-content'><h1>A lake</h1><p>{long}</p><p>{short}</p><p>{long}</p></div><div class='related-posts'><h4>More</h4><ul>{links}</ul></div><div class='site-footer'>All rights reserved by someone.</div></body></html>",
        f"<body><header><h1>The Daily</h1></header><nav>{links}</nav><main><article><h2>A lake</h2><p>{short}</p><p>{long}</p><div class='advertisement'>{long}</div><p>{short}</p></article><section id='comments'><p>{long}</p></section></main><aside>{long}</aside><footer>{long}</footer></body>",
        f"<div><a href='/'>Home</a> | <a href='/a'>About us</a></div><div><p>{long}</p><p>{long}</p><p>{short}</p><p>{long}</p></div><div><a href='/p'>Privacy</a> <a href='/t'>Terms</a></div>",
        f"<body><div class='cookie-banner'><p>{long}</p></div><article><p>{long}</p><p>Yes.</p></article><form><p>{long}</p><input></form></body>",
    ]
    body = [f"A lake\n{long}\n{short}\n{long}", f"A lake\n{short}\n{long}\n{short}", f"{long}\n{long}\n{short}\n{long}", f"{long}\nYes."]
    assert extracted(spark, pages) == body


def test_markup(spark):
    pages = [
        None, "", " \n ", "<article></article>", "<script>var a = 1;",
        "<article><p>a &amp; b &lt;i&gt; &#233;&#x41;&nbsp;c&copy d &bogus; &amp;amp;</p></article>",
        "<article><p>one<br>two <b>th</b>ree</p><p>four<p>five<ul><li>six<li>seven</ul></article>",
        "<article><p title='a > b'>x</p><script>if (a < b) '</p>'</script><style>p{}</style><!-- <p>no</p> --><p data-x=\"it's\">y</p><svg><text>no</text></svg></article>",
        "<ARTICLE><P>upper</P><P hidden>no</P><P style='display: none'>no</P></ARTICLE>",
        "<article><p>cut off here <a href=\"/x", "<article><p>cut &am", "<article><p>a < b and c > d</p></article>",
        "<article><b><p>bold</p><p>more</b> text</p></article><footer>no</footer>",
        "<article><textarea>no <p>no</textarea><p>yes wide space\tand\r\nlines</p></article>", "<article><p>x</p></article>" * 2,
        "<article>" + "<p>w</p>" * 30_000 + "</article>", "<article>" + "<div>" * 3000 + "deep", "<p " + "a='" * 2001 + "><article>t</article>",
    ]
    got = extracted(spark, pages)
    assert got[:5] == [""] * 5
    assert got[5] == "a & b <i> éA c© d &bogus; &amp;"
    assert got[6] == "one two three\nfour\nfive\nsix\nseven"
    assert got[7] == "x\ny" and got[8] == "upper"
    assert got[9:12] == ["cut off here", "cut &am", "a < b and c > d"]
    assert got[12] == "bold\nmore text" and got[13] == "yes wide space and lines" and got[14] == "x\nx"
    assert got[15] == "\n".join(["w"] * 30_000) and got[16] == "deep"


def test_empty_and_repeated(spark):
    assert html_text.main_text(spark.createDataFrame([], FIELDS)).collect() == []
    rows = [(None, None, "<article><p>x</p></article>", *"kpbt")] * 2
    assert [tuple(r) for r in html_text.main_text(spark.createDataFrame(rows, FIELDS)).collect()] == [(None, None, "x")] * 2


def test_given_pages(spark):
    """Whole articles of the given pages: what stands between <article> and its end, block by block."""
    folder = "/root/testdata/sf0.01"
    want = {}
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        blocks = (" ".join(unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inside))
        want[r["page_id"]] = "\n".join(b for b in blocks if b)
    got = op11_html_extraction(spark, folder).collect()
    assert {r["page_id"]: r["text"] for r in got} == want and len(got) == len(want)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
