"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut at block-level tags into a flat list of text blocks. A block is described by its number of words and
its link density, those of the blocks before and after it, and the marks of the elements around it (landmark tags, names
that pages give to menus, adverts, comments). A decision tree, trained on the blocks of a small labelled table,
tells main text from the rest; it is applied as a column expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm.labelled_pages import pages as labelled_pages

#: a comment, a declaration, a tag whose quoted values may hold ">", or a tag that the page's end cuts off
_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAME_PARTS = re.compile(r"[a-z]+")
#: names that say what stands beside an element, not what it is
_LAYOUT = re.compile(r"(?<![\w-])(?:has|with|no)-[\w-]+")

# fixed values of the HTML standard: what elements are
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style template textarea title xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: a new one ends an open one of the same kind
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "a": {"a"}}
#: block-level elements that end an open paragraph
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())

# fixed values: marks of elements
GOOD_TAGS = frozenset("article main".split())
BAD_TAGS = frozenset("aside button datalist dialog footer form header menu nav noscript object select svg".split())
GOOD_NAMES = frozenset("article articlebody body content entry main post postbody story text".split())
BAD_NAMES = frozenset(
    """ad ads advert advertisement adverts banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disclaimer disqus footer
    form header login masthead menu menubar metadata modal nav navbar navigation newsletter notice pager pagination popup promo promoted promotion recommended
    related replies reply search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget widgets""".split()
)
COMMENT_NAMES = frozenset("comment comments disqus replies reply".split())

#: what the tree sees of a block
FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "standing", "bad", "remarks"]
_BLOCK = "struct<text:string, words:int, links:double, words_before:int, links_before:double, words_after:int, links_after:double, heading:int, standing:int, bad:int, remarks:int>"
_BLOCK_TYPE = pa.list_(pa.struct([("text", pa.string()), *((f, pa.float64() if f.startswith("links") else pa.int32()) for f in FEATURES)]))


def _marks(tag: str, rest: str) -> tuple[int, int]:
    """What an element says of its text: 1 main, -1 not, 0 nothing; and whether it holds readers' comments."""
    good, bad = tag in GOOD_TAGS, tag in BAD_TAGS
    remark = False
    if rest and not rest.isspace():
        hidden = False
        for name, *values in _ATTRIBUTE.findall(rest):
            name, value = name.lower(), "".join(values).lower()
            if name in ("class", "id", "role", "itemprop", "aria-label", "data-role"):
                parts = set(_NAME_PARTS.findall(_LAYOUT.sub(" ", value)))
                remark |= bool(parts & COMMENT_NAMES)
                bad |= bool(parts & BAD_NAMES)
                good |= bool(parts & GOOD_NAMES)
            elif name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                hidden = True
        bare = _ATTRIBUTE.sub(" ", rest).lower().split()
        if hidden or "hidden" in bare:
            return -1, 0
    if tag in ("html", "body"):  # their names describe the layout of the page
        return 0, 0
    return (-1 if bad or remark else 1 if good else 0), int(remark)


def _count(words: list[str]) -> int:
    """Words with a letter or digit in them; bars and dots between links are none."""
    return sum(any(map(str.isalnum, w)) for w in words)


class Blocks:
    """The flat text blocks of one page."""

    def __init__(self, page: str):
        self.found: list[tuple] = []  # text, words, link words, heading, standing, bad, remarks
        self.open: list[tuple[str, int, int]] = []  # tag, mark, remark
        self.parts: list[str] = []
        self.linked = 0
        self.links = 0
        at = 0
        for m in iter(lambda: _MARKUP.search(page, at), None):
            self.text(page[at : m.start()])
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if tag is None:
                if m[0].startswith("<![CDATA["):
                    self.text(m[0][9:].removesuffix("]]>"))
                continue
            tag = tag.lower()
            if m["end"] or m["end2"]:
                self.end(tag)
                continue
            rest = m["rest"] or m["rest2"] or ""
            if tag in RAW:
                if tag not in INLINE:
                    self.flush()
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
                at = close.end()
            else:
                self.start(tag, rest)
            if at >= len(page):
                break
        self.text(page[at:])
        self.flush()

    def text(self, raw: str) -> None:
        if raw:
            piece = unescape(raw) if "&" in raw else raw
            self.parts.append(piece)
            if self.links:
                self.linked += _count(piece.split())

    def start(self, tag: str, rest: str) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            if tag not in INLINE:
                self.flush()
            return
        if tag not in INLINE:
            self.flush()
        if tag in ENDS_PARAGRAPH:
            self.leave({"p"}, inside={"button", "td", "th", "article", "section", "main", "div"})
        if tag in SIBLINGS:
            self.leave(SIBLINGS[tag], inside={"ul", "ol", "dl", "menu", "table", "select"} if tag != "a" else frozenset())
        self.open.append((tag, *_marks(tag, rest)))
        self.links += tag == "a"

    def leave(self, tags: set[str], inside) -> None:
        """End the innermost open element of ``tags``, unless one of ``inside`` stands in between."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                self.cut(i)
                return
            if self.open[i][0] in inside:
                return

    def cut(self, i: int) -> None:
        self.links -= sum(t == "a" for t, *_ in self.open[i:])
        del self.open[i:]

    def end(self, tag: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag not in INLINE:
            self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if tag in INLINE:  # blocks in it stay open
                    self.links -= tag == "a"
                    del self.open[i]
                else:
                    self.cut(i)
                return

    def flush(self) -> None:
        words = "".join(self.parts).split()
        if words:
            marks = [mark for _, mark, _ in self.open]
            standing = next((m for m in reversed(marks) if m), 0)
            heading = any(t in ("h1", "h2", "h3", "h4", "h5", "h6") for t, *_ in self.open)
            self.found.append((" ".join(words), _count(words), self.linked, int(heading), standing, marks.count(-1), sum(r for *_, r in self.open)))
        self.parts, self.linked = [], 0

    def rows(self) -> list[dict]:
        """The blocks with their neighbours' figures; beyond the page there are no words."""
        density = [min(1.0, linked / max(1, words)) for _, words, linked, *_ in self.found]
        size = [words for _, words, *_ in self.found]
        out = []
        for i, (text, words, _, heading, standing, bad, remarks) in enumerate(self.found):
            before = (size[i - 1], density[i - 1]) if i else (0, 0.0)
            after = (size[i + 1], density[i + 1]) if i + 1 < len(size) else (0, 0.0)
            out.append(dict(zip(["text", *FEATURES], (text, words, density[i], *before, *after, heading, standing, bad, remarks))))
        return out


def blocks_of(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and ``blocks``, all text blocks of each page in order; null and empty pages have none."""
    rows = pages.select(F.struct(*keep, F.lit(0).alias("_")).alias("kept"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                blocks = pa.array([Blocks(p).rows() for p in part.column("page").to_pylist()], _BLOCK_TYPE)
                yield pa.RecordBatch.from_arrays([part.column("kept"), blocks], ["kept", "blocks"])

    kept = rows.schema["kept"].dataType.simpleString()
    return rows.mapInArrow(run, f"kept {kept}, blocks array<{_BLOCK}>").select(*(F.col("kept").getField(c).alias(c) for c in keep), "blocks")


def labelled_blocks(pages: list[str]) -> list[dict]:
    """Blocks of labelled pages: ``{m12}`` stands for 12 words of main text (label 1), ``{r3}`` for 3 words of the rest (0)."""
    fill = lambda m: " ".join([m[1]] * int(m[2]))
    rows = [b for page in pages for b in Blocks(re.sub(r"\{([mr])(\d+)\}", fill, page)).rows()]
    return [b | {"label": float(b["text"].startswith("m"))} for b in rows]


def fit(spark: SparkSession, pages: list[str] | None = None, depth: int = 8):
    """A decision tree over ``FEATURES``, trained on the blocks of ``pages`` (by default ``labelled_pages``)."""
    rows = spark.createDataFrame([tuple(float(b[f]) for f in [*FEATURES, "label"]) for b in labelled_blocks(pages or labelled_pages())], [*FEATURES, "label"]).coalesce(1)
    tree = DecisionTreeClassifier(maxDepth=depth, maxBins=128, seed=1)
    return tree.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))


def is_main(model, block: Column) -> Column:
    """The tree as a column expression over the fields of ``block``."""

    def branch(node) -> Column:
        if node.subtreeDepth() == 0:
            return F.lit(node.prediction() >= 0.5)
        split = node.split()
        value = block[FEATURES[split.featureIndex()]].cast("double")
        return F.when(value <= split.threshold(), branch(node.leftChild())).otherwise(branch(node.rightChild()))

    return branch(model._java_obj.rootNode())


def main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), model=None) -> DataFrame:
    """``keep`` and ``text``, the main text of each page: its main blocks in page order, joined by line ends.

    Inside a block white space, also that of ``<br>``, is one space; character references are decoded once. Scripts, styles,
    comments of the markup and the page's title element are no text. Null, empty and text-free pages give an
    empty text; repeated rows are extracted each on its own; a page cut off within a tag loses that tag alone.
    """
    model = model or fit(pages.sparkSession)
    chosen = F.filter("blocks", lambda b: is_main(model, b))
    return blocks_of(pages, html, keep).select(*keep, F.array_join(F.transform(chosen, lambda b: b["text"]), "\n").alias("text"))
