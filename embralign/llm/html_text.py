"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass labels each block by where it stands
(menus, forms, adverts and other regions named by their tags, classes and roles are boilerplate), its
link density, its length and its density of stop words: good, bad, near-good or short. The second pass
lets the ambiguous ones (near-good, short) inherit from the nearest decided blocks before and after.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ._base import read_table, ship

#: Frequent function words.
STOP_WORDS = frozenset(
    "the of and to in a is that it for was on are as with be by this or at from an not have which but were "
    "le la de et les des en un une du que est pour dans qui sur au par pas plus ne se il ce "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an aus er hat dass bei wird "
    "el y los por con una las para del su al lo como más o pero sus ya".split()
)
DROP = "head script style noscript template iframe object embed svg math canvas audio video select textarea button datalist dialog map".split()
#: Elements that never hold the main text, and those that seldom do.
ASIDE = frozenset("nav footer aside menu".split())
FRAMES = frozenset("form fieldset header".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul caption hgroup".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs masthead header footer "
    "sidebar sidenav widget related recommended share sharing social cookie cookies consent notice popup modal overlay newsletter subscribe signup login "
    "search pagination pager copyright toolbar contentinfo complementary gdpr alert tags".split()
)
COMMENT = frozenset("comment comments commentlist reply replies respond disqus discussion reviews".split())
#: A class name with such a part says what is beside or inside, not what the element is.
WRAPS = frozenset("has with without no is js page entry post article content".split())
#: Class names tell something of these elements only; a paragraph or heading is judged by its text.
BOXES = frozenset("div section ul ol dl table tbody tr td header details dialog center article li".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>" + "|".join(DROP) + r")(?=[\s/>])[^>]*+(?:/>|>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)(?:>|\Z|(?P<bad>[^>]*+(?:>|\Z)))",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_HREF = re.compile(r"\bhref\s*=", re.IGNORECASE)
_PARTS = re.compile(r"[-_\W\d]+|(?<=[a-z])(?=[A-Z])")
_HEADING = re.compile("h[1-6]")
_WORD = re.compile(r"[^\W\d_]+")


class Block:
    __slots__ = ("heading", "inside", "label", "linked", "parts", "region", "text", "words")

    def __init__(self, region: int, inside: bool, heading: bool):
        self.region, self.inside, self.heading = region, inside, heading
        self.parts: list[str] = []
        self.linked = self.words = 0
        self.text = self.label = ""


class Regions:
    """Elements that look like boilerplate, each with the one around it (0: none), whether that is sure, and whether it holds a main element or title."""

    def __init__(self):
        self.parent, self.sure, self.main = [0], [False], [False]

    def open(self, parent: int, sure: bool) -> int:
        self.parent.append(parent)
        self.sure.append(sure)
        self.main.append(False)
        return len(self.parent) - 1

    def holds_main(self, region: int) -> None:
        while region and not self.main[region]:
            self.main[region] = True
            region = self.parent[region]

    def boilerplate(self, blocks: list[Block]) -> list[bool]:
        """For each region whether its text goes: not if it holds a title or main element or most of the page's good text, unless that is sure."""
        good = [0] * len(self.parent)
        for b in blocks:
            good[b.region] += b.words * (b.label == "good")
        total = sum(good)
        for k in range(len(good) - 1, 0, -1):
            good[self.parent[k]] += good[k]
        out = [False]
        for k in range(1, len(good)):
            wraps = self.main[k] or not self.sure[k] and 2 * good[k] > total
            out.append(out[self.parent[k]] or not wraps)
        return out


def _looks(tag: str, attrs: str, inside: bool) -> tuple[bool, bool]:
    """Of an element: whether it looks like boilerplate, and whether that is sure (menus, footers, comments, what is hidden)."""
    names: set[str] = set()
    for m in _ATTRIBUTE.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True, True
        if key in ("class", "id", "role"):
            names.update(value.split())
    if tag in ASIDE:
        return True, True
    hint = tag in FRAMES and not (tag == "header" and inside)
    if tag in BOXES and not (tag == "header" and inside):
        for name in names:
            parts = [x.lower() for x in _PARTS.split(name) if x]
            if not parts or WRAPS & set(parts[:-1]):
                continue
            if parts[0] in COMMENT or parts[-1] in COMMENT:
                return True, True
            hint = hint or tag != "li" and (parts[0] in HINTS or parts[-1] in HINTS)
    return hint, False


def blocks(source: str) -> tuple[list[Block], Regions]:
    out: list[Block] = []
    regions = Regions()
    stack: list[tuple[str, int, int]] = []
    region = inside = 0
    linked = -1  # how deep the open link was opened
    heading, breaks, at, block = False, 0, 0, None

    def add(piece: str) -> None:
        nonlocal block, breaks
        if not piece:
            return
        if block is None:
            block = Block(region, inside > 0, heading)
            out.append(block)
        block.parts.append(piece)
        if piece.strip():
            breaks = 0
            if linked >= 0:
                block.linked += len("".join(html.unescape(piece).split()))

    for m in _TOKEN.finditer(source):
        add(source[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            breaks += 1
            if breaks > 1:
                block = None
            else:
                add(" ")
                breaks = 1
            continue
        if tag == "a":
            linked = -1 if m["end"] or not _HREF.search(m["attrs"] or "") else len(stack)
            continue
        if tag not in BLOCKS:
            continue
        block, breaks = None, 0
        if tag in VOID:
            continue
        if not m["end"]:
            if stack and stack[-1][0] in ("p", "li" if tag == "li" else "p"):
                _, region, inside = stack.pop()
            stack.append((tag, region, inside))
            if tag in ("main", "h1"):
                regions.holds_main(region)
            attrs = m["attrs"] or ""
            boilerplate, sure = _looks(tag, attrs, inside > 0) if tag not in ("html", "body", "main") else (False, False)
            if boilerplate:
                region = regions.open(region, sure)
            elif tag in ("article", "main"):
                inside += 1
            heading = bool(_HEADING.fullmatch(tag))
        else:
            heading = False
            if any(x[0] == tag for x in stack):
                while stack:
                    name, region, inside = stack.pop()
                    if name == tag:
                        break
        if linked > len(stack):
            linked = -1
    add(source[at:])
    for b in out:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
    return [b for b in out if b.text], regions


def _by_density(found: list[Block], stop_words: frozenset[str], short_words: int, good_words: int, stop_low: float, stop_high: float, link_density: float) -> None:
    """First pass: every block by its own text. Where hardly any stop word is on the page (an unknown language), only length and links count."""
    rows = []
    for b in found:
        words = [w.lower() for w in _WORD.findall(b.text)]
        b.words = len(words)
        rows.append((sum(w in stop_words for w in words), b.linked / max(1, len("".join(b.text.split())))))
    known = 20 * sum(stop for stop, _ in rows) >= sum(b.words for b in found)
    for b, (stop, density) in zip(found, rows, strict=True):
        share = stop / max(1, b.words) if known else stop_low
        if density > link_density:
            b.label = "bad"
        elif b.heading or b.words < short_words:
            b.label = "short"
        elif share >= stop_high and b.words >= good_words or share >= stop_low and b.words >= 2 * good_words:
            b.label = "good"
        elif share >= stop_low or b.inside or not b.linked:
            b.label = "near"  # lists and tables of an article have few stop words, but no links either
        else:
            b.label = "bad"


def _inherit(pool: list[Block]) -> None:
    """Second pass: short and near blocks take the label of the nearest decided ones before and after, in one run each way."""
    after: list[tuple[str, int] | None] = [None] * len(pool)
    last = None
    for i in range(len(pool) - 1, -1, -1):
        after[i] = last
        if pool[i].label in ("good", "bad"):
            last = (pool[i].label, i)
        elif pool[i].heading and last and last[0] == "good":
            last = ("good", i)  # a heading goes with the text below
    before: tuple[str, int] | None = None
    for i, b in enumerate(pool):
        if b.label in ("good", "bad"):
            before = (b.label, i)
            continue
        near, below = b.label == "near", after[i]
        if b.heading and below and below[0] == "good":
            b.label = "good"
            before = ("good", i)
            continue
        if before is None or below is None:
            one = before or below
            b.label = one[0] if one else "open"
        elif before[0] == below[0]:
            b.label = before[0]
        else:
            b.label = "good" if near else before[0] if i - before[1] <= below[1] - i else below[0]


def classify(found: list[Block], regions: Regions, *, stop_words: frozenset[str] = STOP_WORDS, short_words: int = 12, good_words: int = 25, stop_low: float = 0.10, stop_high: float = 0.25, link_density: float = 0.33) -> None:
    """Sets each block's label to good or bad: by its own text, by the region it stands in, and the ambiguous ones by their neighbours.

    Regions and articles are signals beside the text: what looks like boilerplate goes unless it wraps the page's text, and
    where articles hold most of the good text they are all that stays, neighbours being looked for among their blocks alone.
    A page without any good block keeps its ambiguous ones (those of articles, if some are there).
    """
    _by_density(found, stop_words, short_words, good_words, stop_low, stop_high, link_density)
    goes = regions.boilerplate(found)
    for b in found:
        if goes[b.region]:
            b.label = "bad"
    good = [sum(b.words for b in found if b.label == "good" and b.inside == side) for side in (True, False)]
    ambiguous = [any(b.label in ("near", "short") and b.inside == side for b in found) for side in (True, False)]
    framed = good[0] >= good[1] and (good[0] > 0 or ambiguous[0])
    pool = []
    for b in found:
        if framed and not b.inside:
            b.label = "bad"
        elif not goes[b.region]:  # a menu or footer says nothing of the text beside it
            pool.append(b)
    if not any(b.label == "good" for b in pool):
        for b in pool:
            b.label = "good" if b.label in ("near", "short") else "bad"
    else:
        _inherit(pool)


def main_text(source: str | None) -> str:
    """The article's blocks, white space inside each turned into one space, joined by line feeds; empty for null, empty and textless pages."""
    if not source:
        return ""
    found, regions = blocks(source)
    classify(found, regions)
    return "\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages (page_id, url, html, ...) -> page_id, url, text, n_chars; one row per row, whatever repeats, nulls in any column included. Extra columns are ignored."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                texts = [main_text(x.as_py()) for x in batch.column(column)]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", column)
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(run, schema)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
