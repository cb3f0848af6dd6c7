"""The main text of web pages by two passes of rules over their blocks.

A page is cut into blocks at block elements. First pass, each block alone: a block in a removed place (menu, page header,
footer, sidebar, notice, advert, form, reader comments) and one made mostly of links are bad; a long block with many stop
words is good; a long one with few is bad; the others are open: ``near`` where they have stop words, ``short`` where they
are too short to tell. Second pass: an open block takes the label of the nearest decided block before or behind it; at
equal distance a heading takes what follows, a ``near`` block is good, another one is bad.

Where a page marks its article (``article``, ``main`` or that role), blocks outside are bad; inside, only removed places
and link lists are, while a paragraph or heading of links and a long block with few stop words are open; the article's edges
count as decided good blocks, and equal distances are good: an article's own short, foreign or tabular blocks stay. Where nothing in a page is decided good, all
open blocks are.

Stop words are a parameter, a list for each language; a block counts by the language that fits it best. A page is one
row: the scan of a page is linear, there is no shuffle and nothing is held beyond one Arrow batch.

Cases: null, empty and blank pages and pages without text give an empty string; broken and cut-off markup is read as
browsers do (open elements end with their parents, an unfinished tag or comment is dropped, an unfinished character
reference stays as it stands unless it needs no semicolon); any number of rows may repeat an id, each gives a row;
very long pages are read whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Mapping, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import rows_of

# Frequent function words of four languages, and the thresholds of the published stop-word rule.
STOP_WORDS = {
    "en": "the of and to a in is that for it was with be by on are this as from at an not or but",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an",
    "fr": "de la le et les des en un du une que est pour qui dans par au sur pas il plus se ne avec",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más",
}
SHORT, LONG, FEW, MANY, LINKS = 70, 200, 0.30, 0.32, 0.5
# Elements of the markup language by what they do to the text.
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp svg math".split())
GONE = frozenset("nav footer aside menu dialog button select option object audio video canvas map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span "
    "strike strong sub sup time tt u var wbr img input br nobr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Words of a class, id or role that name a place to remove; those of PLACE_AROUND may also name a frame around an article,
#: unless a word of PLACE_KEPT stands beside them (``has-sidebar``).
PLACES = frozenset("comments comment disqus respond replies cookie cookies consent gdpr advert advertisement ads ad adsbox sponsored "
                   "promo newsletter subscribe signup login breadcrumb breadcrumbs pagination pager share sharing social related "
                   "recommended navbar topbar masthead toolbar popup modal alert notice disclaimer copyright".split())
PLACE_AROUND = frozenset("sidebar menu nav navigation header footer banner widget widgets aside".split())
PLACE_KEPT = frozenset("with has no".split())
#: Words that tell an article's own header from the page's.
OWN_HEADER = frozenset("article post entry story content title".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</>|</[^A-Za-z>][^>]*(?:>|\Z)|"
    r"<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^\"'>]++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?P<close>>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"""(class|id|role|href)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
WORDS = re.compile(r"[^\W\d_]+")


#: Elements that end an open one of their kind, up to an element that holds such lists.
ENDED_BY_SAME = ((("li",), ("ul", "ol")), (("dt", "dd"), ("dl",)), (("td", "th"), ("tr", "table")), (("tr",), ("table",)),
                 (tuple(sorted(HEADINGS)), ("section", "div")))


class Block(NamedTuple):
    text: str
    linked: int
    name: str
    place: str


def _place(name: str, rest: str, outer: str) -> str:
    """Where an element's text belongs: ``body``, ``article``, ``around`` (a removed frame) or ``gone``."""
    if outer == "gone" or name in GONE or (name == "header" and outer != "article"):
        return "gone"
    found = {k.lower(): (a or b or c).lower() for k, a, b, c in ATTRIBUTE.findall(rest)} if rest else {}
    words = set(re.split(r"[^a-z]+", " ".join(found.get(k, "") for k in ("class", "id", "role")))) if found else set()
    if name not in ("html", "body"):
        if words & PLACES and not words & PLACE_KEPT:
            return "gone"
        around = words & PLACE_AROUND
        if "header" in around and (outer == "article" or words & OWN_HEADER):
            around = around - {"header"}
        if (around and not words & PLACE_KEPT) or name == "form":
            return "around"
    if name in ("article", "main") or found.get("role") in ("article", "main"):
        return "article"
    return outer


class _Page:
    """Blocks of one page in their order; ``stack`` holds the open elements that can end a place."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, str]] = []
        self.open: Counter[str] = Counter()
        self.place = "body"
        self.parts: list[str] = []
        self.parts_place, self.begun, self.removed, self.linked, self.link, self.name = "body", False, False, 0, None, ""
        self._read(page)
        self._end_block()

    def _end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(text, self.linked, self.name, self.parts_place))
        elif self.removed:
            self.blocks.append(Block("", 0, "", "gone"))
        self.parts.clear()
        self.begun, self.removed, self.linked, self.name = False, False, 0, ""

    def _push(self, name: str, place: str) -> None:
        self.stack.append((name, place))
        self.open[name] += 1
        self.place = place

    def _cut(self, depth: int) -> None:
        for name, _ in self.stack[depth:]:
            self.open[name] -= 1
        del self.stack[depth:]
        self.place = self.stack[-1][1] if self.stack else "body"
        if self.link is not None and depth < self.link:
            self.link = None

    def _last(self, names: Sequence[str], until: Sequence[str] = ()) -> int | None:
        if any(self.open[n] for n in names):
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in names:
                    return i
                if self.stack[i][0] in until:
                    break
        return None

    def _open(self, name: str, rest: str) -> None:
        if name in INLINE:
            if name == "br":
                self.parts.append(" ")
            if name == "a":
                self.link = len(self.stack) if "href" in rest.lower() else None
            # An inline element that is removed leaves the block it stands in whole.
            if name not in VOID and (place := _place(name, rest, self.place)) != self.place:
                self._push(name, place)
            return
        self._end_block()
        if (p := self._last(("p",))) is not None:
            self._cut(p)
        for same, until in ENDED_BY_SAME:
            if name in same and (at := self._last(same, until)) is not None:
                self._cut(at)
        self.name = name
        if name not in VOID:
            self._push(name, _place(name, rest, self.place))

    def _shut(self, name: str) -> None:
        if name == "a":
            self.link = None
        if name not in INLINE:
            self._end_block()
        if (at := self._last((name,))) is not None:
            self._cut(at)

    def _text(self, raw: str) -> None:
        if not raw or raw.isspace():
            if raw:
                self.parts.append(" ")
        elif self.place in ("gone", "around"):
            self.removed = True
        else:
            text = html.unescape(raw) if "&" in raw else raw
            if not self.begun:
                self.begun, self.parts_place = True, self.place
            self.parts.append(text)
            if self.link is not None:
                self.linked += len("".join(text.split()))

    def _read(self, page: str) -> None:
        at, size = 0, len(page)
        while at < size:
            tag = TAG.search(page, at)
            if tag is None:
                self._text(page[at:])
                return
            self._text(page[at:tag.start()])
            at = tag.end()
            name = tag["name"]
            if name is None:
                continue
            if not tag["close"]:
                return
            name = name.lower()
            if tag["end"]:
                self._shut(name)
            elif name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else size
            else:
                self._open(name, tag["rest"])


def _first(block: Block, lists: Sequence[frozenset], marked: bool) -> str:
    """A block's label by itself: good, bad, near or short."""
    if block.place in ("gone", "around") or (marked and block.place != "article"):
        return "bad"
    size = len(block.text)
    if block.linked > LINKS * size:
        return "short" if marked and (block.name == "p" or block.name in HEADINGS) else "bad"
    if size < SHORT:
        return "short"
    words = WORDS.findall(block.text.lower())
    dense = max((sum(w in stops for w in words) for stops in lists), default=0) / max(len(words), 1)
    if dense >= MANY and size > LONG:
        return "good"
    if dense >= FEW:
        return "near"
    return "short" if marked else "bad"


def _second(blocks: Sequence[Block], labels: Sequence[str], marked: bool) -> list[bool]:
    """Whether each block is kept; open ones look at the nearest decided blocks."""
    count = len(blocks)
    decided = [label in ("good", "bad") for label in labels]
    if "good" not in labels and not marked:
        return [not d for d in decided]
    inside = [b.place == "article" for b in blocks]
    before: list[tuple[int, str]] = []
    last = (count + 1, "bad")
    for i in range(count):
        if marked and inside[i] and (i == 0 or not inside[i - 1]):
            last = (0, "good")  # the article's edge
        before.append((last[0] + 1, last[1]))
        last = (0, labels[i]) if decided[i] else (last[0] + 1, last[1])
    keep, last = [False] * count, (count + 1, "bad")
    for i in range(count - 1, -1, -1):
        if marked and inside[i] and (i + 1 == count or not inside[i + 1]):
            last = (0, "good")
        behind = (last[0] + 1, last[1])
        if decided[i]:
            keep[i] = labels[i] == "good"
            last = (0, labels[i])
            continue
        last = behind
        if before[i][0] == behind[0] and before[i][1] != behind[1]:
            keep[i] = behind[1] == "good" if blocks[i].name in HEADINGS and not marked else marked or labels[i] == "near"
        else:
            keep[i] = min(before[i], behind)[1] == "good"
    return keep


def main_blocks(page: str | None, lists: Sequence[frozenset]) -> list[str]:
    """The blocks of a page's main text."""
    blocks = _Page(page or "").blocks
    marked = any(b.place == "article" for b in blocks)
    labels = [_first(b, lists, marked) for b in blocks]
    return [b.text for b, keep in zip(blocks, _second(blocks, labels, marked)) if keep]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            stop_words: Mapping[str, str] = STOP_WORDS) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks): each page's main text, its blocks parted by an empty line."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = dict(rows.dtypes)

    def read(batches):
        lists = [frozenset(words.split()) for words in stop_words.values()]
        for batch in batches:
            found = [main_blocks(page, lists) for (page,) in rows_of([batch], "html")]
            texts = ["\n\n".join(f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([len(f) for f in found], pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks"])

    return rows.mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_blocks long")
