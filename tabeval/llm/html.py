"""Main text of web pages: a minimum cut separates content from boilerplate.

A page becomes a row of text blocks, each with its path in the document tree. A linear classifier
over the path and the text gives each block the cost of being called boilerplate or content: these
are the terminal capacities. Neighbouring blocks and blocks that share a parent are tied by
smoothness edges that weaken with their distance in the tree. Maximum flow finds the labelling of
least cost, and the blocks on the content side are the text.

Text in script, style and similar elements, in comments and in the head is never a block, nor are the labels of
buttons and the text of object and canvas, which stands in only where those cannot be shown. The head ends with
its end tag or with the first text or element that cannot stand in it. What a path says is held between -3000 and
3000, so that no depth of nesting outweighs every edge. Character
references are decoded; white space (space, tab, line feed, vertical tab, form feed, carriage return) inside
a block becomes one space. A missing or empty page has an empty text. Unclosed and stray tags are
taken as they come.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabeval.llm.maxflow import source_side

#: Fixed values of the markup language: elements without content, without shown text, and those that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style noscript template iframe svg canvas object select option textarea button datalist annotation annotation-xml".split())
IN_HEAD = frozenset("title script style noscript template link meta base".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that an opening tag closes, up to the nearest container.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
SCOPES = frozenset("ul ol dl table tbody div section article aside nav header footer main form body html td th blockquote figure".split())

#: The classifier, in hundredths of a logit: what an element or a word in its class, id or role says.
BIAS = -60
ELEMENTS = {
    "article": 420, "main": 300, "p": 90, "h1": 60, "h2": 40, "h3": 40, "blockquote": 60, "pre": 60, "figcaption": 30,
    "nav": -1000, "footer": -900, "aside": -900, "form": -900, "menu": -1000, "dialog": -900, "header": -260, "li": 60, "search": -900,
}
NAMES = {
    "article": 200, "content": 150, "post": 100, "entry": 100, "story": 150, "main": 120, "body": 40, "text": 40,
    "ad": -900, "ads": -900, "advert": -900, "advertisement": -900, "adsense": -900, "sponsor": -900, "sponsored": -900, "promo": -900,
    "banner": -700, "nav": -900, "navbar": -900, "navigation": -900, "menu": -900, "breadcrumb": -900, "breadcrumbs": -900,
    "header": -400, "masthead": -700, "footer": -900, "foot": -500, "sidebar": -900, "side": -400, "widget": -700, "related": -800,
    "recommended": -800, "comment": -900, "comments": -900, "reply": -800, "replies": -800, "disqus": -900, "respond": -800,
    "cookie": -900, "consent": -900, "notice": -800, "alert": -600, "popup": -900, "modal": -900, "overlay": -700, "newsletter": -900,
    "subscribe": -900, "subscription": -900, "signup": -900, "login": -900, "share": -800, "sharing": -800, "social": -800,
    "copyright": -900, "legal": -700, "disclaimer": -600, "toolbar": -800, "pagination": -900, "pager": -900, "tags": -500,
    "complementary": -900, "contentinfo": -900, "search": -800, "feedback": -800, "paywall": -900, "gdpr": -900,
}
#: Names that say something as a whole word only, not as a part of one: "side-by-side" is no side bar.
WHOLE = frozenset(["side"])
LINKED = -450  # times the share of the text that stands in links
LENGTH = ((25, 60), (60, 60), (160, 80))  # from so many characters on
SENTENCE = 50  # ends like a sentence

SMOOTH = 140  # capacity between blocks with the same parent, divided by their distance in the tree

_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_NAME = re.compile(r"[A-Za-z]+")


def _said(names: str) -> int:
    """What the words of a class, id, role or label say: a word that is a known name by that name, else the known
    names it is put together from, each once."""
    said = 0
    for word in names.lower().split():
        parts = [word] if word in NAMES else set(_NAME.findall(word)) - WHOLE
        said += sum(NAMES.get(x, 0) for x in parts)
    return said


@dataclass
class Block:
    text: str
    path: tuple[int, ...]  # numbers of the elements from the root on
    score: int


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int, bool]] = []  # element, number, what its path says, whether in a link
        self.count = 0
        self.hidden = 0
        self.parts: list[str] = []
        self.linked = 0
        self.blocks: list[Block] = []

    def _flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip(" ")
        if text:
            path = tuple(x[1] for x in self.stack if x[0] in BLOCKS)
            score = BIAS + (self.stack[-1][2] if self.stack else 0) + LINKED * min(self.linked, len(text)) // len(text)
            score += sum(gain for least, gain in LENGTH if len(text) >= least)
            score += SENTENCE * (text[-1] in ".!?…")
            self.blocks.append(Block(text, path, score))
        self.parts.clear()
        self.linked = 0

    def _pop(self) -> None:
        if self.stack[-1][0] in BLOCKS:
            self._flush()
        self.hidden -= self.stack.pop()[0] in HIDDEN

    def _close_implied(self, tag: str) -> None:
        closes = CLOSES.get(tag, {"p"} if tag in BLOCKS else set())
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in closes:
                while len(self.stack) > i:
                    self._pop()
            elif self.stack[i][0] in SCOPES:
                break

    def _leave_head(self) -> None:
        if self.stack and self.stack[-1][0] == "head":
            self._pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self._leave_head()
            self.parts.append(" ")
            return
        if tag not in IN_HEAD:
            self._leave_head()
        if tag in BLOCKS:
            self._flush()
        if tag == "body":
            while self.stack and self.stack[-1][0] in HIDDEN:
                self._pop()
        self._close_implied(tag)
        if tag in VOID:
            return
        said = ELEMENTS.get(tag, 0)
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role", "aria-label"))
        if names and tag not in ("body", "html"):
            said += _said(names)
        if any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs):
            said -= 900
        self.count += 1
        above = self.stack[-1] if self.stack else ("", 0, 0, False)
        self.stack.append((tag, self.count, max(-3000, min(3000, above[2] + said)), above[3] or tag == "a"))
        self.hidden += tag in HIDDEN

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS and self.stack and self.stack[-1][0] == tag and tag in HIDDEN | {"a"}:
            self._pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in ("body", "html"):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                while len(self.stack) > i:
                    self._pop()
                return
            # An inline end tag does not reach out of its block.
            if tag not in BLOCKS and self.stack[i][0] in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        if _SPACE.sub("", data):
            self._leave_head()
        if not self.hidden:
            self.parts.append(data)
            if self.stack and self.stack[-1][3]:
                self.linked += len(_SPACE.sub(" ", data))

    def close(self) -> None:
        super().close()
        self._flush()


def blocks_of(html: str) -> list[Block]:
    page = _Page()
    page.feed(html)
    page.close()
    return page.blocks


def _distance(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    shared = 0
    for x, y in zip(a, b):
        if x != y:
            break
        shared += 1
    return max(len(a), len(b)) - shared


def smoothness(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """Edges between neighbours in the page, and between each block and the one before it that has the
    same parent element: at most two for each block."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, SMOOTH // max(1, _distance(blocks[i - 1].path, b.path))))
        parent = b.path[:-1]
        before = last.get(parent)
        if before is not None and before != i - 1:
            edges.append((before, i, SMOOTH // 2))
        last[parent] = i
    return edges


def labels(blocks: list[Block]) -> list[bool]:
    """Which blocks are content, by the cut of least cost."""
    return source_side([b.score for b in blocks], smoothness(blocks))


def main_text(html: str | None) -> str:
    blocks = blocks_of(html or "")
    return "\n".join(b.text for b, good in zip(blocks, labels(blocks)) if good)


def extract(df: DataFrame, ident: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: id, url, text and its length in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["id", "url", "text", "n_chars"],
            )

    kinds = {k: df.schema[c].dataType.simpleString() for k, c in (("id", ident), ("url", url))}
    rows = df.select(F.col(ident).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long")
