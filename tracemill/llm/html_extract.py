"""The main text of web pages by tree scoring.

A page is read into a tree as browsers do it: scripts, styles, comments and the
head are no content, void elements have no end, a new block ends an open
paragraph, a list item or cell ends its open neighbour, an end tag closes what
it finds open and is dropped if it finds nothing.  An open head ends with the
first element that can't be in one; elements nested deeper than DEPTH are
siblings, as in browsers.  A quote belongs to an attribute only right behind its
equals sign; a `<` outside quotes ends a tag that isn't closed.

Paragraphs (p, pre, td, blockquote, li, and a div or section that holds no
block) of MIN_CHARS characters pass points to their ancestors: 1, 1 for each
comma, 1 for each 100 characters up to 3.  The parent gets all of them, the
grandparent half, the levels above that 1/(3 * level).  What is navigation, a
form or the like by its tag, or an advertisement, menu or the like by its class
or id, is left out, but for a form that holds most of the page's text.  Text
directly in the body counts as paragraphs of the body, split by blocks and
double line breaks; without a body or html element the page itself is the body.
An ancestor's points
start from its tag and from words in its class and id, and are discounted at
the end by link density, the share of its text in links.  The best container is
kept whole but for parts that are mostly links, and so are siblings of the best
that score a fifth of it (10 at least), and sibling paragraphs, text directly in the body among them, with few links.

Pages are independent: one pass in Arrow batches without a shuffle.  The time
is in proportion to the page, whatever its markup is like.

Defined cases: null or empty html gives an empty text and score 0; a page without
a paragraph that scores gives its first article or main element, without one the
whole body if it has MIN_CHARS characters and isn't mostly links, and else
nothing, with score 0; broken markup is read as above; ties go to the
container that comes first; very long pages are read whole; rows that repeat
are each extracted; ids may be null and of any type; an empty table gives no
rows; further columns are not carried.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.cluster import prepare
from tracemill.llm.columns import identified, quoted

MIN_CHARS = 25
#: Elements within elements, beyond which they are put beside each other.
DEPTH = 512

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
PARAGRAPH = frozenset(("p", "pre", "td", "blockquote", "li"))
#: Never content, whatever they score.
ASIDE = frozenset("nav aside footer form button select noscript iframe head".split())
ENDS = {"li": ("li", ("ul", "ol")), "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table")), "tr": ("tr", ("table",)), "dd": ("dd", ("dl",)), "dt": ("dt", ("dl",)), "option": ("option", ("select",))}
#: What may be in a head without ending it.
HEAD = frozenset("base basefont bgsound link meta noscript script style template title head html".split())
START = {"article": 8.0, "main": 8.0, "div": 5.0, "section": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "form": -3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "address": -3.0, "th": -5.0}
GOOD_WORDS = re.compile(r"(?i)article|body|content|entry|main|page|post|text|blog|story")
BAD_WORDS = re.compile(r"(?i)(?<![a-z])(?:ad|ads|banner|combx|comment|contact|foot|footer|hidden|masthead|media|menu|meta|nav|promo|related|scroll|share|sidebar|sponsor|tags|widget)(?![a-z])")
# Each alternative either reads on to its end once or stops at the next "<", so no two starts read the same text again and again.
_VALUE = r"(?:\s*=\s*(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'<>][^\s<>]*+)?+)?+"
_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|svg|math)\b[^<>]*+>.*?(?:</\1\s*>|\Z)|<(title|textarea)\b[^<>]*+>(.*?)(?:</\2\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[\s/\"']++|[^\s\"'<>/=][^\s\"'<>/=]*+" + _VALUE + r"|=)*+)(?:>|(?=<)|\Z)|<[!?][^<>]*+(?:>|(?=<)|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"(?i)(?<![\w-])(?:class|id)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
_SPACE = re.compile(r"\s+")


class Tree:
    """Elements in document order, each after its parent; text pieces in document order."""

    def __init__(self, page: str):
        self.tag, self.parent, self.named = ["#root"], [-1], [""]
        self.text: list[tuple[int, str]] = []
        self.title = ""
        #: For each tag, where it is among the open elements.
        self.depths: dict[str, list[int]] = {}
        open_, at = [0], 0
        for m in _MARK.finditer(page):
            if m.start() > at:
                self._say(open_[-1], page[at : m.start()])
            at = m.end()
            if m[2]:
                if m[2].lower() == "title" and not self.title:
                    self.title = _SPACE.sub(" ", html.unescape(m[3])).strip()
            elif m[5]:
                tag = m[5].lower()
                if m[4]:
                    self._end(open_, tag)
                else:
                    self._begin(open_, tag, m[6])
        if at < len(page):
            self._say(open_[-1], page[at:])
        #: The body, or what stands for it.
        self.top = next((self.tag.index(t) for t in ("body", "html") if t in self.tag), 0)
        self.wrappers = self._wrappers() if "form" in self.tag else frozenset()

    def _wrappers(self) -> frozenset[int]:
        """Forms that hold more than half of the page's text."""
        chars = [0] * len(self.tag)
        for node, s in self.text:
            chars[node] += 0 if s.isspace() else len(s)
        for i in range(len(chars) - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
        return frozenset(i for i, t in enumerate(self.tag) if t == "form" and 2 * chars[i] > chars[0])

    def direct(self, outside: list[bool]) -> list[list[int]]:
        """Places in text of the runs of MIN_CHARS characters that lie in the top element and in no block below it; some of it not even in a span or the like."""
        flows = [False] * len(self.tag)
        for i in range(self.top, len(self.tag)):
            flows[i] = i == self.top or (flows[self.parent[i]] and self.tag[i] not in BLOCK and not outside[i])
        runs, run, broken = [], [], False
        for k, (node, s) in enumerate(self.text):
            if s == "\n":
                if broken:
                    runs.append(run)
                    run = []
                broken = True
            elif not s.isspace():
                broken = False
                if not flows[node]:
                    runs.append(run)
                    run = []
            if flows[node]:
                run.append(k)
        runs.append(run)
        size = lambda r: sum(len(self.text[k][1]) for k in r if not self.text[k][1].isspace())
        return [r for r in runs if size(r) >= MIN_CHARS and any(self.text[k][0] == self.top and not self.text[k][1].isspace() for k in r)]

    def _say(self, node: int, raw: str) -> None:
        if raw and not raw.isspace():
            self.text.append((node, html.unescape(raw) if "&" in raw else raw))
        elif raw:
            self.text.append((node, " "))

    def _cut(self, open_: list[int], k: int) -> None:
        for node in open_[k:]:
            self.depths[self.tag[node]].pop()
        del open_[k:]

    def _close(self, open_: list[int], tag: str, bounds: tuple[str, ...]) -> None:
        """Close the innermost open `tag` with what is in it, unless one of `bounds` lies within."""
        mine = self.depths.get(tag)
        if mine and not any(d[-1] > mine[-1] for b in bounds if (d := self.depths.get(b))):
            self._cut(open_, mine[-1])

    def _begin(self, open_: list[int], tag: str, rest: str) -> None:
        if tag not in HEAD and (head := self.depths.get("head")):
            self._cut(open_, head[-1])
        if tag in BLOCK:
            self._close(open_, "p", ("td", "th", "li", "article", "section", "div", "blockquote", "button"))
        if tag in ENDS:
            self._close(open_, *ENDS[tag])
        self.tag.append(tag)
        self.parent.append(open_[-1 if len(open_) <= DEPTH else -2])
        self.named.append(" ".join(_NAMED.findall(rest)) if rest else "")
        if tag not in VOID and not rest.endswith("/"):
            if len(open_) > DEPTH:
                self._cut(open_, len(open_) - 1)
            self.depths.setdefault(tag, []).append(len(open_))
            open_.append(len(self.tag) - 1)
        elif tag in ("br", "hr"):
            self.text.append((open_[-1], "\n"))

    def _end(self, open_: list[int], tag: str) -> None:
        self._close(open_, tag, ("table",) if tag not in ("table", "html", "body", "article", "main", "section", "div") else ())


def set_aside(tree: Tree, i: int) -> bool:
    """Whether an element is no content by its tag, or by its class and id."""
    if tree.tag[i] in ASIDE and i not in tree.wrappers:
        return True
    named = tree.named[i]
    return bool(named) and tree.tag[i] not in ("html", "body", "main", "article") and bool(BAD_WORDS.search(named)) and not GOOD_WORDS.search(named)


def weigh(tree: Tree) -> tuple[list[float], list[int], list[int], list[bool], list[list[int]]]:
    """(score, characters, characters in links, is a paragraph) of each element, and the body's own paragraphs."""
    n = len(tree.tag)
    chars, linked, commas = [0] * n, [0] * n, [0] * n
    for node, s in tree.text:
        chars[node] += len(s) if s.isspace() is False else 0
        commas[node] += s.count(",")
    holds_block = [False] * n
    for i in range(n - 1, 0, -1):
        if tree.tag[i] == "a":
            linked[i] = chars[i]
        p = tree.parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        commas[p] += commas[i]
        holds_block[p] = holds_block[p] or holds_block[i] or tree.tag[i] in BLOCK
    paragraph = [(t in PARAGRAPH or t in ("div", "section", "article")) and not holds_block[i] for i, t in enumerate(tree.tag)]
    outside = [False] * n
    points: dict[int, float] = {}

    def give(up: int, n_commas: int, n_chars: int) -> None:
        worth, level = 1.0 + n_commas + min(n_chars // 100, 3), 0
        while up > 0 or up == tree.top:
            if up not in points:
                points[up] = START.get(tree.tag[up], 0.0) + (25.0 * (bool(GOOD_WORDS.search(tree.named[up])) - bool(BAD_WORDS.search(tree.named[up]))) if tree.named[up] else 0.0)
            points[up] += worth / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = tree.parent[up], level + 1

    for i in range(1, n):
        outside[i] = outside[tree.parent[i]] or set_aside(tree, i)
        if not outside[i] and paragraph[i] and chars[i] >= MIN_CHARS:
            give(tree.parent[i], commas[i], chars[i])
    runs = tree.direct(outside)
    for run in runs:
        said = [s for s in (tree.text[k][1] for k in run) if not s.isspace()]
        give(tree.top, sum(s.count(",") for s in said), sum(map(len, said)))
    score = [0.0] * n
    for i, x in points.items():
        score[i] = x * (1 - (linked[i] / chars[i] if chars[i] else 0.0))
    return score, chars, linked, paragraph, runs


def _within(tree: Tree, top: int) -> list[bool]:
    """Whether an element lies in top and in nothing that is set aside."""
    out = [False] * len(tree.tag)
    for i in range(top, len(out)):
        out[i] = i == top or (out[tree.parent[i]] and not set_aside(tree, i))
    return out


def _in_links(tree: Tree) -> list[bool]:
    out = [False] * len(tree.tag)
    for i in range(1, len(out)):
        out[i] = tree.tag[i] == "a" or out[tree.parent[i]]
    return out


def extract(page: str | None) -> tuple[str, str, float]:
    """(title, text, score of the best container)."""
    if not page:
        return "", "", 0.0
    tree = Tree(page)
    score, chars, linked, paragraph, runs = weigh(tree)
    n = len(tree.tag)
    best = max(range(n), key=lambda i: (score[i], -i))
    if score[best] <= 0:
        best = next((i for i in range(1, n) if tree.tag[i] in ("article", "main")), -1)
        if best < 0:
            best = tree.top
            whole = _within(tree, best)
            size = sum(len(s) for node, s in tree.text if whole[node] and not s.isspace())
            links = _in_links(tree)
            if size < MIN_CHARS or 2 * sum(len(s) for node, s in tree.text if whole[node] and links[node] and not s.isspace()) > size:
                return tree.title, "", 0.0
        score[best] = 0.0
    density = [linked[i] / chars[i] if chars[i] else 0.0 for i in range(n)]
    least = max(10.0, 0.2 * score[best])
    kept = [False] * n
    kept[0] = best == 0
    for i in range(1, n):
        if i == best:
            kept[i] = True
        elif set_aside(tree, i):
            kept[i] = False
        elif tree.parent[i] == tree.parent[best]:
            kept[i] = score[i] >= least or (paragraph[i] and tree.tag[i] == "p" and chars[i] > 80 and density[i] < 0.25)
        elif kept[tree.parent[i]]:
            kept[i] = not (tree.tag[i] in ("ul", "ol", "div", "table", "section") and density[i] > 0.5)
    lines: list[str] = []
    last, line = -1, []
    block = [0] * n
    for i in range(1, n):
        block[i] = i if tree.tag[i] in BLOCK else block[tree.parent[i]]
    beside: set[int] = set()
    if best and tree.parent[best] == tree.top:
        links = _in_links(tree)
        for run in runs:
            said = [(node, len(s)) for node, s in (tree.text[k] for k in run) if not s.isspace()]
            size = sum(k for _, k in said)
            if size > 80 and sum(k for node, k in said if links[node]) < 0.25 * size:
                beside.update(run)
    for k, (node, s) in enumerate(tree.text):
        if not kept[node] and k not in beside:
            continue
        if block[node] != last or s == "\n":
            lines.append("".join(line))
            line, last = [], block[node]
        line.append(s)
    lines.append("".join(line))
    text = "\n".join(x for x in (_SPACE.sub(" ", x).strip() for x in lines) if x)
    return tree.title, text, round(score[best], 6)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        title, text, score = zip(*(extract(x) for x in batch.column(1).to_pylist())) if batch.num_rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(title, pa.string()), pa.array(text, pa.string()), pa.array(score, pa.float64())], ["page_id", "title", "text", "score"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, title, text and the best container's score, for each page."""
    prepare(pages.sparkSession)
    page, kind = identified(pages, "page_id")
    return pages.select(page, quoted("html").cast("string")).mapInArrow(_extract, f"page_id {kind}, title string, text string, score double")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
