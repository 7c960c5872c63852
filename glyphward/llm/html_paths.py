"""Main text of HTML pages by tag-path ratios.

A page is read into text blocks, each with its root-to-leaf path of tags (containers with their
class). For every path the length of its text and its punctuation are summed over its blocks and
divided by their number. The ratios are smoothed over the path tree, each with those of the paths
beside it and beside its parent, fused by their geometric mean, and weighted by what the path tells:
blocks of links only, copyright lines, semantic tags, roles and class names of boilerplate. A path
is content if its fused ratio reaches a share of the page's mean over characters; the blocks of
content paths are the article. Along the page, headings take the ratio of the text that they head,
and gaps of up to two blocks between content blocks are closed. Inside an article or main element with
content, paths without a mark are content however short: cells of tables, nested lists, and links
that follow content, as lists of sources do.

All weights are relative. A mark says nothing where it holds most of the page: a form or an element
named as boilerplate that is around the whole article hides none of it.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphward.llm.tables import small_batches

# Tags by what they hold, and words by which pages name boilerplate.
SKIPPED = frozenset("script style noscript template iframe svg math canvas object audio video head title select option textarea button datalist".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul title".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLES = frozenset(("article", "main"))
NAMED = frozenset("div section td table ul ol dl aside header footer form".split())  # containers whose class is part of a path
MARKED_TAGS = frozenset("footer aside form dialog nav menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside rail footer masthead topbar toolbar comment comments disqus reply replies respond related recommended share sharing social subscribe newsletter signup login search popup modal overlay paywall widget widgets pager pagination".split()
)
# marks that also name parts of articles
AMBIGUOUS = frozenset("search share sharing notice notices alert menu related recommended reply replies respond rail pager popup".split())
# words beside a mark in a name that do not change what it says
AFFIXES = frozenset(
    "main site page top bottom left right list area box section wrapper wrap container inner outer block bar primary secondary links items item buttons icons form content slot unit header panel user users reader readers visitor visitors post posts article articles story stories entry entries blog thread feed count body title meta privacy policy message text".split()
)
LISTED = frozenset("posts articles stories links buttons icons items entries news feed".split())  # affixes beside which no mark is ambiguous
REMARKS = frozenset("comment comments disqus".split())  # marks of what readers wrote, which can be longer than the article
BARRIERS = SKIPPED | frozenset("html body div main article section center td table tbody tr header".split())  # a paragraph outside is not ended by a block inside
CELLS = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
CELL_BARRIERS = {"td": ("table",), "th": ("table",), "tr": ("table",), "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}
ENDS_P = BLOCKS - {"html", "body", "head", "caption", "tbody", "thead", "tfoot", "tr", "td", "th"}

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")  # of a class or id, which may be joined by capitals
TAG_MARK = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"([^\s/>=\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PUNCTUATION = re.compile(r"[.,;:!?…。、]")
UNSEEN = re.compile(r"(?i)(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)")
NOTICE = re.compile(r"(?i)(?:©|\(c\)|copyright\b|all rights reserved)")

SHARE = 0.2  # of the page's mean ratio from which a path is content
MARK = 0.08  # weight of a marked element
REMARK = 0.005  # of one that is marked as comments of readers
HINT = 0.3  # the same inside an article, where the mark is ambiguous
LEAST = 1e-9  # weight that marks inside marks leave at least
LINKS = 0.1  # weight of blocks that are links only
BESIDE = 0.02  # weight of what is outside articles on a page that has one with text
MOST = 2 / 3  # of a page's ratios by which a mark says nothing
ALL = 0.9999  # by which a mark of comments says nothing
HEADS = 3  # blocks in which the text of a heading begins
GAP = 2  # blocks between content that are closed


@dataclass
class Block:
    text: str
    path: int
    kind: str  # "", "a" for links only, "©" for notices
    heading: bool


class Paths:
    """The tag paths of a page, numbered so that a parent comes before its children."""

    def __init__(self) -> None:
        self.parent = [0]
        self.mark = [1.0]  # weight of the last element as a marked one
        self.article = [False]
        self.numbers: dict[tuple[int, str, float], int] = {}

    def below(self, parent: int, label: str, mark: float = 1.0, article: bool = False) -> int:
        key = (parent, label, mark)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.parent)
            self.parent.append(parent)
            self.mark.append(mark)
            self.article.append(article or self.article[parent])
        return number


@lru_cache(maxsize=1 << 14)
def boilerplate_words(name: str) -> frozenset[str]:
    """The words for boilerplate in a class or id that is made of these and their affixes only, as in site-footer or readerComments."""
    parts = frozenset(p.lower() for p in PART.findall(name))
    marks = parts & MARKS if parts <= MARKS | AFFIXES else frozenset()
    return marks | {name} if marks and parts & LISTED else marks


class _Page:
    """One pass over a page; every step takes time in proportion to what it reads."""

    def __init__(self, page: str):
        self.page = page
        self.paths = Paths()
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, int, bool]] = []  # tag, path, whether hidden
        self.open: dict[str, list[int]] = {}  # places of each tag in the stack
        self.parts: list[str] = []
        self.linked = self.plain = 0  # characters of the open block inside and outside links
        self.links = 0
        self.no_more: dict[str, int] = {}  # quote: a place from which it does not occur any more
        self._read()

    def _text(self, begin: int, end: int) -> None:
        if begin < end:
            part = self.page[begin:end]
            self.parts.append(part)
            size = len(part.strip())
            if self.links:
                self.linked += size
            else:
                self.plain += size

    def _close(self) -> None:
        """End the open block."""
        if self.parts:
            hidden = bool(self.stack) and self.stack[-1][2]
            text = "" if hidden else " ".join(html.unescape("".join(self.parts)).split())
            if text:
                tag, path, _ = self.stack[-1] if self.stack else ("", 0, False)
                kind = "©" if not self.paths.article[path] and len(text) < 300 and NOTICE.match(text) else "a" if self.linked and not self.plain and tag not in HEADINGS else ""
                if kind:
                    path = self.paths.below(path, kind)
                self.blocks.append(Block(text, path, kind, tag in HEADINGS))
            self.parts.clear()
        self.linked = self.plain = 0

    def _last(self, tags) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def _pop(self, tags: tuple[str, ...], barriers=()) -> None:
        """Close the innermost open element of ``tags`` and all inside it, unless one of ``barriers`` is inside."""
        at = self._last(tags)
        if at >= 0 and at > self._last(barriers):
            for tag, *_ in self.stack[at:]:
                self.open[tag].pop()
            del self.stack[at:]

    def _end_of_tag(self, at: int) -> int:
        """Place behind the ``>`` of the tag whose name ends at ``at``; quotes that never close are no quotes."""
        page = self.page
        while m := TAG_MARK.search(page, at):
            mark, at = m[0], m.end()
            if mark == ">":
                return at
            close = page.find(mark, at) if at < self.no_more.get(mark, len(page)) else -1
            if close < 0:
                self.no_more[mark] = min(at, self.no_more.get(mark, at))
            else:
                at = close + 1
        return len(page)

    def _read(self) -> None:
        page, at, begin = self.page, 0, 0
        while True:
            lt = page.find("<", at)
            if lt < 0:
                break
            after = page[lt + 1 : lt + 2]
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                to = end + 3 if end >= 0 else len(page)
            elif after in ("!", "?"):
                end = page.find(">", lt)
                to = end + 1 if end >= 0 else len(page)
            else:
                name = NAME.match(page, lt + 2 if after == "/" else lt + 1)
                if not name:
                    at = lt + 1  # a plain "<"
                    continue
                to = self._end_of_tag(name.end())
                self._text(begin, lt)
                if after == "/":
                    self._end(name[0].lower())
                else:
                    to = self._begin(name[0].lower(), page[name.end() : to - 1] if page[to - 1] == ">" else page[name.end() : to], to)
                at = begin = to
                continue
            self._text(begin, lt)
            at = begin = to
        self._text(begin, len(page))
        self._close()

    def _end(self, tag: str) -> None:
        if tag in BLOCKS or tag in SKIPPED:
            self._close()
            self._pop((tag,))
        elif tag == "a":
            self.links = max(0, self.links - 1)

    def _begin(self, tag: str, attributes: str, to: int) -> int:
        """Take an opening tag; the place where reading goes on."""
        if tag in RAW:
            end = re.compile(rf"(?i)</{tag}\s*>").search(self.page, to)
            return end.end() if end else len(self.page)
        if tag == "br":
            self.parts.append(" ")
        elif tag == "hr":
            self._close()
        elif tag == "a":
            self.links += 1
        elif tag in BLOCKS or (tag in SKIPPED and tag not in VOID):
            self._close()
            if tag in ENDS_P:
                self._pop(("p",), BARRIERS)
            for cell in CELLS.get(tag, ()):
                self._pop((cell,), CELL_BARRIERS[tag])
            if tag == "body":
                self._pop(("head",))
            if tag in HEADINGS:
                self._pop(tuple(HEADINGS), BARRIERS)
            if not attributes.endswith("/") or tag in BLOCKS:
                self._push(tag, attributes)
        return to

    def _push(self, tag: str, attributes: str) -> None:
        above = self.stack[-1][1] if self.stack else 0
        hidden = (bool(self.stack) and self.stack[-1][2]) or tag in SKIPPED
        inside = self.paths.article[above]
        marks = {tag} if tag in MARKED_TAGS or (tag == "header" and not inside) else set()
        names: list[str] = []
        if attributes and not hidden and tag not in ("html", "body"):
            for m in ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name == "hidden" or (name == "style" and UNSEEN.search(value)):
                    hidden = True
                elif name == "role" and value.lower() in ROLES:
                    marks.add(value.lower())
                elif name in ("itemprop", "itemtype") and value.rpartition("/")[2].lower() in REMARKS:
                    marks.add("comment")
                elif name in ("class", "id") and tag not in HEADINGS:
                    own = value.split()
                    names += map(str.lower, own) if name == "class" else []
                    words = frozenset().union(*map(boilerplate_words, own))
                    marks |= words & REMARKS if tag in ARTICLES else words
        label = f"{tag}.{' '.join(names)}" if names and tag in NAMED else tag
        mark = 1.0 if not marks else REMARK if marks & REMARKS else HINT if inside and marks <= AMBIGUOUS else MARK
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, self.paths.below(above, label, mark, tag in ARTICLES), hidden))


def path_ratios(found: list[Block], paths: Paths) -> list[float]:
    """The smoothed and fused ratio of every path, without weights; zero for paths without text of their own.

    The length and the punctuation of a path are means over its blocks. Each is averaged with the mean
    of the paths beside it (those with its parent) and of those beside its parent.
    """
    n = len(paths.parent)
    own, beside = ([[0, 0, 0] for _ in range(n)] for _ in range(2))
    for b in found:
        size, points = len(b.text), len(PUNCTUATION.findall(b.text))
        for sums in (own[b.path], beside[paths.parent[b.path]]):
            sums[0] += size
            sums[1] += points
            sums[2] += 1
    out = [0.0] * n
    for p in range(n):
        if own[p][2]:
            up = paths.parent[p]
            near = [own[p], beside[up], beside[paths.parent[up]] if up else (0, 0, 0)]
            length, points = (sum(s[k] / s[2] for s in near if s[2]) / len(near) for k in (0, 1))
            out[p] = (length * (1 + points)) ** 0.5
    return out


def path_weights(found: list[Block], paths: Paths, ratios: list[float]) -> list[float]:
    """What the marks of every path leave of its ratio.

    Where an article or main element has text that is not links only, all else counts little. A marked
    element counts little unless it holds MOST of the ratios of the nearest element around it that
    holds more than itself, and one of comments unless it holds ALL of the page's.
    """
    n = len(paths.parent)
    lone = any(paths.article[b.path] and not b.kind for b in found)
    weight = [1.0] * n
    held = [0.0] * n
    for b in found:
        base = (BESIDE if lone and not paths.article[b.path] else 1.0) * (1.0 if b.kind == "" else LINKS)
        weight[b.path] = base
        held[b.path] += base * ratios[b.path]
    for p in range(n - 1, 0, -1):
        held[paths.parent[p]] += held[p]
    marks, around = [1.0] * n, [held[0]] * n
    for p in range(1, n):
        up = paths.parent[p]
        around[p] = held[up] if held[p] < ALL * held[up] else around[up]
        least = ALL * held[0] if paths.mark[p] == REMARK else MOST * around[p]
        marks[p] = max(LEAST, marks[up] * (paths.mark[p] if held[p] < least else 1.0))
    return [w * m for w, m in zip(weight, marks, strict=True)]


def content(found: list[Block], paths: Paths) -> list[bool]:
    """Which blocks are content: those of the paths over the threshold, and what smoothing along the page adds."""
    ratios = path_ratios(found, paths)
    weights = path_weights(found, paths, ratios)
    score = [r * w for r, w in zip(ratios, weights, strict=True)]
    characters = sum(len(b.text) * weights[b.path] for b in found)
    mean = sum(score[b.path] * len(b.text) * weights[b.path] for b in found) / characters
    least = SHARE * mean
    chosen = [score[b.path] >= least for b in found]
    for i in range(len(found) - 1, -1, -1):  # a heading goes with the text after it
        b = found[i]
        if not chosen[i] and b.heading:
            near = [j for j in range(i + 1, min(len(found), i + 1 + HEADS)) if chosen[j]]
            chosen[i] = bool(near) and max(score[found[j].path] for j in near) * weights[b.path] >= least
    last = -1
    for i, b in enumerate(found):  # a short gap between content blocks is content, unless it is marked as something else
        if chosen[i]:
            if last >= 0 and 0 < i - last - 1 <= GAP:
                for j in range(last + 1, i):
                    level = weights[found[j].path] / (LINKS if found[j].kind == "a" else 1.0)
                    chosen[j] = level >= min(weights[found[last].path], weights[b.path])
            last = i
    if any(chosen[i] and paths.article[b.path] for i, b in enumerate(found)):
        for i, b in enumerate(found):  # in an article what no mark speaks against is content however short; links only where it goes on
            plain = paths.article[b.path] and weights[b.path] >= (LINKS if b.kind == "a" else 1.0)
            if plain and b.kind != "©" and (not b.kind or (i > 0 and chosen[i - 1] and paths.article[found[i - 1].path])):
                chosen[i] = True
    return chosen


def main_text(page: str | None) -> str:
    """The article of one page: its blocks joined by newlines; empty for null, empty and text-free pages."""
    read = _Page(page or "")
    if not read.blocks:
        return ""
    return "\n".join(b.text for b, yes in zip(read.blocks, content(read.blocks, read.paths), strict=True) if yes)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): one row for each row of ``pages``; extra columns are ignored.

    Null html counts as empty. Repeated rows stay. Whole pages are read, however long, deep or broken,
    in time in proportion to their length.
    """

    @F.arrow_udf("string")
    def text_of(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x) for x in column.to_pylist()], pa.string())

    return small_batches(pages).select("page_id", "url", text_of(F.col("html")).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
