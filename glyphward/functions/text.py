"""Text functions as Spark columns.

Spark's regular expressions are Java's. Every pattern is given the flags U (Unicode classes and
case) and d (only the newline ends a line), which makes word characters, word borders, white space
and line ends those of Unicode text. Offsets count code points from 0; ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s\x1c-\x1f]"  # Unicode white space; the four separators are not in \s
WORD = r"[^\s\x1c-\x1f]+"
SPAN = "struct<start:int,end:int,excerpt:string>"


def regex(pattern: str, ignore_case: bool = False) -> str:
    """``pattern`` with the flags that all patterns here have."""
    return f"(?Ud{'i' if ignore_case else ''}){pattern}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# A run is looked at from its start only, and never given back: else a long one takes time with its square.
RUN_OF_BLANKS = rf"(?<!{BLANK}){BLANK}++"


def _cut(text: Column, pattern: str, *ends: int) -> Column:
    """``text`` without matches of ``pattern``, which is looked for only if the character at one of ``ends`` is white space."""
    blank = lambda t: F.concat(*(F.substring(t, i, 1) for i in ends)).rlike(regex(BLANK))
    return let(text, lambda t: F.when(blank(t), F.regexp_replace(t, regex(pattern), "")).otherwise(t))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return _cut(text, rf"\A{BLANK}++|{RUN_OF_BLANKS}\z", 1, -1)


def lstrip(text: Column) -> Column:
    return _cut(text, rf"\A{BLANK}+", 1)


def is_blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return text.isNull() | ~text.rlike(regex(r"[^\s\x1c-\x1f]"))


def words(text: Column) -> Column:
    """The white-space separated words."""
    return F.filter(F.split(text, regex(f"{BLANK}+"), -1), lambda w: w != "")


def count_of(text: Column, part: Column | str) -> Column:
    """Non-overlapping occurrences of a non-empty literal."""
    part = F.lit(part) if isinstance(part, str) else part
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether any of the literals occurs."""
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def folded(text: Column) -> Column:
    """Small letters, with those of other letters that patterns take for ASCII ones whatever the case: what a text must hold can be looked up here."""
    others = "ſ\u212aıİ"
    return F.lower(let(text, lambda t: F.when(contains_any(t, tuple(others)), F.translate(t, others, "skii")).otherwise(t)))


SMALL = "ß" + "".join(map(chr, (*range(0x1F80, 0x1F88), *range(0x1F90, 0x1F98), *range(0x1FA0, 0x1FA8), 0x1FB3, 0x1FC3, 0x1FF3)))
CAPITAL = "ẞ" + "".join(map(chr, (*range(0x1F88, 0x1F90), *range(0x1F98, 0x1FA0), *range(0x1FA8, 0x1FB0), 0x1FBC, 0x1FCC, 0x1FFC)))


def one_capital(letter: Column) -> Column:
    """The capital of a letter if that is one letter too, ẞ for ß; else the letter."""
    return let(F.upper(letter), lambda c: F.when(F.length(c) > 1, F.translate(letter, SMALL, CAPITAL)).otherwise(c))


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def span(start: Column, end: Column, excerpt: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), excerpt.alias("excerpt"))


def steps(text: Column, pattern: str | Column, more: Callable[[Column, Column], list[Column]] = lambda gap, match: []) -> Column:
    """array of (gap, match, ...) of a pattern that cannot match the empty string: the length of what lies before each match, the match, and what ``more`` makes of both."""
    split, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(0))
    step = F.zip_with(split, found, lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match"), *more(gap, match)))
    return F.filter(step, lambda x: x["match"].isNotNull())  # the gap after the last match has no match beside it


def spans(text: Column, pattern: str | Column) -> Column:
    """Every match of a pattern that cannot match the empty string: array of (start, end, excerpt), left to right.

    Spark has no function for the places of matches. The gaps between matches (a split) and the
    matches themselves give them by running lengths. Rows without a match run one search only.
    """
    there = text.rlike(pattern) if isinstance(pattern, str) else F.rlike(text, pattern)
    return F.when(there, let(steps(text, pattern), placed)).otherwise(no_spans())


def opening_span(text: Column, pattern: str) -> Column:
    """As :func:`spans` for a pattern that matches at the start of the text only: what lies behind is not searched."""
    return let(F.regexp_extract(text, pattern, 0), lambda m: F.when(m != "", F.array(span(F.lit(0), F.length(m), m))).otherwise(no_spans()))


RUN = 128  # matches that are placed one after the other


def placed(found: Column) -> Column:
    """The spans of all :func:`steps`. Every append copies what there is, so many are taken run by run."""
    return F.when(F.size(found) <= RUN, _placed(found, F.lit(0))).otherwise(_placed_by_runs(found))


def _placed(steps: Column, start: Column) -> Column:
    """The spans of (gap, match) steps from an offset on."""

    def add(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + F.length(x["match"])
        return F.struct(end.alias("at"), F.array_append(state["found"], span(begin, end, x["match"])).alias("found"))

    return F.aggregate(steps, F.struct(start.cast("int").alias("at"), no_spans().alias("found")), add, lambda s: s["found"])


def _runs(xs: Column) -> Column:
    """Runs of RUN elements of a non-empty array."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / RUN).cast("int")), lambda i: F.slice(xs, i * RUN + 1, RUN))


def running(sizes: Column) -> Column:
    """The sums of what lies before each element of a non-empty array of whole numbers, by runs and runs of runs."""

    def starts(run: Column, first: Column) -> Column:
        add = lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["found"], s["at"]).alias("found"))
        return F.aggregate(run, F.struct(first.cast("int").alias("at"), F.array().cast("array<int>").alias("found")), add, lambda s: s["found"])

    outer = _runs(sizes)
    firsts = let(F.transform(outer, lambda r: F.aggregate(r, F.lit(0), lambda a, x: a + x)), lambda n: starts(n, F.lit(0)))
    return F.flatten(F.zip_with(outer, firsts, starts))


def _placed_by_runs(steps: Column) -> Column:
    """As :func:`_placed` for many: the lengths of runs give where each starts."""
    total = lambda run: F.aggregate(run, F.lit(0), lambda a, x: a + x["gap"] + F.length(x["match"]))
    place = lambda runs: F.flatten(F.zip_with(runs, let(F.transform(runs, total), running), _placed))
    return let(_runs(steps), place)


def truncated(text: Column, limit: int = 60) -> Column:
    """Stripped, and cut to ``limit`` characters with an ellipsis."""
    text = strip(text)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def token_estimate(text: Column) -> Column:
    """0 for blank text, else the largest of 1, 1.33 tokens a word and a quarter of the characters, rounded down."""
    by_words = F.floor(F.size(words(text)) * F.lit(1.33))
    by_chars = F.floor(F.length(text) / 4)
    return F.when(is_blank(text), F.lit(0)).otherwise(F.greatest(F.lit(1), by_words, by_chars)).cast("int")
