"""Rules and packs: what to look for, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphward.functions.text import SPAN, contains_any, no_spans, opening_span, regex, spans, token_estimate

Spans = Callable[[Column], Column]
PythonDetector = Callable[[str], list[tuple[int, int, str]]]


@dataclass(frozen=True)
class Category:
    id: str
    label: str
    description: str | None = None


@dataclass(frozen=True)
class Template:
    id: str
    title: str
    category: str
    description: str
    body: str


@dataclass(frozen=True)
class Rule:
    """One thing to find. ``pattern`` wins over ``columns`` (text -> array of spans), and that over ``python`` (text -> list of (start, end, excerpt)); with none nothing is found."""

    id: str
    category: str
    severity: str
    message: str
    suggestion: str | None = None
    pattern: str | None = None
    ignore_case: bool = True
    columns: Spans | None = None
    python: PythonDetector | None = None
    confidence: float = 0.82
    optional: bool = False
    hint: str | None = None
    quick: str | None = None  # the same pattern for Java only, where that needs less backtracking
    closes: str | None = None  # every match ends with this: what lies behind the last one is not searched
    signs: str | None = None  # a pattern that is quick to look for and matches inside every match
    needs: tuple[str, ...] = ()  # one of these, in small letters, is in every text with a match; looked for before the pattern is

    @property
    def kind(self) -> str:
        return "pattern" if self.pattern else "columns" if self.columns else "python" if self.python else "none"

    def spans(self, text: Column, low: Column | None = None) -> Column:
        """array of (start, end, excerpt); ``low`` is :func:`folded` of the text, if it is at hand."""
        if self.needs and low is not None:
            return F.when(contains_any(low, self.needs), self.spans(text)).otherwise(no_spans())
        if self.pattern and not self.quick and repeats_a_group(self.pattern) and (found := python_matches(self.pattern, self.ignore_case)):
            return python_spans(found)(text)
        if self.pattern:
            held = F.substring(text, F.lit(1), F.length(text) - F.length(F.substring_index(text, self.closes, -1))) if self.closes else text
            if self.pattern.startswith(r"\A") and "|" not in self.pattern:
                return opening_span(held, regex(self.quick or self.pattern, self.ignore_case))
            found = spans(held, regex(self.quick or self.pattern, self.ignore_case))
            return F.when(held.rlike(regex(self.signs, self.ignore_case)), found).otherwise(no_spans()) if self.signs else found
        if self.columns:
            return self.columns(text)
        if self.python:
            return python_spans(self.python)(text)
        return no_spans()


_REPEATED_GROUP = re.compile(r"(?<!\\)\)(?:[*+](?!\+)|\{\d+,\}(?!\+)|\{(?:\d*,)?\d{3,}\}(?!\+))")


def repeats_a_group(pattern: str) -> bool:
    """Whether a group of the pattern is repeated often or without end. Java takes a piece of its stack for each repeat, and a long text would end its process."""
    return bool(_REPEATED_GROUP.search(pattern))


def python_matches(pattern: str, ignore_case: bool = True) -> PythonDetector | None:
    """A detector of the matches of a pattern by Python, which keeps no stack of repeats; None where Python cannot read it."""
    try:
        compiled = re.compile(pattern, re.IGNORECASE if ignore_case else 0)
    except re.error:
        return None
    return lambda text: [(m.start(), m.end(), m.group(0)) for m in compiled.finditer(text)]


def python_spans(detect: PythonDetector) -> Spans:
    """A Python detector as a column function, Arrow batch by Arrow batch."""

    def find(text: Column) -> Column:
        kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("excerpt", pa.string())]))

        @F.arrow_udf(f"array<{SPAN}>")
        def udf(column: pa.Array) -> pa.Array:
            return pa.array([[{"start": a, "end": b, "excerpt": x} for a, b, x in detect(t)] if t is not None else [] for t in column.to_pylist()], kinds)

        return udf(text)

    return find


@runtime_checkable
class PackLike(Protocol):
    """What a pack from elsewhere must offer."""

    name: str
    label: str
    description: str
    file_extensions: tuple[str, ...]
    categories: list[Category]
    rules: list[Rule]
    templates: list[Template]

    def detects(self, text: Column) -> Column: ...

    def wants_optional(self, text: Column) -> Column: ...

    def rewrite(self, text: Column, findings: Column, designer: Column) -> Column | None: ...

    def estimate_tokens(self, text: Column) -> Column: ...


@dataclass
class Pack:
    """Defaults: detects nothing, optional rules off, no rewriting."""

    name: str
    label: str
    description: str
    file_extensions: tuple[str, ...] = ()
    categories: list[Category] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    templates: list[Template] = field(default_factory=list)

    def detects(self, text: Column) -> Column:
        """Whether a text looks like this pack's kind."""
        return F.lit(False)

    def wants_optional(self, text: Column) -> Column:
        """Whether a text turns on the optional rules by itself."""
        return F.lit(False)

    def rewrite(self, text: Column, findings: Column, designer: Column) -> Column | None:
        """struct(rewritten, notes, diff) or None where the pack cannot rewrite."""
        return None

    def estimate_tokens(self, text: Column) -> Column:
        return token_estimate(text)
