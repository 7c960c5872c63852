"""Markdown style, accessibility and hygiene."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphward.functions.text import count_of, let, no_spans, placed, regex, running, span, spans, steps
from glyphward.operators.rules import Category, Pack, Rule, Template

# The patterns of the rules and how many findings of each a document can have.
MISSING_ALT = r"!\[(\s*)\]\(([^)]+)\)"
BARE_URL = r"(?<![(\[<\"])https?://[^\s<>)\]]+"
HEADING = r"(?m)^#{1,6}[\s&&[^\n]]+.+$"
TODO = r"\b(TODO|FIXME|XXX|HACK)\b[: ]?[^.\n]{0,80}"
LAZY_LINK = r"\[(click here|here|link|this|read more|more)\]\([^)]+\)"
BLANK_LINES = r"\n\n\n+"
MOST = {"trailing_whitespace": 10, "bare_url": 8, "heading_jump": 5, "todo_comment": 6}
MARKERS = ("\n# ", "\n## ", "\n- ", "\n* ", "](", "```")
TRAILING_EXCERPT = "  ← trailing whitespace"


LINE_BLANK = r"[[\s\x1c-\x1f]&&[^\n]]"


def trailing_whitespace(text: Column) -> Column:
    found = spans(text, regex(rf"(?<!{LINE_BLANK}){LINE_BLANK}++(?=\n|\z)"))
    return F.slice(F.transform(found, lambda s: span(s["start"], s["end"], F.lit(TRAILING_EXCERPT))), 1, MOST["trailing_whitespace"])


def _ticks(part: Column) -> Column:
    """Backticks of a part of a text, less one for each pair that stands together."""
    return count_of(part, "`") - count_of(part, "``")


def bare_urls(text: Column) -> Column:
    """Addresses before which an even number of backticks stands.

    No run of backticks goes over the start of an address or over its end, so what is counted in the
    parts between adds up to what is counted from the start of the text.
    """

    def outside_code(found: Column) -> Column:
        before = running(F.transform(found, lambda x: (x["in_gap"] + x["in_match"]) % 2))
        even = F.zip_with(before, found, lambda b, x: (b + x["in_gap"]) % 2 == 0)
        kept = F.filter(F.zip_with(placed(found), even, lambda s, e: F.struct(s.alias("s"), e.alias("e"))), lambda x: x["e"])
        return F.transform(F.slice(kept, 1, MOST["bare_url"]), lambda x: x["s"])

    pattern = regex(BARE_URL)
    counted = steps(text, pattern, lambda gap, match: [_ticks(gap).alias("in_gap"), _ticks(match).alias("in_match")])
    return F.when(text.rlike(pattern), let(counted, outside_code)).otherwise(no_spans())


def heading_jumps(text: Column) -> Column:
    """Headings more than one level below the heading before, in or out of code fences; the first never is."""
    level = lambda s: F.length(F.regexp_extract(s["excerpt"], "^#+", 0))
    jumps = lambda heads: F.filter(heads, lambda s, i: (i > 0) & (level(s) > level(F.get(heads, i - 1)) + 1))
    return F.slice(let(spans(text, regex(HEADING)), jumps), 1, MOST["heading_jump"])


def todos(text: Column) -> Column:
    found = F.transform(spans(text, regex(TODO, True)), lambda s: span(s["start"], s["end"], F.substring(s["excerpt"], 1, 80)))
    return F.slice(found, 1, MOST["todo_comment"])


CATEGORIES = [Category("formatting", "Formatting"), Category("accessibility", "Accessibility"), Category("hygiene", "Hygiene"), Category("style", "Style"), Category("links", "Links")]

RULES = [
    Rule("trailing_whitespace", "hygiene", "low", "A line ends in white space.", "Let the editor trim lines on save.", columns=trailing_whitespace, confidence=0.99),
    Rule("missing_alt_text", "accessibility", "high", "An image has no alternative text, so it cannot be read out.", "Say in the brackets what the image shows.", pattern=MISSING_ALT, ignore_case=False, confidence=0.95, closes=")"),
    Rule("bare_url", "links", "low", "A plain address stands in the prose.", "Give the link a text that tells where it leads.", columns=bare_urls),
    Rule("heading_jump", "formatting", "medium", "A heading skips a level of the outline.", "Go down one heading level at a time.", columns=heading_jumps, confidence=0.9),
    Rule("todo_comment", "hygiene", "medium", "An open task marker is left in the text.", "Settle it or file it before publishing.", columns=todos),
    Rule("lazy_link_text", "accessibility", "medium", "A link text does not say where it leads.", "Name the target in the link text.", pattern=LAZY_LINK, confidence=0.95, closes=")"),
    Rule("multiple_blank_lines", "hygiene", "low", "Several blank lines in a row.", "One blank line between blocks is enough.", pattern=BLANK_LINES, ignore_case=False),
]

TEMPLATES = [
    Template("readme-outline", "Project page outline", "docs", "Sections that a short project page needs.", "# Name\n\nOne sentence on what it does.\n\n## Install\n\n## Use\n\n## Limits\n"),
    Template("release-notes", "Release notes", "docs", "What changed and what to do about it.", "# Version\n\n## New\n\n## Changed\n\n## Fixed\n\n## How to move over\n"),
    Template("decision-record", "Decision record", "docs", "One decision with its reasons.", "# Title\n\n## Context\n\n## Decision\n\n## What follows from it\n"),
]


@dataclass
class MarkdownPack(Pack):
    name: str = "markdown"
    label: str = "Markdown"
    description: str = "Style, accessibility and hygiene of Markdown texts."
    file_extensions: tuple[str, ...] = (".md", ".mdx", ".markdown")
    categories: list[Category] = field(default_factory=lambda: list(CATEGORIES))
    rules: list[Rule] = field(default_factory=lambda: list(RULES))
    templates: list[Template] = field(default_factory=lambda: list(TEMPLATES))

    def detects(self, text: Column) -> Column:
        """A heading or fence at the start, or two of the markers anywhere."""
        markers = sum((text.contains(m).cast("int") for m in MARKERS), F.lit(0))
        return text.startswith("#") | text.startswith("```") | (markers >= 2)
