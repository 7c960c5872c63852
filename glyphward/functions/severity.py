"""Severities: low < medium < high < critical."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names from least to greatest, with the colour and glyph of reports.
SEVERITIES = ("low", "medium", "high", "critical")
COLOURS = {"low": "green", "medium": "yellow", "high": "orange3", "critical": "red"}
GLYPHS = {"low": "·", "medium": "▲", "high": "◆", "critical": "✖"}
RANKS = {name: i + 1 for i, name in enumerate(SEVERITIES)}


def rank(name: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in RANKS.items() for x in pair)), name)


def name_of(rank_: Column) -> Column:
    """The name of a rank; low for null, as without findings."""
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), F.coalesce(rank_, F.lit(1)))
