"""Which message of a trace or conversation a finding stands in.

Spans count in the joined text, so messages are ranges of it: their running offsets. Findings and
ranges meet by an equality of bins, no matter how many there are of either: a range lies in each bin
that it touches, a finding in the bin of its start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphward.functions.text import running
from glyphward.operators.scanning import explode_findings
from glyphward.sources.traces import SEPARATOR, trace_messages

BIN = 1_024  # characters


def message_ranges(traces: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, message, role, start, end): where each message stands in the joined text of its trace; message -1 is the raw trace itself."""
    parts = traces.select(key, trace_messages(F.coalesce(F.col(text_col), F.lit(""))).alias("parts"))
    starts = F.when(F.size("parts") > 0, running(F.transform("parts", lambda p: F.length(p["text"]) + len(SEPARATOR)))).otherwise(F.array().cast("array<int>"))
    placed = F.zip_with("parts", starts, lambda p, at: F.struct(p["message"].alias("message"), p["role"].alias("role"), at.alias("start"), (at + F.length(p["text"])).alias("end")))
    return parts.select(key, F.explode(placed).alias("r")).select(key, "r.*")


def within_ranges(points: DataFrame, ranges: DataFrame, key: str, at: str, width: int = BIN) -> DataFrame:
    """``points`` with the columns of the range of ``ranges`` (key, start, end and others) that holds ``at``; nulls where none does. Ranges of a key do not overlap; empty ones hold nothing."""
    others = [c for c in ranges.columns if c != key]
    binned = ranges.where("end > start").withColumn("__bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    named = binned.select(F.col(key).alias("__key"), "__bin", *(F.col(c).alias(f"__r_{c}") for c in others))
    place = points.withColumn("__at_bin", F.floor(F.col(at) / width))
    inside = (place[key] == named["__key"]) & (place["__at_bin"] == named["__bin"]) & (place[at] >= named["__r_start"]) & (place[at] < named["__r_end"])
    return place.join(named, inside, "left").select(*points.columns, *(F.col(f"__r_{c}").alias(f"range_{c}") for c in others))


def findings_by_message(scanned: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The findings of ``scanned`` (see :func:`glyphward.sources.traces.scan_trace`), a row each, with message, role, start_in_message and crosses: whether it goes on beyond the message that it begins in.

    A null key's findings are in no message. Raw trace text is message -1, without a role.
    """
    found = explode_findings(scanned, key)
    placed = within_ranges(found, message_ranges(scanned, key, text_col), key, "start")
    return placed.withColumns({"start_in_message": F.col("start") - F.col("range_start"), "crosses": F.col("end") > F.col("range_end")}).withColumnsRenamed({"range_message": "message_nth", "range_role": "role"}).drop("range_start", "range_end")
