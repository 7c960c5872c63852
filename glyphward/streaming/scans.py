"""A scan keeps no state, so it runs on a stream as it does on a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphward.functions.severity import name_of, rank
from glyphward.operators.rules import PackLike
from glyphward.operators.scanning import explode_findings, scan


def scan_stream(stream: DataFrame, pack: PackLike | str | None = None, text_col: str = "text", force_optional: Column | bool = False) -> DataFrame:
    """As :func:`glyphward.operators.scanning.scan`."""
    return scan(stream, pack, text_col, force_optional)


def findings_per_window(scanned: DataFrame, time_col: str, length: str, late: str, slide: str | None = None) -> DataFrame:
    """(start, end, id, severity, n): findings in windows of event time; rows later than ``late`` are dropped."""
    rows = explode_findings(scanned.withWatermark(time_col, late), time_col)
    window = F.window(time_col, length, slide) if slide else F.window(time_col, length)
    return rows.groupBy(window.alias("w"), "id", "severity").agg(F.count("*").alias("n")).select("w.start", "w.end", "id", "severity", "n")


def to_parquet(scanned: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append scanned rows to a Parquet folder, exactly once; ``once`` takes what there is and ends."""
    writer = scanned.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def findings_per_session(scanned: DataFrame, key: str, time_col: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n, rules, worst): bursts of findings of one key, between which nothing is found for ``gap``; rows later than ``late`` are dropped. A batch of rows gives the same sessions."""
    rows = explode_findings(scanned.withWatermark(time_col, late), key, time_col)
    burst = F.session_window(time_col, gap)
    n = rows.groupBy(key, burst.alias("w")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("id")).alias("rules"), F.max(rank(F.col("severity"))).alias("worst"))
    return n.select(key, "w.start", "w.end", "n", "rules", name_of(F.col("worst")).alias("worst"))


def to_latest(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Take what there is and replace the folder by the aggregates so far, in each batch whole."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return rows.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
