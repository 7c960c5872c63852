"""Running totals of each key over rows that are dealt to ranges, so that a key with a third of all rows lies in many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphward.llm.tables import save

# how totals of parts are put together, by the aggregate that makes them
COMBINE = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a.bitwiseXOR(b)}


def in_ranges(df: DataFrame, by: list, order: list, name: str = "ranged") -> DataFrame:
    """``df`` dealt to ranges of ``by`` and ordered in each by ``order``, with the number of the range and one that grows inside it; written to the shared folder."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(tasks, *by).sortWithinPartitions(*order)
    return save(ranged.withColumns({"range": F.spark_partition_id(), "nth": F.monotonically_increasing_id()}), name)


def running(ranged: DataFrame, key: str, totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """``ranged``, ordered by ``key`` first, with for each of ``totals`` (name -> aggregate, value) the running total over the rows of the key, the row's own included.

    Only the first and the last key of a range can lie in several, so what earlier ranges hold is at
    most two rows for each range; these are broadcast.
    """
    ends = ranged.groupBy("range").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    both = ends.select("range", F.explode(F.array_distinct(F.array("low", "high"))).alias(key))
    cut = both.groupBy(key).agg(F.count("*").alias("ranges")).where("ranges > 1").select(key)
    held = ranged.join(F.broadcast(cut), key).groupBy(key, "range").agg(*(getattr(F, kind)(value).alias(name) for name, (kind, value) in totals.items()))
    before = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = held.select(key, "range", *(F.coalesce(getattr(F, kind)(name).over(before), F.lit(0)).alias(f"__{name}") for name, (kind, _) in totals.items()))
    upto = Window.partitionBy(key, "range").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = {name: COMBINE[kind](getattr(F, kind)(value).over(upto), F.coalesce(F.col(f"__{name}"), F.lit(0))) for name, (kind, value) in totals.items()}
    return ranged.join(F.broadcast(earlier), [key, "range"], "left").withColumns(columns).drop(*(f"__{name}" for name in totals))
