"""Scans over time: what held at a moment, and which findings came and went between two versions of the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str) -> DataFrame:
    """``left`` with the other columns of the latest row of ``right`` with the same keys whose ``at`` is not later than its own; nulls where there is none.

    One sort of both by key and time instead of a join by inequality. Of rows of ``right`` with equal
    keys and times one counts. Rows of ``left`` with a null key or time stay and match nothing.
    """
    others = [c for c in right.columns if c not in (*keys, at)]
    held = F.struct(*others)
    nothing = F.lit(None).cast(right.select(held.alias("x")).schema["x"].dataType)
    own = left.select(*keys, at, F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), nothing.alias("__held"))
    row = F.lit(None).cast(own.schema["__row"].dataType)
    known = right.where(F.col(at).isNotNull()).select(*keys, at, F.lit(0).alias("__side"), row.alias("__row"), held.alias("__held"))
    window = Window.partitionBy(*keys).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = F.col(at).isNotNull()
    for k in keys:
        full = full & F.col(k).isNotNull()
    last = own.unionByName(known).withColumn("__held", F.when(full, F.last("__held", ignorenulls=True).over(window))).where("__side = 1")
    return last.select("__row.*", *(F.col(f"__held.{c}").alias(c) for c in others))


def findings_changed(before: DataFrame, after: DataFrame, *by: str) -> DataFrame:
    """(by, n_before, n_after, gone, appeared, kept): the findings of two scans that differ, counted by ``by``, which tell what is the same finding. One shuffle: both sides are counted before they meet."""
    sides = before.select(*by, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select(*by, F.lit(0).alias("b"), F.lit(1).alias("a")))
    n = sides.groupBy(*by).agg(F.sum("b").alias("n_before"), F.sum("a").alias("n_after"))
    return n.withColumns({"gone": F.greatest(F.col("n_before") - F.col("n_after"), F.lit(0)), "appeared": F.greatest(F.col("n_after") - F.col("n_before"), F.lit(0)), "kept": F.least("n_before", "n_after")})
