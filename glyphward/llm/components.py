"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphward.llm.tables import drop, save


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """One star step over edges (hi, lo), hi > lo.

    ``both`` (large star): every node hands its larger neighbours the smallest node that it
    sees; otherwise (small star) its smaller neighbours, and itself. The least neighbour of
    each node is a combinable minimum, kept as a table, so both sides of the join that follows
    are plain exchanges: adaptive execution can split a hub with very many edges.
    """
    if both:
        seen = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    else:
        seen = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    least = save(seen.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
    pairs = seen.join(least, "u")
    if both:
        out = pairs.where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        out = pairs.select(F.col("v").alias("hi"), F.col("m").alias("lo")).union(least.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
    done = save(out.where("hi > lo").distinct(), "edges")
    drop(least)
    return done


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node hangs below one root only, and no root below another."""
    if not edges.groupBy("hi").count().where("count > 1").isEmpty():
        return False
    return edges.select("lo").distinct().join(edges.select(F.col("hi").alias("lo")), "lo", "left_semi").isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge.

    Large-star and small-star steps alternate until neither changes the edges; the number of
    rounds grows with the logarithm of the longest chain. Every round is written to the shared
    folder. An empty edge table gives an empty result; self-loops and repeats are ignored.
    """
    now = save(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi > lo").distinct(), "edges")
    mark = None
    while True:
        wide = _star(now, both=True)
        drop(now)
        now = _star(wide, both=False)
        drop(wide)
        seen = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.col("lo").cast("decimal(38,0)"))).first())
        if mark == seen or _is_forest_of_stars(now):
            break
        mark = seen
    out = now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
    out.kept_at = now.kept_at  # what :func:`drop` deletes once the result has been read
    return out
