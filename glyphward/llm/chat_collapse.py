"""Cumulative-snapshot collapse of logged conversations, then rendering.

A chat client that logs the whole conversation after every turn leaves many snapshots, each a
prefix of the next. Every turn gets the hash of all turns up to it; a conversation whose hash of
all turns is that of a proper prefix of a longer one is dropped by an anti-join, and of equal
conversations the one with the smallest id stays.

Turns are dealt to ranges of (conversation, turn), so that a conversation which holds a third of all
turns lies in many. Running hashes are taken inside each range; what the earlier ranges of a cut
conversation hold is put in front.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphward.llm.tables import drop, save

KEY = 64  # characters of a text by which turns that are alike in all else are dealt to ranges


def dealt(turns: DataFrame) -> DataFrame:
    """``turns`` in the order of (conv_id, turn, role, text), with the number of their range, one that grows inside it, and two 64-bit hashes of (role, text); written to the shared folder.

    What follows reads texts for rendering only.
    """
    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = turns.repartitionByRange(tasks, "conv_id", "turn", "role", F.substring("text", 1, KEY)).sortWithinPartitions("conv_id", "turn", "role", "text")
    # whether a column is null is hashed beside it: no text stands for a null
    parts = [c for x in ("role", "text") for c in (F.col(x).isNull(), F.coalesce(F.col(x), F.lit("")))]
    return save(ranged.withColumns({"range": F.spark_partition_id(), "nth": F.monotonically_increasing_id(), "h1": F.xxhash64(*parts), "h2": F.xxhash64(F.lit(1), *parts)}), "turns")


def cut_conversations(ranged: DataFrame) -> DataFrame:
    """(conv_id, range, last_range, places, a, b) of conversations in more than one range: the number of turns in earlier ranges and the two hashes of these.

    Only the first and the last conversation of a range can be cut, so there are at most two rows for each range.
    """
    ends = ranged.groupBy("range").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high"))
    both = ends.select("range", F.explode(F.array_distinct(F.array("low", "high"))).alias("conv_id"))
    cut = both.groupBy("conv_id").agg(F.max("range").alias("last_range"), F.count("*").alias("ranges")).where("ranges > 1").drop("ranges")
    inside = ranged.join(F.broadcast(cut), "conv_id")
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda total: F.coalesce(total.over(before), F.lit(0))
    counts = inside.groupBy("conv_id", "range", "last_range").agg(F.count("*").alias("n"))
    starts = save(counts.select("conv_id", "range", "last_range", earlier(F.sum("n")).alias("places")), "starts")
    sums = _placed(ranged, starts, "inner").groupBy("conv_id", "range", "last_range", "places").agg(F.bit_xor("one").alias("one"), F.bit_xor("two").alias("two"))
    cuts = save(sums.select("conv_id", "range", "last_range", "places", earlier(F.bit_xor("one")).alias("a"), earlier(F.bit_xor("two")).alias("b")), "cuts")
    drop(starts)
    return cuts


def _order() -> Window:
    return Window.partitionBy("conv_id", "range").orderBy("nth")


def _placed(ranged: DataFrame, cuts: DataFrame, how: str) -> DataFrame:
    """``ranged`` with the columns of ``cuts``, the place of each turn in its conversation, from 1, and two 64-bit hashes of (place, role, text)."""
    held = ranged.select("conv_id", "range", "nth", "h1", "h2").join(F.broadcast(cuts), ["conv_id", "range"], how)
    placed = held.withColumn("place", F.row_number().over(_order()) + F.coalesce("places", F.lit(0)))
    return placed.withColumns({"one": F.xxhash64("place", "h1", "h2"), "two": F.xxhash64(F.lit(1), "place", "h1", "h2")})


def prefix_hashes(ranged: DataFrame) -> DataFrame:
    """(conv_id, place, prefix, last): the hash of the turns up to each place, from 1, and whether it is the last.

    The prefix hash is the running exclusive-or of two 64-bit hashes of (place, role, text): the
    place makes it depend on the order. Places are ranks of (turn, role, text) in the conversation.
    """
    placed = _placed(ranged, cut_conversations(ranged), "left")
    running = _order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = lambda h, earlier: F.bit_xor(h).over(running).bitwiseXOR(F.coalesce(earlier, F.lit(0)))
    return placed.select(
        "conv_id",
        "place",
        F.struct(upto("one", "a").alias("a"), upto("two", "b").alias("b")).alias("prefix"),
        (F.lead("place").over(_order()).isNull() & (F.col("range") == F.coalesce("last_range", "range"))).alias("last"),
    )


def maximal_conversations(ranged: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies): conversations that are no proper prefix of another, one of each set of equal ones.

    Both sides of the anti-join have one row for each distinct hash: a first turn or a conversation
    that a third of all logs share is combined before the shuffle.
    """
    hashes = prefix_hashes(ranged)
    whole = hashes.where("last").groupBy("place", "prefix").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    proper = hashes.where(~F.col("last")).select("place", "prefix").distinct()
    kept = whole.join(proper, ["place", "prefix"], "left_anti")
    return kept.select("conv_id", F.col("place").cast("long").alias("n_turns"), "copies")


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies, text): each kept conversation in turn order, ``<|role|>`` before and ``<|end|>`` after each text."""
    line = lambda x: F.concat(F.lit("<|"), F.coalesce(x["role"], F.lit("")), F.lit("|>\n"), F.coalesce(x["text"], F.lit("")), F.lit("<|end|>\n"))
    part = turns.withColumnRenamed("conv_id", "of").join(kept, F.col("of") == kept.conv_id)
    whole = part.groupBy(kept.conv_id, "n_turns", "copies").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return whole.select("conv_id", "n_turns", "copies", F.array_join(F.transform("turns", line), "").alias("text"))


def collapse_and_render(conversations: DataFrame) -> DataFrame:
    """Rendered maximal conversations: (conv_id, n_turns, copies, text), copies counting the equal logs.

    ``conversations`` has conv_id, turn, role and text. Rows with a null conv_id belong to no
    conversation and are left out. Turns with equal numbers are ordered by role and text, nulls
    first; exactly repeated rows count once; null roles and texts differ from empty ones but render
    as empty. Extra columns are ignored; no rows give no rows.
    """
    turns = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text").distinct()
    ranged = dealt(turns)
    return render(ranged, maximal_conversations(ranged))
