"""Sharding by sampled splitters, with DataFrame functions only.

Records are put in the order of (digest of the text, id, row), which scatters sources evenly, keeps
equal texts side by side and tells repeated rows apart. A sample of keys is drawn, each with a
probability in proportion to its size; its quantiles split the order into fine ranges of about equal
bytes. The ranges are measured, and one that came out overfull is sampled again and subdivided,
until none is that can be cut. The bytes of all ranges, summed in order, then give the place of every
range, and a window inside each range that of every record; the shard is that place's share of all
bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphward.llm.tables import drop, save

DIGEST = 32  # characters of a digest in a key
NUMBER = 19  # digits of a number in a key
OVERHEAD = 16  # bytes a record adds to those of its text
RANGES_EACH = 16  # fine ranges in a shard, at least
RANGE_BYTES = 256 << 20  # of documents in a range at most, while there are no more than MOST_RANGES
MOST_RANGES = 1 << 16
SAMPLES_EACH = 24  # sampled keys in a range
OVERFULL = 2.0  # times the bytes wanted in a range, from which it is subdivided
WHOLE = 1 / 64  # of a shard: a group of equal texts up to this size is not cut


def records(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, digest, row): what sharding needs of each document; null text has no bytes."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )


def _key() -> Column:
    """Text of fixed width that orders as (digest, id, row), null ids first."""
    sign = F.when(F.col("doc_id") < 0, "0").otherwise("1")
    low = F.col("doc_id") - F.when(F.col("doc_id") < 0, F.lit(-(1 << 63))).otherwise(F.lit(0))
    identity = F.concat(sign, F.lpad(low.cast("string"), NUMBER, "0"))
    return F.concat("digest", F.coalesce(identity, F.lit(" " * (NUMBER + 1))), F.lpad(F.col("row").cast("string"), NUMBER, "0"))


def splitters(keyed: DataFrame, wanted: float, seed: int) -> list[str]:
    """Keys that cut every range of ``keyed`` (key, size, range) into parts of about ``wanted`` bytes: quantiles of a sample drawn in proportion to size.

    About SAMPLES_EACH keys for each part are drawn, whatever the number of records, and only the
    chosen quantiles come to the driver.
    """
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(SAMPLES_EACH / max(wanted, 1e-9)))
    drawn = keyed.where((F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)) < chance)
    # a record larger than a sample's share stands for all its bytes
    weight = F.greatest(F.lit(1.0), F.col("size") * F.lit(SAMPLES_EACH / max(wanted, 1e-9)))
    order = Window.partitionBy("range").orderBy("key")
    placed = drawn.select("range", "key", weight.alias("w")).withColumn("at", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    part, before = (F.floor(x / SAMPLES_EACH) for x in (F.col("at"), F.col("at") - F.col("w")))
    return [r["key"] for r in placed.where(part > before).select("key").orderBy("key").collect()]


def range_of(key: Column, cuts: list[str]) -> Column:
    """How many cuts are at most ``key``: a binary search over a literal array, in the order of the key's text."""
    if not cuts:
        return F.lit(0).cast("int")
    cut = F.split(F.lit(",".join(cuts)), ",")
    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))
    start = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        right = (s["low"] < s["high"]) & (F.element_at(cut, F.least(mid, F.lit(len(cuts) - 1)) + 1) <= key)
        return F.struct(
            F.when(right, mid + 1).otherwise(s["low"]).cast("int").alias("low"),
            F.when(right | (s["low"] >= s["high"]), s["high"]).otherwise(mid).cast("int").alias("high"),
        )

    return F.aggregate(steps, start, step, lambda s: s["low"])


def _checked(keyed: DataFrame, keys: list[str], hot: dict[str, bool], limit: float) -> list[str]:
    """``keys`` with every cut inside a group of equal texts moved to its start, unless the group has more than ``limit`` bytes.

    ``hot`` keeps what is known of groups that hold several cuts: at most two for each range.
    """
    inner: dict[str, int] = {}
    for k in keys:
        inner[k[:DIGEST]] = inner.get(k[:DIGEST], 0) + 1
    asked = [d for d, n in inner.items() if n > 1 and d not in hot]
    if asked:
        sums = keyed.where(F.col("digest").isin(asked)).groupBy("digest").agg(F.sum("size").alias("bytes"))
        hot.update({r["digest"]: r["bytes"] > limit for r in sums.collect()})
    return sorted({*(k for k in keys if hot.get(k[:DIGEST])), *inner})


def fine_ranges(keyed: DataFrame, total: int, shards: int) -> tuple[list[str], DataFrame, list[str]]:
    """(cuts, bytes by range, digests of groups that are cut): ranges that hold at most OVERFULL times the bytes wanted, as far as records and small groups of equal texts can be parted."""
    ranges = max(shards * RANGES_EACH, min(MOST_RANGES, total // RANGE_BYTES))
    wanted, limit = total / ranges, total * WHOLE / shards
    hot: dict[str, bool] = {}
    keys = splitters(keyed.withColumn("range", F.lit(0)), wanted, 17)
    cuts, seed = _checked(keyed, keys, hot, limit), 17
    while True:
        ranged = keyed.withColumn("range", range_of(F.col("key"), cuts))
        sums = save(ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "ranges")
        over = [r["range"] for r in sums.where((F.col("bytes") > OVERFULL * wanted) & (F.col("n") > 1)).select("range").collect()]
        seed += 1
        more = _checked(keyed, keys + splitters(ranged.where(F.col("range").isin(over)), wanted, seed), hot, limit) if over else cuts
        if more == cuts or seed > 40:
            return cuts, sums, [d for d, yes in hot.items() if yes]
        drop(sums)
        keys, cuts = more, more


def shard_by_bytes(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): every record's shard, of near equal bytes, and its slot there.

    Records go in order of (digest of the text, id, row), so equal texts are neighbours: a group of at
    most WHOLE of a shard stays in one shard, a larger one is cut between records. A shard's bytes
    differ from the mean by at most the largest record or such a group at either end. Slots count
    from 0 without gaps. Repeated rows each get a slot, also where a third of all rows repeat one id
    and text or have no id; null ids sort first in their group; extra columns are ignored; no rows
    give no rows.
    """
    keyed = save(records(docs).withColumn("key", _key()), "records")
    total = int(keyed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total")).first()["total"])
    cuts, sums, hot = fine_ranges(keyed, total, shards)
    # written, as the optimizer would carry the search for the range into the table of ranges
    ranged = save(keyed.withColumn("range", range_of(F.col("key"), cuts)), "ranged")
    drop(keyed)

    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("range_start"))
    inside, group = Window.partitionBy("range").orderBy("key"), Window.partitionBy("range", "digest")
    end = F.col("range_start") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = ranged.join(F.broadcast(starts), "range").withColumn("end", end)  # a row for each range
    placed = placed.withColumn("group_bytes", F.sum("size").over(group)).withColumn("group_end", F.max("end").over(group))
    # what is cut holds more than one cut, so more than the limit; all other groups lie in one range
    whole = (F.col("group_bytes") <= F.lit(total * WHOLE / shards)) & ~(F.col("digest").isin(hot) if hot else F.lit(False))
    middle = F.when(whole, F.col("group_end") - F.col("group_bytes") / 2).otherwise(F.col("end") - F.col("size") / 2)
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(max(total, 1)))).cast("int")
    dealt = save(placed.select("doc_id", "size", "text_crc32", "key", "range", shard.alias("shard")), "dealt")
    drop(ranged, sums)

    counts = dealt.groupBy("shard", "range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("shard").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("range", "shard").orderBy("key")) - 1
    out = dealt.withColumn("nth", nth).join(F.broadcast(offsets), (F.col("shard") == F.col("s")) & (F.col("range") == F.col("r")))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
