"""Prefix trie of conversations, by Patricia construction.

A node is a sequence of first turns; it is told by its depth and a running 128-bit hash of its turns.
Most nodes have one child and the same members as it, so the tree is built without them:

1. distinct conversations are sorted by their paths of prefix hashes; what two neighbours have in
   common ends at a branch, so the branches are found from one comparison for each conversation;
2. points are the branches and the ends of conversations, leaves among them; an edge holds the
   lengths of the turns between a point and the point above;
3. members, children, leaves and sums of subtrees are computed for points only, each by adding up
   what the conversations below it carry;
4. nodes inside edges are then expanded from their point by suffix sums over the edge.

Paths are cut into segments of SEGMENT turns, whose ends are points too, so no row grows with a
conversation; turns are dealt to ranges, so no task does either.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphward.llm.ranges import in_ranges, running
from glyphward.llm.tables import drop, save

SEGMENT = 64  # turns
TEXT_KEY = 64  # characters of a text by which turns that are alike in all else are dealt to ranges
IDS = 1 << 16  # conversation ids that are written out together
NODE = ["depth", "a", "b"]
SEG = ["seg_depth", "seg_a", "seg_b"]
BEFORE_ALL = (Window.unboundedPreceding, -1)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, h1, h2, chars): the turns of each conversation in order, with two hashes of (role, text) and the code points of the text.

    Turns are ordered by number, nulls first, and equal numbers by role and text; null roles and
    texts count as empty. Written to the shared folder.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", empty("role"), empty("text"))
    ranged = turns.withColumn("head", F.substring("text", 1, TEXT_KEY))
    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ranged.repartitionByRange(tasks, "conv_id", "turn", "role", "head").sortWithinPartitions("conv_id", "turn", "role", "text")
    hashed = ranged.select("conv_id", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "role", "text").alias("h2"), F.length("text").cast("long").alias("chars"), F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("nth"))
    kept = save(hashed, "turns")
    out = save(running(kept, "conv_id", {"place": ("sum", F.lit(1))}).drop("range", "nth"), "numbered")
    drop(kept)
    return out


def rebuilt_turns(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, place, h1, h2, chars) of conversations that open as the first of their group does, and the ids of all.

    The first h turns of conversation c - c % group, h = crc32(c) % most, stand before c's own turns
    after its first h; a missing one gives none.
    """
    c = F.col("conv_id")
    h = F.crc32(c.cast("string").cast("binary")) % most
    opening = save(turns.where((c % group == 0) & (F.col("place") < most)), "openings")
    given = opening.groupBy(c.alias("first")).agg(F.max("place").alias("given"))
    ids = turns.select("conv_id").distinct().withColumns({"first": c - c % group, "h": h})
    ids = save(ids.join(given, "first", "left").select("conv_id", "first", "h", F.least("h", F.coalesce("given", F.lit(0))).alias("given")), "ids")
    heads = ids.where("given > 0").join(opening.withColumnRenamed("conv_id", "first"), "first").where("place <= h").select("conv_id", "place", "h1", "h2", "chars")
    own = turns.where(F.col("place") > h).join(ids.select("conv_id", "given").hint("merge"), "conv_id")
    tails = own.select("conv_id", (F.col("place") - h + F.col("given")).alias("place"), "h1", "h2", "chars")
    out = in_ranges(heads.unionByName(tails), ["conv_id", "place"], ["conv_id", "place"], "rebuilt")
    known = save(ids.select("conv_id"), "known")
    drop(opening, ids)
    return out, known


def _segments(ranged: DataFrame) -> DataFrame:
    """(conv_id, j, path, start): the prefixes of each conversation as (depth, a, b, chars), SEGMENT in a row, and the prefix before them."""
    hashes = {"one": F.xxhash64("place", "h1", "h2"), "two": F.xxhash64(F.lit(1), "place", "h1", "h2")}
    upto = running(ranged.withColumns(hashes), "conv_id", {"a": ("bit_xor", F.col("one")), "b": ("bit_xor", F.col("two"))})
    step = F.struct(F.col("place").cast("long").alias("depth"), "a", "b", "chars")
    before = F.struct((F.col("place") - 1).cast("long").alias("depth"), F.col("a").bitwiseXOR(F.col("one")).alias("a"), F.col("b").bitwiseXOR(F.col("two")).alias("b"))
    rows = upto.select("conv_id", F.floor((F.col("place") - 1) / SEGMENT).alias("j"), "place", step.alias("step"), before.alias("before"))
    return rows.groupBy("conv_id", "j").agg(F.sort_array(F.collect_list("step")).alias("path"), F.min_by("before", "place").alias("start"))


def _common(before: Column, row: Column) -> Column:
    """Length of what the paths of two segments have in common."""
    same = F.zip_with(before["path"], row["path"], lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]))
    return F.when(before["start"] == row["start"], F.size(F.filter(same, lambda x: x))).otherwise(0)


def _branches(segments: DataFrame) -> DataFrame:
    """Nodes at which neighbours in the order of paths part, but for the starts of segments."""
    whole = F.struct("start", "path")
    order = ["start", F.transform("path", lambda x: F.struct(x["a"], x["b"]))]
    ranged = in_ranges(segments.select("start", "path"), order, order, "sorted")
    inside = ranged.select("path", _common(F.lag(whole).over(Window.partitionBy("range").orderBy("nth")), whole).alias("common"))
    ends = ranged.groupBy("range").agg(F.min_by(whole, "nth").alias("first"), F.max_by(whole, "nth").alias("last"))  # a row for each range
    between = ends.select("first", F.lag("last").over(Window.orderBy("range")).alias("before")).select("first.path", _common(F.col("before"), F.col("first")).alias("common"))
    at = F.get("path", (F.col("common") - 1).cast("int"))
    found = inside.unionByName(between).where("common > 0").select(at.alias("x")).select(*(f"x.{c}" for c in NODE)).distinct()
    out = save(found, "branches")
    drop(ranged)
    return out


def _on_paths(segments: DataFrame, branches: DataFrame) -> DataFrame:
    """A row for each segment and each point on it: the point, the point above, the lengths of the turns of the edge between them, and what the segment carries.

    The start of a first segment, the root, is on it; the starts of others are the ends of the
    segments before.
    """
    steps = segments.select(*SEG, F.posexplode("path").alias("pos", "x")).select(*SEG, "pos", *(f"x.{c}" for c in NODE))
    cut = steps.join(branches.hint("merge"), NODE, "left_semi").groupBy(*SEG).agg(F.collect_list("pos").alias("cuts"))
    last = F.size("path") - 1
    cuts = F.sort_array(F.array_distinct(F.concat(F.coalesce("cuts", F.array().cast("array<int>")), F.when(last >= 0, F.array(last)).otherwise(F.array().cast("array<int>")))))
    whole = segments.join(cut.hint("merge"), SEG, "left").withColumn("cuts", cuts)
    node = lambda x: F.struct(x["depth"].alias("depth"), x["a"].alias("a"), x["b"].alias("b"))
    edges = F.transform(
        "cuts",
        lambda at, i: F.struct(
            node(F.get("path", at)).alias("point"),
            F.when(i > 0, node(F.get("path", F.get("cuts", i - 1)))).otherwise(F.col("start")).alias("above"),
            F.transform(F.slice("path", F.coalesce(F.get("cuts", i - 1), F.lit(-1)) + 2, at - F.coalesce(F.get("cuts", i - 1), F.lit(-1))), lambda x: x["chars"]).alias("edge"),
        ),
    )
    nothing = F.lit(None).cast("struct<depth:bigint,a:bigint,b:bigint>")
    root = F.array(F.struct(F.col("start").alias("point"), nothing.alias("above"), F.array(F.lit(0).cast("long")).alias("edge")))
    every = F.when(F.col("start.depth") == 0, F.concat(root, edges)).otherwise(edges)
    rows = whole.select(*SEG, "weight", "least", F.explode(every).alias("e"))
    above = [F.col(f"e.above.{c}").alias(f"above_{c}") for c in NODE]
    return save(rows.select(*SEG, "weight", "least", *(f"e.point.{c}" for c in NODE), *above, "e.edge"), "paths")


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256): of each node at which conversations end, the SHA-256 of their ids, ascending, joined by commas.

    Ids are written out in ranges, so that the one task that a digest takes reads a row for IDS of them.
    """
    tasks = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, []

        def row() -> pa.RecordBatch:
            columns = [*(pa.array([x], pa.int64()) for x in (*now, ids[0])), pa.array([",".join(map(str, ids))], pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=[*NODE, "first", "ids"])

        for b in batches:
            for *node, conv_id in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if ids and (node != now or len(ids) == IDS):
                    yield row()
                    ids = []
                now = node
                ids.append(conv_id)
        if ids:
            yield row()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, rows = None, None, []

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns[:3]), pa.array(columns[3], pa.string())], names=[*NODE, "ends_sha256"])

        for b in batches:
            for *node, _, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if node == now:
                    sha.update(b"," + ids.encode())
                    continue
                if now:
                    rows.append((*now, sha.hexdigest()))
                now, sha = node, hashlib.sha256(ids.encode())
                if len(rows) >= 10_000:
                    yield out()
                    rows.clear()
        if now:
            rows.append((*now, sha.hexdigest()))
        if rows:
            yield out()

    ordered = ends.select(*NODE, "conv_id").repartitionByRange(tasks, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    chunks = ordered.mapInArrow(written, "depth long, a long, b long, first long, ids string")
    return chunks.repartition(tasks, *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digested, "depth long, a long, b long, ends_sha256 string")


def trie(ranged: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): every node of the conversations ``conv_ids`` whose turns are in ``ranged`` (see :func:`rebuilt_turns`)."""
    segments = save(_segments(ranged), "segments")
    last = segments.groupBy("conv_id").agg(F.max_by(F.element_at("path", -1), "j").alias("x"))
    of_last = [F.coalesce(F.col(f"x.{c}"), F.lit(0).cast("long")).alias(c) for c in NODE]
    ends = save(conv_ids.join(last.hint("merge"), "conv_id", "left").select("conv_id", *of_last), "ends")
    # equal conversations are one from here on
    tops = save(ends.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight")), "tops")
    origin = F.struct(*(F.lit(0).cast("long").alias(c) for c in NODE))
    turnless = tops.where("depth = 0").select("conv_id", F.lit(0).cast("long").alias("j"), F.array().cast(segments.schema["path"].dataType).alias("path"), origin.alias("start"), "weight")
    held = segments.join(tops.select("conv_id", "weight").hint("merge"), "conv_id").unionByName(turnless)
    seg = [F.coalesce(F.get("path", F.size("path") - 1)[c], F.lit(0).cast("long")).alias(s) for c, s in zip(NODE, SEG, strict=True)]
    held = save(held.select("conv_id", "j", "weight", "path", "start", *seg), "held")
    distinct = save(held.groupBy(*SEG).agg(F.any_value("path").alias("path"), F.any_value("start").alias("start"), F.sum("weight").alias("weight"), F.min("conv_id").alias("least")), "distinct")
    branches = _branches(distinct.where(F.size("path") > 0))
    paths = _on_paths(distinct, branches)

    above = [f"above_{c}" for c in NODE]
    points = paths.groupBy(*NODE).agg(F.sum("weight").alias("n_convs"), F.min("least").alias("conv_id"), F.any_value("edge").alias("edge"), *(F.any_value(c).alias(c) for c in above))
    points = save(points.withColumn("saved_edge", (F.col("n_convs") - 1) * F.aggregate("edge", F.lit(0).cast("long"), lambda s, x: s + x)), "points")
    children = points.where("depth > 0").groupBy(*(F.col(f"above_{c}").alias(c) for c in NODE)).agg(F.count("*").alias("n_children"))
    with_children = save(points.join(children.hint("merge"), NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "points")

    leaves = tops.join(with_children.where("n_children = 0").select(*NODE).hint("merge"), NODE, "left_semi").select("conv_id")
    seg_leaves = held.join(leaves.hint("merge"), "conv_id", "left_semi").groupBy(*SEG).agg(F.count("*").alias("leaves"))
    # what an edge saves is counted once, on the path of the point's first member
    owned = paths.select(*SEG, "least", *NODE).join(points.select(*NODE, "conv_id", "saved_edge").hint("merge"), NODE)
    owned = save(owned.select(*SEG, "least", *NODE, F.when(F.col("conv_id") == F.col("least"), F.col("saved_edge")).otherwise(0).alias("own")), "owned")
    of_segment = owned.groupBy(*SEG, F.col("least").alias("conv_id")).agg(F.sum("own").alias("own"))
    long_ones = segments.where("j > 0").select("conv_id").distinct()
    parts = held.join(long_ones.hint("merge"), "conv_id", "left_semi").select("conv_id", "j", *SEG).join(of_segment.hint("merge"), ["conv_id", *SEG], "left")
    parts = parts.withColumns({"own": F.coalesce("own", F.lit(0)), "back": -F.col("j")})
    later = running(in_ranges(parts, ["conv_id", "back"], ["conv_id", "back"], "parts"), "conv_id", {"total": ("sum", F.col("own"))})
    seg_later = later.groupBy(*SEG).agg(F.sum(F.col("total") - F.col("own")).alias("later"))

    below = F.coalesce(F.sum("own").over(Window.partitionBy(*SEG).orderBy(F.desc("depth")).rowsBetween(*BEFORE_ALL)), F.lit(0))  # SEGMENT rows at most, and the root
    carried = owned.withColumn("below", below).join(seg_leaves.hint("merge"), SEG, "left").join(seg_later.hint("merge"), SEG, "left")
    sums = carried.groupBy(*NODE).agg(F.sum("leaves").alias("n_leaves"), F.sum(F.col("below") + F.coalesce("later", F.lit(0))).alias("below"))
    parents = with_children.select(*(F.col(c).alias(f"above_{c}") for c in NODE), F.col("conv_id").alias("parent_conv_id"))
    full = with_children.join(sums.hint("merge"), NODE).join(parents.hint("merge"), above, "left").join(ends_digests(ends).hint("merge"), NODE, "left")
    return _expanded(full)


def _expanded(points: DataFrame) -> DataFrame:
    """A row for each node: those inside an edge have the members and leaves of its point, one child, and suffix sums of the edge."""
    size = F.size("edge")
    rest = lambda i: F.aggregate(F.slice("edge", i + 1, size), F.lit(0).cast("long"), lambda s, x: s + x)
    nodes = F.transform("edge", lambda _, i: F.struct(i.alias("i"), rest(i).alias("rest")))
    rows = points.withColumn("node", F.explode(nodes))
    i = F.col("node.i")
    whole = lambda point, inside: F.when(i == size - 1, point).otherwise(inside)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return rows.select(
        "conv_id",
        (F.col("depth") - (size - 1 - i)).cast("long").alias("depth"),
        F.when(i == 0, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        whole(F.col("n_children"), F.lit(1).cast("long")).alias("n_children"),
        "n_leaves",
        (F.col("below") + (F.col("n_convs") - 1) * F.col("node.rest")).alias("saved_tokens"),
        whole(F.coalesce("ends_sha256", nothing), nothing).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (see :func:`rebuilt_turns` and :func:`trie`), the root included.

    ``conversations`` has conv_id, turn, role and text. Rows with a null conv_id belong to no
    conversation and are left out; null roles and texts count as empty; turns of equal number are
    ordered by role and text; repeated rows are turns of their own; a conversation that is left
    without turns ends at the root; extra columns are ignored; no rows give no nodes.
    """
    turns = numbered_turns(conversations)
    return trie(*rebuilt_turns(turns, group, most))


def plain_trie(conversations: DataFrame) -> DataFrame:
    """As :func:`conversation_trie` of the conversations as they are."""
    turns = numbered_turns(conversations)
    return trie(in_ranges(turns, ["conv_id", "place"], ["conv_id", "place"], "rebuilt"), turns.select("conv_id").distinct())
