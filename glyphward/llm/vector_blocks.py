"""Searching a stated query set against all vectors, in tasks of a run of blocks and a group of queries.

Vectors and queries are packed where they lie into blocks of bounded bytes. A task gets one group of
queries and the blocks of one run; it holds the queries, builds the index of one block after the
other, and keeps the best rows of each query over all of its blocks. So no task grows with either
table, and what goes on to the window that keeps the best of all is ``k`` rows of a query for each
run of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PACKED = "number long, side int, dims int, ids binary, data binary"
PACKED_BYTES = 4 << 20  # of vectors in a packed row
BLOCK_BYTES = 32 << 20  # of vectors that are indexed together
RUN = 8  # blocks in a task at most
GROUP = 4_096  # queries in a task at most
LEAST_GROUP = 64  # queries below which a group is not divided to keep all cores busy
TASKS = 50_000  # partitions at most; one may hold several tasks, taken in turn


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of the rows that take part: an id, and a vector without null or non-finite components. Empty vectors take no part."""
    x = F.col(embedding)
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = vectors.where(F.col(vec_id).isNotNull() & x.isNotNull() & (F.size(x) > 0) & fit)
    return kept.select(F.col(vec_id).cast("long").alias("vec_id"), (x if "float" in dict(vectors.dtypes)[embedding] else x.cast("array<double>")).alias("embedding"))


def rows_of(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a list column with ``dims`` components each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _pack(side: int, most: int) -> Callable:
    """Pack the rows of a partition into rows of at most ``most`` vectors and PACKED_BYTES, by number of components."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def row(dims: int, ids: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
            nonlocal nth
            values = ([part + nth], [side], [dims], [ids.tobytes()], [data.tobytes()])
            nth += 1
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["number", "side", "dims", "ids", "data"])

        for b in batches:
            ids, lists = b.column(0).to_numpy(), b.column(1)
            sizes = lists.value_lengths().to_numpy()
            for dims in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dims)
                own = lists if len(at) == len(sizes) else lists.take(pa.array(at))
                parts = held.setdefault(dims, [])
                parts.append((ids[at], rows_of(own, dims)))
                full = max(1, min(most, PACKED_BYTES // (8 * dims)))
                if sum(len(p[0]) for p in parts) >= full:
                    all_ids, all_data = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
                    end = len(all_ids) - len(all_ids) % full
                    for begin in range(0, end, full):
                        yield row(dims, all_ids[begin : begin + full], all_data[begin : begin + full])
                    parts[:] = [(all_ids[end:], all_data[end:])]
        for dims, parts in held.items():
            all_ids, all_data = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            if len(all_ids):
                yield row(dims, all_ids, all_data)

    return pack


@dataclass
class Found:
    """Rows found for a query, best first: ids, scores, and another number of each row."""

    ids: np.ndarray
    score: np.ndarray
    extra: np.ndarray

    def merged(self, other: Found, k: int) -> Found:
        ids, score, extra = (np.concatenate(p) for p in ((self.ids, other.ids), (self.score, other.score), (self.extra, other.extra)))
        order = np.lexsort((ids, -score))[:k]
        return Found(ids[order], score[order], extra[order])


Build = Callable[[np.ndarray, np.ndarray], Any]
Search = Callable[[Any, int, np.ndarray, Found | None], Found]


def block_search(vectors: DataFrame, queries: DataFrame, build: Build, search: Search, k: int, score: str, block_rows: int) -> DataFrame:
    """(query_id, vec_id, score, extra): the ``k`` best rows of each query in each run of blocks.

    ``build(ids, vectors)`` makes the index of a block; ``search(index, query id, query, found)``
    gives its best rows, where ``found`` are those of the blocks before. Only vectors with as many
    components as the query meet it. ``vectors`` and ``queries`` are of :func:`usable`; ``score`` is
    the type of the scores.
    """
    wire = vectors.schema["embedding"].dataType.elementType.typeName()
    kind = "<f4" if wire == "float" else "<f8"
    n_blocks = max(1, -(-vectors.count() // block_rows))
    n_queries = max(1, queries.count())
    wanted = 3 * vectors.sparkSession.sparkContext.defaultParallelism  # tasks, so that no core waits for a single one
    groups = -(-n_queries // GROUP)
    runs = min(n_blocks, max(-(-n_blocks // RUN), -(-wanted // groups)))
    groups = max(groups, min(-(-n_queries // LEAST_GROUP), -(-wanted // runs)))

    def all_of(n: int) -> Any:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    packed = vectors.mapInArrow(_pack(0, block_rows), PACKED).withColumn("run", F.col("number") % runs).withColumn("group", all_of(groups))
    asked = queries.mapInArrow(_pack(1, -(-n_queries // groups)), PACKED).withColumn("group", F.col("number") % groups).withColumn("run", all_of(runs))
    task = F.col("run") * groups + F.col("group")
    tasks = min(TASKS, runs * groups)
    columns = ("task", "side", "dims", "ids", "data")
    dealt = packed.withColumn("task", task).select(*columns).unionByName(asked.withColumn("task", task).select(*columns))
    dealt = dealt.repartitionById(tasks, (F.col("task") % tasks).cast("int")).sortWithinPartitions("task", F.desc("side"), "dims")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, best, asked_of, waiting = None, {}, {}, {}

        def look(dims: int) -> None:
            """Search what waits of a size."""
            parts = waiting.pop(dims)
            index = build(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)))
            for nth, (query_id, query) in enumerate(asked_of[dims]):
                before = best.get((dims, nth))
                found = search(index, query_id, query, before)
                best[dims, nth] = before.merged(found, k) if before is not None else found

        def result() -> pa.RecordBatch:
            for dims in list(waiting):
                look(dims)
            rows = [(asked_of[dims][nth][0], f) for (dims, nth), f in best.items()]
            ids = np.concatenate([np.full(len(f.ids), q, np.int64) for q, f in rows] or [np.zeros(0, np.int64)])
            kinds = (("ids", pa.int64()), ("score", pa.int64() if score == "long" else pa.float64()), ("extra", pa.int32()))
            arrays = [pa.array(ids), *(pa.array(np.concatenate([getattr(f, a) for _, f in rows] or [np.zeros(0)]), t) for a, t in kinds)]
            return pa.RecordBatch.from_arrays(arrays, names=["query_id", "vec_id", "score", "extra"])

        for b in batches:
            for i in range(b.num_rows):
                task, side, dims, ids, data = (c[i].as_py() for c in b.columns)
                ids, data = np.frombuffer(ids, "<i8"), np.frombuffer(data, kind).reshape(-1, dims)
                if task != of:
                    if of is not None:
                        yield result()
                    of, best, asked_of, waiting = task, {}, {}, {}
                if side:
                    asked_of.setdefault(dims, []).extend(zip(ids.tolist(), data, strict=True))
                elif dims in asked_of:
                    if sum(len(p[0]) for p in waiting.get(dims, [])) + len(ids) > min(block_rows, BLOCK_BYTES // (8 * dims)) and dims in waiting:
                        look(dims)
                    waiting.setdefault(dims, []).append((ids, data))
        if of is not None:
            yield result()

    return dealt.mapInArrow(run, f"query_id long, vec_id long, score {score}, extra int")


def best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score, extra): the ``k`` best of each query, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "extra")
