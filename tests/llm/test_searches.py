"""Exact top-k and nearest neighbours against brute force."""

import numpy as np
import pytest

from glyphward.llm import ann_mih, topk_bitslice, vector_blocks
from glyphward.llm import queries as q
from glyphward.llm.ann_mih import Coder, build, learn_rotations, nearest_neighbours, within
from glyphward.llm.topk_bitslice import build as slice_index
from glyphward.llm.topk_bitslice import exact_top_k, top_k

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute_top(ids, values, i, k):
    score = values @ values[i]
    order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
    return [(int(ids[j]), int(score[j])) for j in order]


def test_bit_slices_resolve_exactly():
    rng = np.random.default_rng(4)
    for rows, dims, spread in ((1, 3, 5), (7, 1, 3), (300, 16, 4000), (1000, 9, 2), (257, 5, 10**6)):
        values = rng.integers(-spread, spread, (rows, dims))
        values[rows // 2 :] = values[: rows - rows // 2]
        ids = rng.permutation(rows) - 5
        index = slice_index(ids, values)
        for i in range(0, rows, max(1, rows // 9)):
            found, score = top_k(index, int(ids[i]), values[i], 10)
            assert list(zip(found.tolist(), score.tolist())) == brute_top(ids, values, i, 10)


def test_top_k_query(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    ids, values = table.vec_id.to_numpy(), np.floor(1024 * np.stack(table.embedding).astype(float)).astype(int)
    got = q.QUERIES["op6_exact_top_k"](spark, sf_dir).toPandas().sort_values(["query_id", "rank"])
    for i in np.flatnonzero(ids % 100 == 0):
        part = got[got.query_id == ids[i]]
        assert list(zip(part.vec_id, part.score)) == brute_top(ids, values, i, 10) and list(part["rank"]) == list(range(1, len(part) + 1))


ODD = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (2, [1.0, 0.0], 3), (3, [0.5, 0.5], 4), (4, None, 5), (5, [float("nan"), 1.0], 6), (6, [1.0, None], 7), (None, [1.0, 1.0], 8), (7, [], 9), (8, [0.0, 0.0], 10), (9, [1.0, 2.0, 3.0], 11), (10, [float("inf"), 1.0], 12), (11, [-1.0, 0.0], 13)]


def test_odd_rows(spark):
    vectors = spark.createDataFrame(ODD, SCHEMA)
    top = exact_top_k(vectors, vectors.where("vec_id = 0"), 10).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in top] == [(1, 1 << 20), (2, 1 << 20), (3, 1 << 19), (8, 0), (11, -(1 << 20))]
    near = nearest_neighbours(vectors, vectors.where("vec_id in (0, 8)"), 3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in near] == [(0, 1), (0, 2), (0, 3)] and near[0]["score"] == 1.0
    empty = vectors.limit(0)
    assert exact_top_k(empty, empty).isEmpty() and nearest_neighbours(empty, empty).isEmpty()


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(5)
    data = rng.normal(size=(500, 12))
    coder = learn_rotations(data / np.linalg.norm(data, axis=1, keepdims=True), rounds=5)
    index = build(coder, np.arange(500), data)
    for radius in (0, 1, 2, 3, 5, 8, 11, 24):
        for i in (0, 77, 499):
            rows, distance = within(index, index.codes[i], radius)
            want = np.bitwise_count(index.codes ^ index.codes[i]).sum(axis=1)
            assert list(rows) == list(np.flatnonzero(want <= radius)) and list(distance) == list(want[rows])
    assert isinstance(coder, Coder)


def test_recall(spark):
    sf_dir = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    ids, x = table.vec_id.to_numpy(), np.stack(table.embedding).astype(float)
    norms = np.sqrt((x * x).sum(axis=1))
    got = q.QUERIES["op10_nearest_neighbours"](spark, sf_dir).toPandas()
    hits = n = 0
    for i in np.flatnonzero(ids % 50 == 0):
        cosine = (x * x[i]).sum(axis=1) / (norms * norms[i])
        want = [j for j in np.lexsort((ids, -cosine)) if j != i][:5]
        part = got[got.query_id == ids[i]].sort_values("rank")
        hits, n = hits + len(set(ids[want]) & set(part.vec_id)), n + 5
        at = {v: k for k, v in enumerate(ids)}
        assert np.allclose(part.score, [cosine[at[v]] for v in part.vec_id], atol=1e-12) and list(part.score) == sorted(part.score, reverse=True)
    assert hits / n >= 0.9


def test_vectors_of_several_sizes_in_many_tasks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=n).round(2).tolist()) for i, n in enumerate([16] * 700 + [3] * 40 + [5] + [2] * 9 + [7] * 3 + [4] * 2)]
    rows += rows[5:8]  # repeated rows each count
    monkeypatch.setattr(ann_mih, "BLOCK_ROWS", 100)
    monkeypatch.setattr(topk_bitslice, "BLOCK_ROWS", 90)
    monkeypatch.setattr(vector_blocks, "LEAST_GROUP", 10)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    near = nearest_neighbours(table, table.where("vec_id % 50 = 0 or vec_id > 700"), 5).toPandas()
    top = exact_top_k(table, table.where("vec_id % 50 = 0 or vec_id > 700"), 4, 64).toPandas()
    hits = n = 0
    for query_id, query in rows[:-3]:
        if query_id % 50 and query_id <= 700:
            continue
        others = [(i, v) for i, v in rows if i != query_id and len(v) == len(query)]
        x, ids = np.array([v for _, v in others]).reshape(-1, len(query)), np.array([i for i, _ in others], int)
        score = np.floor(64 * x).astype(int) @ np.floor(64 * np.array(query)).astype(int)
        part = top[top.query_id == query_id].sort_values("rank")
        assert list(zip(part.vec_id, part.score)) == [(ids[j], score[j]) for j in np.lexsort((ids, -score))[:4]]
        cosine = (x * query).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * np.dot(query, query))
        part = near[near.query_id == query_id].sort_values("rank")
        assert len(part) == min(5, len(ids)) and list(part["rank"]) == list(range(1, len(part) + 1))
        want = [int(ids[j]) for j in np.lexsort((ids, -cosine))[:5]]
        hits, n = hits + sum(a == b for a, b in zip(part.vec_id, want)), n + len(want)
        if len(query) in (5, 7, 4, 2):
            assert sorted(part.vec_id) == sorted(want)
    assert hits / n >= 0.9


def test_components_of_any_size(spark):
    """Cosines of very small and very large vectors are those of their directions; inner products beyond 64 bits are an error, not a wrong number."""
    rows = [(0, [1.0, 2.0, 2.0]), (1, [1e-200, 2e-200, 2e-200]), (2, [1e200, 2e200, 2.1e200]), (3, [-1.0, 0.0, 0.0]), (4, [0.0, 0.0, 0.0]), (50, [3e-250, 6e-250, 6e-250])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest_neighbours(vectors, vectors.where("vec_id % 50 = 0"), k=5)
    near = {(r.query_id, r.rank): (r.vec_id, round(r.score, 6)) for r in got.collect()}
    assert near[0, 1] == (1, 1.0) and near[0, 2] == (50, 1.0) and near[50, 1][0] == 0 and near[0, 3][0] == 2 and near[0, 4] == (3, -0.333333) and (0, 5) not in near
    wide = spark.createDataFrame([(0, [3e9, 1.0]), (1, [0.5, 1.0]), (2, [1e3, -1.0]), (3, [1e3, 2.0])], "vec_id long, embedding array<double>")
    best_of = {(r.rank): (r.vec_id, r.score) for r in exact_top_k(wide, wide.where("vec_id = 0"), k=3).collect()}
    big = 3 * 10**9 * 1024
    assert best_of == {1: (3, big * 1024000 + 2 * 1024**2), 2: (2, big * 1024000 - 1024**2), 3: (1, big * 512 + 1024**2)}
    for bad in ([(0, [1e30]), (1, [1.0])], [(0, [1e10]), (1, [1e10])]):
        rows = spark.createDataFrame(bad, "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="bits"):
            exact_top_k(rows, rows.where("vec_id = 0"), k=1).collect()
