"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Unit vectors are centred and turned by rotations learned on a bounded sample (iterative
quantisation: the rotation and the signs are fitted to each other in turn); the signs are the code.
A code is split into substrings of eight bits and every block of vectors is indexed by each. For a
radius R, two codes within R differ by at most R // m bits in one of m substrings (one bit less in
those beyond R % m + 1), so probing all values that near retrieves every code within R; these are
checked on the whole code and reranked by the cosine of the original vectors. R is learned: the
neighbours of a bounded sample of queries are found exactly, over all rows, and R covers the wanted
share of them. The commonest numbers of components each have rotations and a radius of their own;
vectors of any other number are compared with every row of theirs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphward.llm.vector_blocks import Found, best, block_search, rows_of, usable

SAMPLE = 8_192  # vectors that the rotations are learned from
PROBES = 96  # queries that the radius is learned from
WANTED = 0.985  # share of their neighbours within the radius
ROTATIONS = 2
CODED = 4  # numbers of components that have codes: the commonest
BLOCK_ROWS = 16_384


@dataclass
class Coder:
    mean: np.ndarray
    turn: np.ndarray  # (dims, bits), a whole number of bytes

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """(rows, bytes) of the signs of the turned vectors."""
        return np.packbits((unit - self.mean) @ self.turn > 0, axis=1)


def learn_rotations(unit: np.ndarray, rounds: int = 30, seed: int = 5) -> Coder:
    """Iterative quantisation, ROTATIONS times from different random starts."""
    rng = np.random.default_rng(seed)
    dims = unit.shape[1]
    mean = unit.mean(axis=0) if len(unit) else np.zeros(dims)
    x, turns = unit - mean, []
    for _ in range(ROTATIONS):
        r = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        for _ in range(rounds if len(unit) else 0):
            u, _, vt = np.linalg.svd(x.T @ np.where(x @ r > 0, 1.0, -1.0))
            r = u @ vt
        turns.append(r)
    turn = np.concatenate(turns, axis=1)
    spare = -turn.shape[1] % 8
    return Coder(mean, np.concatenate([turn, np.zeros((dims, spare))], axis=1))


@dataclass
class Index:
    ids: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    codes: np.ndarray  # (rows, m)
    order: np.ndarray  # (m, rows): rows by the value of each substring
    first: np.ndarray  # (m, 257): where the rows of each value start


SAFE = 1e140  # sizes of components, and their inverses, whose squares and sums of squares are exact enough


def steadied(vectors: np.ndarray) -> np.ndarray:
    """Vectors in double precision, those of very small or large components scaled by a power of two, which changes no cosine."""
    vectors = vectors.astype(np.float64)
    most = np.abs(vectors).max(axis=-1, keepdims=True, initial=0.0)
    odd = (most > 0) & ((most > SAFE) | (most < 1 / SAFE))
    return np.where(odd, np.ldexp(vectors, -np.frexp(most)[1]), vectors) if odd.any() else vectors


def build(coder: Coder | None, ids: np.ndarray, data: np.ndarray) -> Index:
    vectors = steadied(data)
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    real = norms > 0
    ids, vectors, norms = ids[real], vectors[real], norms[real]
    codes = coder.codes(vectors / norms[:, None]) if coder else np.zeros((len(ids), 0), np.uint8)
    order = np.argsort(codes, axis=0, kind="stable").T
    first = np.array([np.searchsorted(codes[order[j], j], np.arange(257)) for j in range(codes.shape[1])])
    return Index(ids, vectors, norms, codes, np.ascontiguousarray(order), first)


def within(index: Index, code: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, distances) of every code within ``radius``, by probing the substring tables."""
    m = len(code)
    seen = np.zeros(len(index.ids), bool)
    values = np.arange(256, dtype=np.uint8)
    for j in range(m):
        near = radius // m - (j > radius % m)
        if near < 0:
            continue
        hit = np.flatnonzero(np.bitwise_count(values ^ code[j]) <= near)
        start, end = index.first[j, hit], index.first[j, hit + 1]
        for a, b in zip(start[start < end].tolist(), end[start < end].tolist(), strict=True):
            seen[index.order[j, a:b]] = True
    rows = np.flatnonzero(seen)
    distance = np.bitwise_count(index.codes[rows] ^ code).sum(axis=1, dtype=np.int64)
    kept = distance <= radius
    return rows[kept], distance[kept]


def _cosines(index: Index, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Row-wise sums, so that equal vectors get equal scores wherever they stand."""
    return (index.vectors[rows] * query).sum(axis=1) / (index.norms[rows] * np.sqrt((query * query).sum()))


def nearest(coder: Coder | None, index: Index, query_id: int, query: np.ndarray, k: int, radius: int | None, held: int = 0) -> Found:
    """The k nearest rows found, with their code distances.

    The radius doubles until there are k with the ``held`` rows found before, or every row is in
    reach. Without a coder or a radius every row is compared.
    """
    query = steadied(query)
    bits = 8 * index.codes.shape[1]
    code = coder.codes((query / np.sqrt((query * query).sum()))[None])[0] if coder else np.zeros(0, np.uint8)
    while True:
        if radius is None or radius >= bits:
            rows, distance = np.arange(len(index.ids)), np.bitwise_count(index.codes ^ code).sum(axis=1, dtype=np.int64)
        else:
            rows, distance = within(index, code, radius)
        others = index.ids[rows] != query_id
        rows, distance = rows[others], distance[others]
        if radius is None or radius >= bits or len(rows) + held >= k:
            break
        radius = min(bits, 2 * max(radius, 1))
    rough = index.vectors[rows] @ query / index.norms[rows]
    if len(rows) > k:
        at = rough >= np.partition(rough, -k)[-k] - 1e-9 * np.abs(rough).max()
        rows, distance = rows[at], distance[at]
    cosine = _cosines(index, rows, query)
    order = np.lexsort((index.ids[rows], -cosine))[:k]
    return Found(index.ids[rows][order], cosine[order], distance[order].astype(np.int32))


def _search(vectors: DataFrame, queries: DataFrame, coders: dict[int, Coder], radii: dict[int, int], k: int) -> DataFrame:
    def prepare(ids: np.ndarray, data: np.ndarray) -> Index:
        return build(coders.get(data.shape[1]), ids, data)

    def search(index: Index, query_id: int, query: np.ndarray, before: Found | None) -> Found:
        dims = len(query)
        if not query.any():
            return Found(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32))
        return nearest(coders.get(dims), index, query_id, query, k, radii.get(dims), len(before.ids) if before else 0)

    return best(block_search(vectors, queries, prepare, search, k, "double", BLOCK_ROWS), k)


def _sample(vectors: DataFrame, dims: int, rows: int) -> DataFrame:
    return vectors.where(F.size("embedding") == dims).orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows)


def learn_coders(vectors: DataFrame) -> dict[int, Coder]:
    """A coder for each of the CODED commonest numbers of components, learned on at most SAMPLE vectors of it."""
    sizes = vectors.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").limit(CODED).collect()
    coders = {}
    for dims in [r["dims"] for r in sizes]:
        sample = rows_of(_sample(vectors, dims, SAMPLE).select("embedding").toArrow().column(0).combine_chunks(), dims).astype(np.float64)
        sample = steadied(sample)
        norms = np.sqrt((sample * sample).sum(axis=1))
        if (norms > 0).any():
            coders[dims] = learn_rotations(sample[norms > 0] / norms[norms > 0, None])
    return coders


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each query by cosine, nearest first.

    ``vectors`` and ``queries`` have vec_id and embedding. Null, empty, zero and non-finite vectors
    and rows without an id take no part; a query meets the vectors with as many components; rows with
    the query's own id are not its candidates; a query with fewer candidates gets all; ties go to the
    smaller id; repeated candidate rows each count; extra columns are ignored. Every row is indexed;
    only the rotations and the radii come from samples.
    """
    vectors, queries = usable(vectors), usable(queries)
    coders = learn_coders(vectors)
    radii: dict[int, int] = {}
    for dims, coder in coders.items():
        exact = _search(vectors.where(F.size("embedding") == dims), _sample(queries, dims, PROBES), {dims: coder}, {}, k)
        distances = exact.select("extra").toArrow().column(0).to_numpy()
        if len(distances):
            radii[dims] = int(np.quantile(distances, WANTED, method="higher"))
    return _search(vectors, queries, coders, radii, k).drop("extra")
