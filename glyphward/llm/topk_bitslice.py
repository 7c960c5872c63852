"""Exact top-k inner-product search over a bit-sliced index.

Each attribute of a block of vectors is quantised to its leading bits, one bitmap over the rows for
each bit. For a query the slices of every attribute, shifted by the set bits of its weight, are
added with bitmap arithmetic (carry-save adders), which gives the slices of all scores at once. The
k-th largest quantised score is read off from the most significant slice down. Rows that the
quantisation error could still lift to it are resolved with exact integers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from glyphward.llm.vector_blocks import Found, best, block_search, usable

BITS = 7  # slices kept of an attribute
BLOCK_ROWS = 32_768


@dataclass
class Index:
    ids: np.ndarray
    values: np.ndarray  # (rows, dims) exact integers
    low: np.ndarray  # least value of each attribute
    shift: np.ndarray  # bits dropped from each attribute
    slices: np.ndarray  # (dims * BITS, words): bit j of attribute d at row d * BITS + j
    everyone: np.ndarray
    most: np.ndarray  # greatest size of each attribute


MOST = 2.0**62  # size of an integer component
LONG = 1 << 63


def quantise(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) in double precision, as 64-bit integers; OverflowError for what these cannot hold."""
    whole = np.floor(scale * vectors.astype(np.float64))
    if whole.size and not (np.abs(whole) < MOST).all():
        raise OverflowError(f"a component times {scale} has more than 62 bits")
    return whole.astype(np.int64)


def _wide(index: Index, query: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, exact scores) of all rows of ``among``, in integers of any size; OverflowError for scores of more than 64 bits."""
    at = _rows(among, len(index.ids))
    exact = index.values[at].astype(object) @ query.astype(object)
    if any(not -LONG <= x < LONG for x in exact):
        raise OverflowError("an inner product has more than 64 bits")
    return at, exact.astype(np.int64)


def _bitmap(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    out = np.zeros((*bits.shape[:-1], words * 8), np.uint8)
    packed = np.packbits(bits, axis=-1, bitorder="little")
    out[..., : packed.shape[-1]] = packed
    return out.view(np.uint64)


def build(ids: np.ndarray, values: np.ndarray) -> Index:
    words = -(-len(ids) // 64)
    low = values.min(axis=0)
    above = values - low
    shift = np.array([max(0, int(top).bit_length() - BITS) for top in above.max(axis=0)], np.int64)
    lead = (above >> shift).astype(np.uint8)
    slices = np.concatenate([_bitmap(((lead >> j) & 1).T.astype(bool), words)[:, None] for j in range(BITS)], axis=1)
    return Index(ids, values, low, shift, slices.reshape(-1, words), _bitmap(np.ones(len(ids), bool), words), np.abs(values).max(axis=0).astype(np.float64))


def _add(columns: dict[int, np.ndarray]) -> list[np.ndarray | None]:
    """The sum of bitmaps at their bit positions, as one bitmap for each position."""
    out: list[np.ndarray | None] = []
    at, last = 0, max(columns, default=-1)
    while at <= last:
        rows = columns.pop(at, None)
        while rows is not None and len(rows) > 1:
            n = len(rows) // 3
            if n:
                a, b, c = rows[:n], rows[n : 2 * n], rows[2 * n : 3 * n]
                half = a ^ b
                total, carry = half ^ c, (a & b) | (half & c)
                rest = rows[3 * n :]
            else:
                total, carry, rest = rows[:1] ^ rows[1:], rows[:1] & rows[1:], rows[:0]
            rows = np.concatenate([total, rest]) if len(rest) else total
            columns[at + 1] = np.concatenate([columns[at + 1], carry]) if at + 1 in columns else carry
            last = max(last, at + 1)
        out.append(None if rows is None else rows[0])
        at += 1
    return out


def scores(index: Index, query: np.ndarray) -> tuple[list[np.ndarray | None], int]:
    """(slices of the quantised scores, up to a constant; largest error of a difference of two)."""
    weight = np.abs(query)
    used = np.flatnonzero(weight)
    columns: dict[int, list[int]] = {}
    for d in used.tolist():
        w, s, base = int(weight[d]), int(index.shift[d]), d * BITS
        p = 0
        while w:
            if w & 1:
                for j in range(BITS):
                    columns.setdefault(p + s + j, []).append(base + j)
            w >>= 1
            p += 1
    # a negative weight counts the complement of the attribute instead
    flip = np.repeat(np.where(query < 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)), BITS)
    slices = _add({at: index.slices[rows] ^ flip[rows][:, None] for at, rows in columns.items()})
    return slices, int((weight * ((1 << index.shift) - 1)).sum())


def candidates(index: Index, slices: list[np.ndarray | None], error: int, k: int, among: np.ndarray) -> np.ndarray:
    """Rows whose quantised score is at least the k-th largest one less the error: bitmap descent from the most significant slice."""
    if int(np.bitwise_count(among).sum()) <= k:
        return _rows(among, len(index.ids))
    tied, need, kth = among, k, 0
    for at in range(len(slices) - 1, -1, -1):
        if slices[at] is None:
            continue
        ones = tied & slices[at]
        n = int(np.bitwise_count(ones).sum())
        if n >= need:
            tied, kth = ones, kth | 1 << at
        else:
            tied, need = tied & ~slices[at], need - n
    least = kth - error
    if least <= 0:
        return _rows(among, len(index.ids))
    above, equal = np.zeros_like(among), among
    for at in range(max(len(slices), least.bit_length()) - 1, -1, -1):
        s = slices[at] if at < len(slices) and slices[at] is not None else None
        if least >> at & 1:
            equal = equal & s if s is not None else np.zeros_like(equal)
        elif s is not None:
            above, equal = above | (equal & s), equal & ~s
    return _rows(above | equal, len(index.ids))


def _rows(bitmap: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), count=n, bitorder="little"))


def top_k(index: Index, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, exact scores) of the k best rows of the block, ties to the smaller id; rows with the query's id are left out."""
    among = index.everyone & ~_bitmap(index.ids == query_id, len(index.everyone))
    if index.most @ np.abs(query).astype(np.float64) < MOST:  # no sum of this block can overflow
        slices, error = scores(index, query)
        at = candidates(index, slices, error, k, among)
        exact = index.values[at] @ query
    else:
        at, exact = _wide(index, query, among)
    order = np.lexsort((index.ids[at], -exact))[:k]
    return index.ids[at][order], exact[order]


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of integer vectors floor(``scale`` * x).

    ``vectors`` and ``queries`` have vec_id and embedding. Null, empty and non-finite vectors and
    rows without an id take no part; rows with the query's own id are not its candidates; a query
    with fewer candidates gets all; ties go to the smaller id; repeated candidate rows each count;
    extra columns are ignored. A query meets only vectors with as many components. Where sums could
    leave 64 bits they are taken in wider integers; components of more than 62 bits and scores of
    more than 64 are an error.
    """

    def prepare(ids: np.ndarray, data: np.ndarray) -> Index:
        return build(ids, quantise(data, scale))

    def search(index: Index, query_id: int, query: np.ndarray, before: Found | None) -> Found:
        found, score = top_k(index, query_id, quantise(query, scale), k)
        return Found(found, score, np.zeros(len(found), np.int32))

    found = block_search(usable(vectors), usable(queries), prepare, search, k, "long", BLOCK_ROWS)
    return best(found, k).drop("extra")
