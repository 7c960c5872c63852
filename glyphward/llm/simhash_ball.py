"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

Two fingerprints at Hamming distance 3 or less meet at a common variant when each flips about
half of the differing bits. Half of 3 is not whole, so one side flips one bit and the other two;
which side does is fixed so that every pair still meets:

* every fingerprint emits itself and its 64 one-bit variants; this brings distances 1 and 2
  together (a pair at distance 2 shares the variants half way);
* fingerprints at distance 3 differ in the parity of their bits. Of their three differing bits two
  lie in the same 32-bit half. Even fingerprints emit the two-bit variants of the lower half, odd
  ones those of the upper half; the other side flips the remaining bit.

So each distinct fingerprint emits 1 + 64 + 496 variants. Among those that meet at a variant, any
one that came with at most one flip is within distance 3 of all others, so a star around it holds
every link of that variant: a bucket of n members gives n - 1 verified links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphward.llm.components import components
from glyphward.llm.tables import drop, save, small_batches

RADIUS = 3
ONE_FLIP = 64  # codes up to this one stand for at most one flipped bit


def flip_masks() -> tuple[np.ndarray, list[int], list[int]]:
    """(mask of each code, codes of even fingerprints, codes of odd fingerprints)."""
    lower = [(1 << i) | (1 << j) for i, j in combinations(range(32), 2)]
    masks = [0, *(1 << i for i in range(64)), *lower, *(m << 32 for m in lower)]
    base, n = list(range(65)), len(lower)
    return np.array(masks, np.uint64), base + list(range(65, 65 + n)), base + list(range(65 + n, 65 + 2 * n))


def fingerprint(text: bytes | None) -> int:
    """Unsigned 64-bit SimHash of the 3-word shingles of UTF-8 ``text``; 0 without words."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()  # of bytes: A-Z only, and space and \x09-\x0d only
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < 3 else [b"%b %b %b" % w for w in zip(words, words[1:], words[2:])]
    h = np.fromiter((xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(shingles))
    return _majority(h)


def _majority(h: np.ndarray) -> int:
    bits = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):  # bounded memory for very long texts
        part = h[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(h)).tobytes(), "big")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): one row for each row of ``docs``; fp holds the 64 bits as a long. Null text counts as empty."""
    rows = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, fp long")


@F.arrow_udf(T.LongType())
def fingerprint_of(column: pa.Array) -> pa.Array:
    """The fp of each text, cast to binary."""
    return pa.array(np.fromiter((fingerprint(t.as_py()) for t in column), np.uint64, len(column)).view(np.int64))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the buckets in a stream that is sorted by variant; at most one bucket is carried over."""
    masks, _, _ = flip_masks()
    kept_v, kept_c = np.empty(0, np.uint64), np.empty(0, np.int64)

    def stars(v: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        sizes = np.diff(np.r_[first, len(v)])
        least = np.repeat(np.minimum.reduceat(c, first), sizes)
        at = np.flatnonzero((least <= ONE_FLIP) & (c != least))
        hub, leaf = v[at] ^ masks[least[at]], v[at] ^ masks[c[at]]
        near = np.bitwise_count(hub ^ leaf) <= RADIUS  # colliding pairs are verified
        hub, leaf = hub[near], leaf[near]
        return pa.RecordBatch.from_arrays([pa.array(hub.view(np.int64)), pa.array(leaf.view(np.int64))], names=["a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        v = np.r_[kept_v, b.column(0).to_numpy().view(np.uint64)]
        c = np.r_[kept_c, b.column(1).to_numpy().astype(np.int64)]
        cut = int(np.flatnonzero(v != v[-1])[-1]) + 1 if v[0] != v[-1] else 0
        if cut:
            yield stars(v[:cut], c[:cut])
        kept_v, kept_c = v[cut:], c[cut:]
    if len(kept_v):
        yield stars(kept_v, kept_c)


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    masks, even, odd = flip_masks()
    for b in batches:
        prints = b.column(0).to_numpy().view(np.uint64)
        odd_bits = (np.bitwise_count(prints) & 1).astype(bool)
        for side, codes in ((prints[~odd_bits], even), (prints[odd_bits], odd)):
            for at in range(0, len(side), 512):
                part = side[at : at + 512]
                variant = (part[:, None] ^ masks[codes][None, :]).ravel()
                code = np.tile(np.array(codes, np.int16), len(part))
                yield pa.RecordBatch.from_arrays([pa.array(variant.view(np.int64)), pa.array(code)], names=["variant", "code"])


def near_pairs(prints: DataFrame) -> DataFrame:
    """Distinct links (a, b) between different fingerprints of ``prints`` (fp), enough to join all that are within RADIUS of each other."""
    # fingerprints are few bytes but make many rows, so they are dealt by number, not by size
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    variants = prints.select("fp").repartition(tasks, "fp").mapInArrow(_variants, "variant long, code short")
    met = variants.repartition("variant").sortWithinPartitions("variant").mapInArrow(_links, "a long, b long")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def print_groups(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id): the component of each fingerprint of ``prints`` (doc_id, fp), told by its smallest fingerprint, and its smallest id, null if it has none."""
    groups = save(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "groups")
    tree = components(near_pairs(groups.select("fp")), "a", "b")
    roots = save(tree.join(groups, tree.node == groups.fp).select("fp", "root", "least_id"), "roots")
    best = save(roots.groupBy("root").agg(F.min("least_id").alias("component_id")), "best")
    linked = save(roots.join(best, "root").select("fp", "root", "component_id"), "linked")
    done = save(groups.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least_id").alias("component_id")), "ids")
    drop(tree, groups, roots, best, linked)
    return done


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of ``docs``.

    fingerprint: 16 lowercase hex digits. component_id: the smallest doc_id reachable over links
    between fingerprints that differ in at most three bits. Null and empty texts have fingerprint
    zero and link like any other; repeated rows stay; rows with a null doc_id count by their text
    and take the smallest id that is not null; extra columns are ignored; no rows give no rows.
    """
    prints = save(fingerprints(docs), "prints")
    return prints.join(print_groups(prints), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
