"""Set-similarity join of word n-grams by prefix trees.

Shingles that stand in exactly the same sets are one atom with a weight. That loses nothing, as
overlaps are sums of weights, and makes sets short. Every distinct set is put into one global order
of the atoms: first those of no other set, then by weight, the greatest first. Two sets that link
share an atom among the first few of both, their prefixes, which weigh one more than what a partner
may lack. Sets that share one meet in a task, which puts them into a prefix tree in that order and
walks it once for all of them: what a path has in common with each set is counted once for all sets
below, and a subtree is left as soon as what remains of its sets is too short to bring any of them
over the threshold. It takes these steps:

1. equal texts, or texts with equal sets, become one set with a key (64 bits and the size);
2. shingles are dealt to buckets, where those of a single set only count; the others get the
   signature of the sets that hold them (frequent shingles, found in a bounded sample, are atoms of
   their own and are dealt by set, so none gathers its sets in one task);
3. sets with too many shingles that no other set has cannot link and go no further;
4. each remaining set is sent, as atoms, to the group of each atom of its prefix; groups of more
   than BLOCK sets are cut into blocks in two ways, and each block gives the links inside it;
5. cut groups whose sets then still lie in several components are compared block by block in pairs,
   so no link is lost; mostly there are none.

A block links sets that are not yet connected there, so it gives fewer links than it has sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphward.llm.components import components
from glyphward.llm.tables import drop, save, small_batches
from glyphward.llm.wordcodes import BY_SPACE, slices, words_of
from glyphward.llm.worker import give_back

WORDS = 3  # of a shingle
LEAST, OF = 90, 100  # sets link when OF * intersection >= LEAST * union
BUCKET = 1 << 21  # shingles in a bucket, about
HELD = 1 << 19  # shingles that a task gathers before it deals them
SEEN = 1 << 18  # keys of sets that a task remembers, so that it sends copies once
SAMPLE = 4_096  # sets in which frequent shingles are looked for, or 1 in SAMPLE_RATE if that is more
SAMPLE_RATE = 50_000
FREQUENT = 20  # times in the sample
BLOCK = 1_024  # sets in a tree at most

U = np.uint64


def _give_back() -> None:
    """Return freed memory to the system, that of Arrow too."""
    pa.default_memory_pool().release_unused()
    give_back()


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, number of them in each text): the distinct shingles of each text, as 64-bit hashes in order. ``texts``: large_string without nulls."""
    from xxhash import xxh64_intdigest

    found = words_of(texts, BY_SPACE)
    h = np.fromiter(map(xxh64_intdigest, found.distinct), U, len(found.distinct))[found.code]
    counts = found.counts()
    least = np.minimum(counts, words)  # words of the shingles of each text
    last = len(h) - words + 1
    runs = [(np.flatnonzero(found.text[: max(last, 0)] == found.text[words - 1 :]), words)] if last > 0 else []
    starts = np.cumsum(counts) - counts
    runs += [(starts[least == n], n) for n in range(1, words)]
    hashes, of = [], []
    for at, n in runs:
        x = np.full(len(at), n, U)
        for k in range(n):
            x = _mixed(x * U(0x9E3779B97F4A7C15) + h[at + k])
        hashes.append(x)
        of.append(found.text[at])
    shingle, text = np.concatenate(hashes), np.concatenate(of)
    order = np.lexsort((shingle, text))
    shingle, text = shingle[order], text[order]
    new = np.r_[True, (shingle[1:] != shingle[:-1]) | (text[1:] != text[:-1])] if len(order) else np.zeros(0, bool)
    return shingle[new], np.bincount(text[new], minlength=len(texts))


def set_keys(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A key for each set that depends on its members only."""
    sums = np.r_[U(0), np.cumsum(_mixed(shingles + U(1)), dtype=U)]
    ends = np.cumsum(sizes)
    return _mixed(sums[ends] - sums[ends - sizes] + sizes.astype(U)).view(np.int64)


def _texts(docs: DataFrame, *columns) -> DataFrame:
    return small_batches(docs).select(*columns, F.make_valid_utf8(F.coalesce(F.col("text"), F.lit(""))).alias("text"))


def keyed(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, key, n, sample): the set of each document; sample holds the shingles of about SAMPLE sets, chosen by key."""
    rows = max(docs.count(), 1)
    rate = min(1.0, max(SAMPLE / rows, 1 / SAMPLE_RATE))
    below = int(rate * 2.0**63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            doc_id, texts = b.column(0), b.column(1).cast(pa.large_string())
            for begin, to in slices(texts):
                shingles, sizes = shingle_sets(texts.slice(begin, to - begin), words)
                keys = set_keys(shingles, sizes)
                ends = np.cumsum(sizes)
                sample: list[np.ndarray | None] = [None] * len(keys)
                for i in np.flatnonzero(((keys.view(U) >> U(1)) < U(below)) & (sizes > 0)):
                    if keys[i] not in seen:
                        seen.add(keys[i])
                        sample[i] = shingles[ends[i] - sizes[i] : ends[i]].view(np.int64)
                yield pa.RecordBatch.from_arrays([doc_id.slice(begin, to - begin), pa.array(keys), pa.array(sizes), pa.array(sample, pa.list_(pa.int64()))], names=["doc_id", "key", "n", "sample"])

    return _texts(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, key long, n long, sample array<long>")


def frequent_shingles(sets: DataFrame) -> np.ndarray:
    """Shingles of at least FREQUENT sets of the sample, in order: at most a twentieth of the sample's."""
    held = sets.where("sample IS NOT NULL").select("key", F.explode("sample").alias("shingle")).distinct()
    often = held.groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).select("shingle").toArrow()
    return np.sort(often.column("shingle").to_numpy().view(U))


def _dealt(docs: DataFrame, buckets: int, hot: np.ndarray, words: int) -> DataFrame:
    """(bucket, keys, counts, shingles): the shingles of all sets in packed rows; those in ``hot`` in the buckets from ``buckets`` on, by set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            keys, sizes, shingles = (np.concatenate(x) for x in zip(*parts, strict=True))
            of = np.repeat(np.arange(len(keys)), sizes)
            bucket = ((shingles >> U(32)) * U(buckets) >> U(32)).astype(np.int32)
            if len(hot):
                is_hot = hot[np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)] == shingles
                by_set = ((_mixed(keys.view(U)) >> U(32)) * U(buckets) >> U(32)).astype(np.int32)
                bucket = np.where(is_hot, buckets + by_set[of], bucket)
            order = np.argsort(bucket, kind="stable")
            bucket, of, shingles = bucket[order], of[order], shingles[order]
            run_at = _runs(bucket, of, np.arange(len(of)) >> 8)  # runs of a set in a bucket, of 256 at most
            run_bucket, run_set = bucket[run_at], of[run_at]
            run_count = (np.diff(np.r_[run_at, len(bucket)]) - 1).astype(np.uint8)
            row_at = np.flatnonzero(np.r_[True, run_bucket[1:] != run_bucket[:-1]])
            row_to = np.r_[row_at[1:], len(run_bucket)]
            at = np.r_[run_at, len(bucket)]
            cells = lambda x: [x[a:z].tobytes() for a, z in zip(row_at, row_to, strict=True)]
            data = [shingles[at[a] : at[z]].tobytes() for a, z in zip(row_at, row_to, strict=True)]
            columns = [pa.array(run_bucket[row_at]), *(pa.array(x, pa.binary()) for x in (cells(keys[run_set]), cells(run_count), data))]
            return pa.RecordBatch.from_arrays(columns, names=["bucket", "keys", "counts", "shingles"])

        for b in batches:
            texts = b.column(0).cast(pa.large_string())
            for begin, to in slices(texts):
                shingles, sizes = shingle_sets(texts.slice(begin, to - begin), words)
                keys = set_keys(shingles, sizes)
                new = np.fromiter((n > 0 and k not in seen and not seen.add(k) for k, n in zip(keys.tolist(), sizes.tolist(), strict=True)), bool, len(keys))
                if len(seen) > SEEN:
                    seen.clear()
                parts.append((keys[new], sizes[new], shingles[np.repeat(new, sizes)]))
                held += len(parts[-1][2])
                if held >= HELD:
                    yield flush()
                    parts, held = [], 0
                    _give_back()
        if held:
            yield flush()

    return _texts(docs).mapInArrow(run, "bucket int, keys binary, counts binary, shingles binary")


def _numbers(cells: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(cells), kind)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a stream, a table for each run of equal values in its first column."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        k = b.column(0).to_numpy(zero_copy_only=False)
        at = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, z in zip(at, at[1:], strict=False):
            if a == z:
                continue
            if held and held[-1].column(0)[0].as_py() != k[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


def _cells(table: pa.Table, column: str) -> list[bytes]:
    return table.column(column).to_pylist()


def _atoms_of_buckets(buckets: int):
    """From packed shingles, sorted by bucket, to one row for each bucket: its sets, how many shared shingles each has there, and their atoms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches):
            bucket = t.column("bucket")[0].as_py()
            shingle = _numbers(_cells(t, "shingles"), "u8")
            counts = _numbers(_cells(t, "counts"), "u1").astype(np.int64) + 1
            keys, of_run = np.unique(_numbers(_cells(t, "keys"), "i8"), return_inverse=True)
            of = np.repeat(of_run.ravel().astype(np.int32), counts)
            order = np.lexsort((of, shingle)).astype(np.int32)
            shingle, of = shingle[order], of[order]
            at = _runs(shingle, of).astype(np.int32)  # copies of a set in several tasks
            shingle, of = shingle[at], of[at]
            begin = _runs(shingle)
            df = np.diff(np.r_[begin, len(shingle)])
            if bucket < buckets:
                sums = np.r_[U(0), np.cumsum(_mixed(keys.view(U))[of], dtype=U)]
                signature = sums[begin + df] - sums[begin]
                shared = df > 1
            else:
                signature, shared = shingle[begin], np.ones(len(begin), bool)
            entry = np.repeat(shared, df)
            of, run_of = of[entry], np.repeat(np.arange(len(df), dtype=np.int32), df)[entry]
            atom, which = np.unique(signature[run_of], return_inverse=True)
            order = np.lexsort((which, of))
            of, which = of[order], which[order]
            at = _runs(of, which)
            weight = np.diff(np.r_[at, len(of)]).astype(np.int32)
            of, which = of[at], which[at].astype(np.int32)
            some = np.unique(of)  # sets with an atom here
            local = np.searchsorted(some, of)
            row = (keys[some], np.bincount(local, weights=weight, minlength=len(some)).astype(np.int32), np.bincount(local, minlength=len(some)).astype(np.int32), which, weight, atom.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in row)], names=["bucket", *_BUCKET])
            if len(order) > HELD:
                del t, shingle, of, order, at, begin, df, entry, run_of, which, weight, row
                _give_back()

    return run


_BUCKET = ("keys", "shared", "entries", "atoms", "weights", "signatures")


SIZES = -1  # stands for a bucket in rows that tell the sizes of whole sets


def _by_set(buckets: int):
    """(part, bucket, keys, counts) dealt by set, of rows (bucket, keys, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, *cells in zip(*(c.to_pylist() for c in b.columns), strict=True):
                keys, counts = (np.frombuffer(x, k) for x, k in zip(cells, ("i8", "i4"), strict=True))
                part = ((_mixed(keys.view(U)) >> U(32)) * U(buckets) >> U(32)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                at = _runs(part[order])
                if not len(at):
                    continue
                cut = lambda x: [y.tobytes() for y in np.split(x[order], at[1:])]  # noqa: B023, E731
                columns = [pa.array(part[order][at]), pa.array(np.full(len(at), bucket, np.int32)), *(pa.array(cut(x), pa.binary()) for x in (keys, counts))]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "bucket", "keys", "counts"])

    return run


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, keys, counts) of rows (key, n)."""
    for b in batches:
        columns = [pa.array([SIZES], pa.int32()), *(pa.array([c.to_numpy().astype(k).tobytes()], pa.binary()) for c, k in zip(b.columns, ("i8", "i4"), strict=True))]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "keys", "counts"])


def _possible(least: int, of: int):
    """(bucket, alive, sizes): for each bucket its sets that have enough shared shingles over all buckets to link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches):
            cells, bucket = _cells(t, "keys"), t.column("bucket").to_numpy()
            keys, where = np.unique(_numbers(cells, "i8"), return_inverse=True)
            where, counts = where.ravel(), _numbers(_cells(t, "counts"), "i4")
            whole = np.repeat(bucket == SIZES, [len(c) // 8 for c in cells])
            size = np.zeros(len(keys), np.int64)
            size[where[whole]] = counts[whole]
            shared = np.bincount(where[~whole], weights=counts[~whole], minlength=len(keys)).astype(np.int64)
            alive = (of * shared >= least * size)[where]  # a partner has least / of of it at least
            ends = np.cumsum([len(c) // 8 for c in cells])
            held = [where[a:z][alive[a:z]] for a, z in zip(np.r_[0, ends[:-1]], ends, strict=True)]
            rows = [i for i, x in enumerate(held) if len(x) and bucket[i] != SIZES]
            columns = [pa.array(bucket[rows]), *(pa.array([x[held[i]].astype(k).tobytes() for i in rows], pa.binary()) for x, k in ((keys, "i8"), (size, "i4")))]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "alive", "sizes"])

    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n, signature, weight): the atoms of the sets of a bucket that may link."""
    for b in batches:
        for row in b.to_pylist():
            alive, first = np.unique(_numbers([x["alive"] for x in row["possible"]], "i8"), return_index=True)
            size = _numbers([x["sizes"] for x in row["possible"]], "i4")[first]
            keys, _, entries, atoms, weights, signatures = (np.frombuffer(row[c], k) for c, k in zip(_BUCKET, ("i8", "i4", "i4", "i4", "i4", "i8"), strict=True))
            at = np.minimum(np.searchsorted(alive, keys), len(alive) - 1)
            of = np.repeat(np.arange(len(keys)), entries)
            kept = (alive[at] == keys)[of]
            of, atoms, weights = of[kept], atoms[kept], weights[kept]
            for a in range(0, len(of), 1 << 16):
                i, x = of[a : a + (1 << 16)], atoms[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[i]), pa.array(size[at[i]]), pa.array(signatures[x]), pa.array(weights[a : a + (1 << 16)])], names=["key", "n", "signature", "weight"])


_SET = "key long, n int, signatures binary, weights binary, prefix array<long>"


def _ordered_sets(least: int, of: int):
    """From entries sorted by set to one row for each set: its atoms in the global order, and those of its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "n", "signatures", "weights", "prefix"])

        for t in _by_key(batches):
            key, n = t.column("key")[0].as_py(), t.column("n")[0].as_py()
            signature, weight = (t.column(c).to_numpy() for c in ("signature", "weight"))
            order = np.argsort(signature, kind="stable")
            at = _runs(signature[order])  # parts of an atom from several buckets
            signature, weight = signature[order][at], np.add.reduceat(weight[order], at).astype(np.int32)
            order = np.lexsort((signature, -weight))
            signature, weight = signature[order], weight[order]
            lacking = n - -(-least * n // of)  # shingles that a partner may lack at most
            alone = n - int(weight.sum())
            before = alone + np.cumsum(weight) - weight
            rows.append((key, n, signature.tobytes(), weight.tobytes(), signature[before <= lacking].tolist()))
            if len(rows) >= 1_000:
                yield batch()
                rows = []
        if rows:
            yield batch()

    return run


def tree_links(n: np.ndarray, sizes: np.ndarray, signature: np.ndarray, weight: np.ndarray, label: np.ndarray | None = None, least: int = LEAST, of: int = OF) -> list[tuple[int, int]]:
    """Links (i, j) that join the sets of a block into the components that all their links make.

    ``n``: the sizes of the sets in shingles; ``sizes``: in atoms, which follow each other in
    ``signature`` and ``weight``, which is the same wherever an atom stands. Sets with equal ``label`` count as joined already.
    """
    count = len(n)
    label = np.arange(count) if label is None else np.unique(label, return_inverse=True)[1].ravel()
    sid = np.repeat(np.arange(count), sizes)
    order = np.lexsort((sid, signature, -weight))
    sid, weight, at = sid[order], weight[order].astype(np.int64), _runs(signature[order])
    held = np.diff(np.r_[at, len(sid)])
    # atoms of the same sets of this block go together; those of one set are of no use
    marks = np.random.default_rng(0).integers(0, 1 << 63, count, dtype=np.int64)
    sums = np.r_[0, np.cumsum(marks[sid])]
    together, first, group = np.unique(sums[at + held] - sums[at], return_index=True, return_inverse=True)
    rank = np.argsort(np.argsort(first))  # by the least of their atoms in the global order
    group = rank[group.ravel()]
    total = np.zeros(len(together), np.int64)
    np.add.at(total, group, weight[at])
    lead = np.sort(first)
    lead = lead[held[lead] > 1]
    number = np.full(len(together), -1)
    number[group[lead]] = np.arange(len(lead))
    inside = np.zeros((len(lead), count), bool)
    for i, f in enumerate(lead):
        inside[i, sid[at[f] : at[f] + held[f]]] = True
    gain = total[group[lead]]
    whole = gain @ inside if len(lead) else np.zeros(count, np.int64)
    p, q = least + of, least  # link when p * overlap >= q * (n + n')
    keep = np.flatnonzero(of * whole >= least * n)
    paths = {int(s): np.flatnonzero(inside[:, s]).tolist() for s in keep}
    keep = np.array(sorted(paths, key=paths.__getitem__), np.int64)
    if len(keep) < 2:
        return []
    path, inside, n, whole, label = [paths[int(s)] for s in keep], inside[:, keep], n[keep].astype(np.int64), whole[keep], label[keep].copy()
    reach = p * whole - q * n
    links: list[tuple[int, int]] = []

    def join(y: int, near: np.ndarray) -> None:
        for x in near:
            if label[x] != label[y]:
                links.append((int(keep[x]), int(keep[y])))
                label[label == label[x]] = label[y]

    # (sets below, depth, weight of the path, sets that may still link with one of them, their overlaps with the path)
    stack = [(0, len(path), 0, 0, np.arange(len(path)), np.zeros(len(path), np.int64))]
    while stack:
        lo, hi, depth, taken, near, overlap = stack.pop()
        top, end = path[lo], path[hi - 1]
        far = depth
        most = min(len(top), len(end))
        while far < most and top[far] == end[far]:  # the edge that all of them go along
            far += 1
        some = near < hi - 1
        if (label[lo:hi] == label[lo]).all():
            some &= label[near] != label[lo]
        near, overlap = near[some], overlap[some]
        if not len(near):
            continue
        if far > depth:
            edge = top[depth:far]
            overlap = overlap + gain[edge] @ inside[np.ix_(edge, near)]
            taken += int(gain[edge].sum())
        possible = p * (overlap - taken) + reach[lo:hi].max() >= q * n[near]
        near, overlap = near[possible], overlap[possible]
        if not len(near):
            continue
        y = lo
        while y < hi and len(path[y]) == far:  # sets that end here
            join(y, near[(near < y) & (p * overlap >= q * (n[near] + n[y]))])
            y += 1
        while y < hi:
            to = y + 1
            while to < hi and path[to][far] == path[y][far]:
                to += 1
            stack.append((y, to, far, taken, near, overlap))
            y = to
    return links


def _linked(least: int, of: int):
    """Links of the blocks in a stream sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches):
            if t.num_rows < 2:
                continue
            keys, label = t.column("key").to_numpy(), t.column("label").to_numpy()
            cells = _cells(t, "signatures")
            sizes = np.array([len(c) // 8 for c in cells])
            found = tree_links(t.column("n").to_numpy(), sizes, _numbers(cells, "i8"), _numbers(_cells(t, "weights"), "i4"), label, least, of)
            if found:
                i, j = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(keys[i], keys[j])), pa.array(np.maximum(keys[i], keys[j]))], names=["a", "b"])
            if t.num_rows > 256:
                _give_back()

    return run


def _compared(sets: DataFrame, members: DataFrame, least: int, of: int) -> DataFrame:
    """Links inside the blocks of ``members`` (block, key, label)."""
    whole = members.join(sets.select("key", "n", "signatures", "weights"), "key").select("block", "key", "label", "n", "signatures", "weights")
    return whole.repartition("block").sortWithinPartitions("block", "key").mapInArrow(_linked(least, of), "a long, b long").distinct()


def ordered_sets(docs: DataFrame, sets: DataFrame, words: int = WORDS, least: int = LEAST, of: int = OF) -> DataFrame:
    """The sets of ``docs`` that may link, as atoms in the global order with their prefixes; written to the shared folder."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = int(max(1, total // BUCKET))
    tasks = max(buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    buckets = max(buckets, min(tasks, total // 4096 + 1))
    dealt = _dealt(docs, buckets, frequent_shingles(sets), words).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    schema = "bucket int, " + ", ".join(f"{c} binary" for c in _BUCKET)
    postings = save(dealt.mapInArrow(_atoms_of_buckets(buckets), schema), "postings")
    sizes = sets.where("n > 0").select("key", "n").distinct().mapInArrow(_sizes, "bucket int, keys binary, counts binary")
    counts = postings.select("bucket", "keys", F.col("shared").alias("counts")).union(sizes).mapInArrow(_by_set(buckets), "part int, bucket int, keys binary, counts binary")
    alive = counts.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_possible(least, of), "bucket int, alive binary, sizes binary")
    alive = alive.groupBy("bucket").agg(F.collect_list(F.struct("alive", "sizes")).alias("possible"))  # the sets of one bucket
    entries = postings.join(alive.hint("merge"), "bucket").select(*_BUCKET, "possible").mapInArrow(_entries, "key long, n int, signature long, weight int")
    out = save(entries.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_ordered_sets(least, of), _SET), "ordered")
    drop(postings)
    return out


def _apart(members: DataFrame, joined: DataFrame) -> DataFrame:
    """(atom, key, sets, label): the rows of ``members`` whose atom has sets of several components."""
    placed = members.join(joined.hint("merge"), members.key == joined.node, "left").select("atom", "key", "sets", F.coalesce("root", "key").alias("label"))
    apart = placed.groupBy("atom").agg((F.min("label") != F.max("label")).alias("apart")).where("apart").select("atom")
    return placed.join(apart.hint("merge"), "atom")


def set_components(sets: DataFrame, least: int = LEAST, of: int = OF, block: int = BLOCK) -> DataFrame:
    """(node, root) of the sets in ``sets``, a table of :func:`ordered_sets`, that have a link."""
    prefixes = sets.select("key", F.explode("prefix").alias("atom"))
    groups = save(prefixes.groupBy("atom").agg(F.count("*").alias("sets")).where("sets > 1"), "groups")
    members = save(prefixes.join(groups.hint("merge"), "atom").select("atom", "key", "sets"), "members")
    cut = lambda salt: F.xxhash64("atom", F.pmod(F.xxhash64("key", "atom", F.lit(salt)), F.ceil(F.col("sets") / block))).alias("block")
    large = members.where(F.col("sets") > block)
    # groups that are cut are cut in two ways, so blocks of one way are joined by those of the other
    blocks = members.select(cut(0), "key", F.col("key").alias("label")).union(large.select(cut(1), "key", F.col("key").alias("label")))
    links = save(_compared(sets, blocks, least, of), "links")
    joined = components(links, "a", "b")
    used = [groups, members, links]
    if not large.isEmpty():
        left = save(_apart(large, joined), "apart")
        used.append(left)
        if not left.isEmpty():  # each part with each other one
            parts = left.withColumn("parts", F.ceil(F.col("sets") * 2 / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("key"), "parts").cast("int"))
            pairs = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("own <> other")
            both = F.xxhash64("atom", F.least("own", "other"), F.greatest("own", "other")).alias("block")
            more = save(_compared(sets, pairs.select(both, "key", "label"), least, of), "links")
            used += [more, joined]
            joined = components(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), "a", "b")
    drop(*used)
    return joined


def jaccard_groups(docs: DataFrame, words: int = WORDS, least: int = LEAST, of: int = OF) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row for each row of ``docs``.

    Words are parted by ASCII white space, A-Z count as small. n_shingles: distinct shingles of
    ``words`` words; a text of fewer words is one shingle. Documents link when ``of`` * intersection
    >= ``least`` * union; component_id is the smallest doc_id reachable. Null texts and texts without
    words have no shingle and are linked with nothing, not even with each other. Copies are in one
    component and are not compared; repeated rows stay; rows with a null doc_id count by their text
    and take the smallest id that is not null; extra columns are ignored; no rows give no rows.
    """
    sets = save(keyed(docs, words), "sets")
    ordered = ordered_sets(docs, sets, words, least, of)
    tree = set_components(ordered, least, of)
    drop(ordered)
    held = sets.where("n > 0")
    leaders = save(held.groupBy("key", "n").agg(F.min("doc_id").alias("least_id")), "leaders")
    roots = save(leaders.join(tree.hint("merge"), leaders.key == tree.node).select("key", "n", "root", "least_id"), "roots")
    best = roots.groupBy("root").agg(F.min("least_id").alias("component_id"))
    linked = roots.join(best.hint("merge"), "root").select("key", "n", "component_id")
    groups = save(leaders.join(linked.hint("merge"), ["key", "n"], "left").select("key", "n", F.coalesce("component_id", "least_id").alias("component_id")), "groups")
    drop(tree, leaders, roots)
    out = held.join(groups.hint("merge"), ["key", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
