"""Importance resampling towards a target: documents are drawn by how much likelier a target corpus makes their hashed n-grams.

Two scans and no model. The first counts hashed n-grams of the documents and of the target; the
second adds up, for each document, the logarithms of the ratios out of one array of a gain for each
bucket. The draw needs no sort of all documents: scores are whole numbers, so their exact histogram
gives, by suffix sums, how many documents are above each score and at which score the draw ends.
Only documents of the surviving scores are ranked, each score by itself, by doc_id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphward.llm.tables import drop, save, small_batches
from glyphward.llm.wordcodes import BY_SIGN, slices, words_of

BUCKETS = 10_000
LONGEST = 3  # words of the longest n-gram
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
STEP = 10  # bits of a score that its bin leaves open: at most 2^10 scores in a bin
COPIES = 1 << 16  # equal rows that are written out together


# crc32(a + b) is a linear map of crc32(a), which depends on the length of b, xor crc32(b)
def _zeros_operator(n: int) -> np.ndarray:
    """As four tables of 256: what ``n`` zero bytes make of a checksum's register."""
    one = np.array([zlib.crc32(b"\0", 1 << k ^ 0xFFFFFFFF) ^ zlib.crc32(b"\0", 0xFFFFFFFF) for k in range(32)], np.uint32)  # of one byte, by bit
    power, out = one, np.uint32(1) << np.arange(32, dtype=np.uint32)
    while n:
        if n & 1:
            out = _applied(power, out)
        power = _applied(power, power)
        n >>= 1
    bits = np.arange(256)[:, None] >> np.arange(8) & 1
    return np.stack([np.bitwise_xor.reduce(np.where(bits, out[8 * k : 8 * k + 8][None, :], 0).astype(np.uint32), axis=1) for k in range(4)])


def _applied(columns: np.ndarray, values: np.ndarray) -> np.ndarray:
    bits = values[:, None] >> np.arange(32, dtype=np.uint32) & np.uint32(1)
    return np.bitwise_xor.reduce(np.where(bits.astype(bool), columns[None, :], 0).astype(np.uint32), axis=1)


SHORT = 64  # lengths with tables of their own


class Checksums:
    """crc32 of joined words from those of the words, many at a time."""

    def __init__(self) -> None:
        self.short = np.stack([_zeros_operator(n) for n in range(SHORT)])
        self.powers: list[np.ndarray] = []

    def joined(self, head: np.ndarray, tail: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Checksums of pairs, of which the second one is ``length`` bytes long."""
        low = length % SHORT
        out = self._through(self.short, head, low)
        high, k = length // SHORT, 0
        while high.any():  # words of 64 bytes and more
            if k == len(self.powers):
                self.powers.append(_zeros_operator(SHORT << k))
            odd = np.flatnonzero(high & 1)
            out[odd] = self._through(self.powers[k][None], out[odd], np.zeros(len(odd), np.int64))
            high, k = high >> 1, k + 1
        return out ^ tail

    @staticmethod
    def _through(tables: np.ndarray, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        part = lambda k: tables[which, k, x >> np.uint32(8 * k) & np.uint32(255)]
        return part(0) ^ part(1) ^ part(2) ^ part(3)


def features(texts: pa.Array, checksums: Checksums, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each n-gram, text that it stands in, number of words of each text). ``texts``: large_string without nulls."""
    words = words_of(texts, BY_SIGN)
    plain = np.fromiter(map(zlib.crc32, words.distinct), np.uint32, len(words.distinct))[words.code]
    spaced = np.fromiter((zlib.crc32(b" " + w) for w in words.distinct), np.uint32, len(words.distinct))[words.code]
    length = np.fromiter(map(len, words.distinct), np.int64, len(words.distinct))[words.code] + 1
    sums, of = [plain], [words.text]
    run = plain
    for n in range(1, longest):
        if len(run) < 2:
            break
        inside = words.text[: len(words.text) - n] == words.text[n:]  # the last word is of the same text
        run = checksums.joined(run[:-1], spaced[n:], length[n:])
        sums.append(run[inside])
        of.append(words.text[n:][inside])
    return np.concatenate(sums) % np.uint32(buckets), np.concatenate(of), words.counts()


def _texts(docs: DataFrame, *columns: Column) -> DataFrame:
    return small_batches(docs).select(*columns, F.make_valid_utf8(F.coalesce(F.col("text"), F.lit(""))).alias("text"))


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """N-grams of all texts in each bucket. A task sends a row for each bucket that it met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, checksums = np.zeros(buckets, np.int64), Checksums()
        for b in batches:
            texts = b.column(0).cast(pa.large_string())
            for begin, to in slices(texts):
                total += np.bincount(features(texts.slice(begin, to - begin), checksums, buckets, longest)[0], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["bucket", "n"])

    rows = _texts(docs).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # one for each bucket at most
    out = np.zeros(buckets, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket a thousand times the logarithm of the target's share over the source's, one added to each count, rounded down."""
    k = len(source)
    s, t = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A thousand times a Gumbel variate of the id, rounded down: the highest sums of weight and noise are a draw without replacement."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def scores(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score): one row for each row of ``docs``."""
    buckets = len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        checksums = Checksums()
        for b in batches:
            doc_id, texts = b.column(0), b.column(1).cast(pa.large_string())
            for begin, to in slices(texts):
                bucket, of, n_words = features(texts.slice(begin, to - begin), checksums, buckets, longest)
                order = np.argsort(of, kind="stable")
                running = np.r_[0, np.cumsum(gain[bucket[order]])]  # whole numbers: no sum is rounded
                n = np.bincount(of, minlength=to - begin)
                ends = np.cumsum(n)
                columns = [doc_id.slice(begin, to - begin), *map(pa.array, (n_words, n, running[ends] - running[ends - n]))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    rows = _texts(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    return rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def score_offsets(scored: DataFrame) -> DataFrame:
    """(score, n, above): the exact histogram of the scores, with how many rows have a higher one.

    Suffix sums in two steps, of the bins of 2^STEP scores and inside each bin, so no task gets more
    than a bin's scores or all bins.
    """
    histogram = save(scored.groupBy("score").agg(F.count("*").alias("n")).withColumn("bin", F.shiftright("score", STEP)), "histogram")
    higher = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = histogram.groupBy("bin").agg(F.sum("n").alias("n")).select("bin", higher(Window.orderBy(F.desc("bin"))).alias("above_bin"))
    inside = histogram.withColumn("inside", higher(Window.partitionBy("bin").orderBy(F.desc("score"))))
    out = save(inside.join(bins, "bin").select("score", "n", (F.col("above_bin") + F.col("inside")).alias("above")), "offsets")
    drop(histogram)
    return out


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of ``scored``, a table of :func:`scores`; rank is null for what is not drawn."""
    fit = scored.where(F.col("n_words") >= least_words)
    offsets = score_offsets(fit)
    draw = percent * (offsets.agg(F.sum("n")).first()[0] or 0) // 100
    surviving = offsets.where(F.col("above") < draw).select("score", "above")
    cutoff = surviving.agg(F.min("score")).first()[0]
    columns = [F.col(c) for c in ("doc_id", "n_features", "weight", "score")]
    if cutoff is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    high = (F.col("n_words") >= least_words) & (F.col("score") >= cutoff)
    out = scored.where(~high).select(*columns, F.lit(None).cast("long").alias("rank"))
    # rows that are equal in all that is returned are counted, not gathered
    rows = scored.where(high).groupBy(*columns).agg(F.count("*").alias("copies"))
    within = Window.partitionBy("score").orderBy("doc_id", "n_features", "weight")
    before = F.coalesce(F.sum("copies").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # row_number less one, where no row is repeated
    placed = rows.join(surviving, "score").withColumn("first", F.col("above") + before + 1)
    parts = placed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
    each = F.sequence(F.col("part") * COPIES, F.least(F.col("copies"), (F.col("part") + 1) * COPIES) - 1)
    drawn = parts.withColumn("nth", F.explode(each)).withColumn("rank", F.col("first") + F.col("nth"))
    return out.unionByName(drawn.select(*columns, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank")))


def importance_ranks(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): one row for each row of ``docs``, drawn towards the texts of ``target``.

    Of the N documents with at least ``least_words`` words the highest N * percent // 100 scores are
    drawn and ranked from 1; equal scores go by doc_id, nulls first. Null and empty texts have no
    feature and weight 0; a null doc_id is drawn by the hash of no id; repeated rows each have a
    rank of their own; extra columns are ignored; no rows give no rows, and without target texts
    only the source's own counts tell.
    """
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    return ranked(save(scores(docs, gain, longest, seed), "scores"), percent, least_words)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, **options) -> DataFrame:
    """The rows of ``docs`` whose id has a drawn row in :func:`importance_ranks`, whole and with all columns."""
    drawn = importance_ranks(docs, target, percent, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(drawn, docs.doc_id.cast("long").eqNullSafe(F.col("__drawn")), "left_semi")
