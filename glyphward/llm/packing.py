"""Packing tokenised documents into fixed-length sequences, shortest pack first over the length histogram."""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphward.llm.tables import drop, save, small_batches
from glyphward.llm.worker import held

YOUNG_WORDS = 100_000  # cached words of a Python worker that are kept for sure; as many older ones may be there
SLICE = 4 << 20  # bytes of texts that are cut into words together
MARKS = ".,!?;:*&%#$"  # that may close a word; none of them is a letter, a number or an apostrophe
MOST_MARKS = 4


class WordTokens:
    """Token ids of texts, word by word: the vocabulary drops white space, so the ids of a text are those of its words in turn.

    Words are cut at ASCII white space only, and only distinct ones are tokenised. A word of plain
    Latin letters with closing marks goes to the merge model directly, as letters and marks are
    separate pieces; every other word takes the whole tokenizer with its normaliser and splitter.
    The cache has two generations: what is used moves to the young one, and when that is full it
    becomes the old one, so words that come again stay and the others are forgotten.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.byte_letters = {b: chr(b if b in printable else next(rest)) for b in range(256)}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each with ``end_id`` behind it; where each text ends). ``texts``: large_string without nulls."""
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        ids, sizes = self._distinct(words.dictionary)
        sizes = np.r_[sizes, 1]  # the end id stands behind the distinct words
        ids = np.r_[ids, np.array([end_id], "<u4")]
        counts = split.value_lengths().to_numpy(zero_copy_only=False)
        code = np.insert(words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(counts), len(sizes) - 1)
        ends = np.cumsum(sizes[code])
        last = np.cumsum(counts + 1) - 1
        return _gather(ids, np.cumsum(sizes) - sizes, sizes, code), ends[last]

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct words in a row, number of ids of each)."""
        words = words.cast(pa.large_string())
        stems = pc.ascii_rtrim(words, characters=MARKS)
        marks = (pc.binary_length(words).to_numpy(zero_copy_only=False) - pc.binary_length(stems).to_numpy(zero_copy_only=False)).astype(np.int64)
        plain = pc.ascii_is_alpha(stems).to_numpy(zero_copy_only=False).astype(bool) & (marks <= MOST_MARKS)
        # pieces: letters in small case, closing marks, and all other words as they are
        begin = pc.if_else(pa.array(plain), pc.ascii_lower(stems), words).dictionary_encode()
        parts, first = [begin.dictionary], begin.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        then = np.full(len(words), -1, np.int64)
        n = len(begin.dictionary)
        for k in range(1, MOST_MARKS + 1):
            at = np.flatnonzero(plain & (marks == k))
            if len(at):
                tails = pc.utf8_slice_codeunits(words.take(pa.array(at)), -k).dictionary_encode()
                then[at] = n + tails.indices.to_numpy(zero_copy_only=False)
                parts.append(tails.dictionary)
                n += len(tails.dictionary)
        found = [x for part in parts for x in self._ids_of(part.to_pylist())] + [b""]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = np.frombuffer(b"".join(found), "<u4")
        code = np.stack([first, then], axis=1).ravel()  # -1: the empty piece at the end
        code[code < 0] = len(found) - 1
        return _gather(ids, np.cumsum(sizes) - sizes, sizes, code), sizes[code].reshape(-1, 2).sum(axis=1)

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        young, old, out = self.young, self.old, []
        for p in pieces:
            ids = young.get(p)
            if ids is None:
                ids = old.get(p)
                young[p] = ids = self._tokenise(p) if ids is None else ids
            out.append(ids)
        if len(young) > YOUNG_WORDS:
            self.young, self.old = {}, young
        return out

    def _tokenise(self, word: str) -> bytes:
        if word.isalpha() and max(word) < "ɐ" and (low := word.lower()).isalpha():
            letters = low if low.isascii() else "".join([self.byte_letters[b] for b in low.encode()])
            return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        stem = word.rstrip(MARKS)
        if stem != word and stem.isalpha() and max(stem) < "ɐ" and stem.lower().isalpha():
            return b"".join(self._ids_of([stem, word[len(stem) :]]))
        return array("I", self.whole.encode(word, add_special_tokens=False).ids).tobytes()


def _gather(ids: np.ndarray, first: np.ndarray, sizes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The runs of ``ids`` that ``code`` names, in a row; run c is ``sizes[c]`` long from ``first[c]``."""
    n = sizes[code]
    ends = np.cumsum(n)
    return ids[np.repeat(first[code] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE)))
        yield at, to
        at = to


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, digest: bool = False) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, part, nth): the tokens of each document and ``end_id``, cut every ``capacity`` tokens.

    ids: little-endian unsigned 32 bits; with ``digest`` there is ids_crc32, their unsigned checksum,
    instead. part and nth number the pieces of a length within a task. Null text counts as empty and
    gives one piece, the end id; bytes that are not UTF-8 count as U+FFFD; repeated rows each give
    theirs; rows with a null doc_id stay; extra columns are ignored.
    """
    content = "ids_crc32" if digest else "ids"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held(("tokens", tokenizer_path), lambda: WordTokens(tokenizer_path))
        part, counts = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            doc_id, texts = b.column(0), b.column(1).cast(pa.large_string())
            for begin, to in _slices(texts):
                ids, ends = words.encode(texts.slice(begin, to - begin), end_id)
                tokens = np.diff(ends, prepend=0)
                number = -(-tokens // capacity)
                row = np.repeat(np.arange(len(tokens)), number)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)) * capacity
                length = np.minimum(capacity, tokens[row] - start)
                first = (ends - tokens)[row] + start
                held_ids = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                runs = [held_ids[4 * a : 4 * (a + n)] for a, n in zip(first.tolist(), length.tolist(), strict=True)]
                values = pa.array([zlib.crc32(r) for r in runs], pa.int64()) if digest else pa.array([bytes(r) for r in runs], pa.binary())
                columns = [doc_id.slice(begin, to - begin).take(pa.array(row)), start, length, values, tokens[row], np.full(len(row), part, np.int32), _running(length, counts)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["doc_id", "start", "length", content, "doc_tokens", "part", "nth"])

    text = F.make_valid_utf8(F.coalesce(F.col("text"), F.lit(""))).alias("text")
    schema = f"doc_id long, start long, length long, {content} {'long' if digest else 'binary'}, doc_tokens long, part int, nth long"
    return small_batches(docs).select(F.col("doc_id").cast("long"), text).mapInArrow(cut, schema)


def _running(length: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many equal lengths were before each, in ``counts`` and here; ``counts`` is brought up to date."""
    order = np.argsort(length, kind="stable")
    ordered = length[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(order) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[first, len(order)])
    out = np.empty(len(length), np.int64)
    out[order] = counts[ordered] + np.arange(len(order)) - np.repeat(first, sizes)
    counts[ordered[first]] += sizes
    return out


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths in order, how many sequences have them) for all lengths of ``histogram``.

    Lengths go in from the longest down, all packs with one pattern at a time; each goes to the
    pattern with the most space left, that is to the shortest packs. What fits in none opens new
    packs and fills them with pieces of its own length, so a common length shares its sequences too.
    A length adds two patterns at most, full packs and one with the rest, or one where it splits a
    pattern, so their number is at most twice that of the lengths, whatever the number of documents.
    """
    open_packs: dict[int, list[tuple[list[int], int]]] = {}
    spaces: list[int] = []  # negated, a heap

    def put(lengths: list[int], count: int, space: int) -> None:
        if space not in open_packs:
            open_packs[space] = []
            heapq.heappush(spaces, -space)
        open_packs[space].append((lengths, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = -spaces[0] if spaces else -1
            if space < length:
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    put([length] * each, full, capacity - each * length)
                if rest:
                    put([length] * rest, 1, capacity - rest * length)
                break
            lengths, count = open_packs[space].pop()
            if not open_packs[space]:
                del open_packs[space]
                heapq.heappop(spaces)
            used = min(left, count)
            if used < count:
                put(lengths, count - used, space)
            put([*lengths, length], used, space - length)
            left -= used
    return sorted((p for packs in open_packs.values() for p in packs), key=lambda p: (p[0], p[1]))


def place(parts: DataFrame, capacity: int = 4096) -> DataFrame:
    """``parts`` (length, part, nth and any others) with sequence_id and offset instead of part and nth.

    The driver holds the histogram (a count for each of at most ``capacity`` lengths) and the
    patterns, never pieces. The rank of a piece among those of its length is its number in its task
    plus the counts of the tasks before, so no length, however common, is sorted or gathered.
    """
    kept = save(parts, "pieces")
    counts = save(kept.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    firsts: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for lengths, count in shortest_pack_first(histogram, capacity):
        offset = 0
        for length in lengths:
            firsts.setdefault(length, []).append((taken.get(length, 0), sequence, offset))
            taken[length] = taken.get(length, 0) + count
            offset += length
        sequence += count
    slots = {length: np.array(rows, np.int64).T for length, rows in firsts.items()}

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = save(counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")), "earlier")
    drop(counts)
    # merged at every size: there are as many counts as tasks and lengths, so they are no table to broadcast
    ranked = kept.join(earlier.hint("merge"), ["part", "length"]).withColumn("nth", F.col("nth") + F.col("earlier")).drop("part", "earlier")
    names = ranked.columns
    out = T.StructType([f for f in ranked.schema.fields if f.name != "nth"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(names.index(c)).to_numpy() for c in ("length", "nth"))
            sequence_id, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for same in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                first, base, at = slots[int(length[same[0]])]
                k = np.searchsorted(first, rank[same], "right") - 1
                sequence_id[same], offset[same] = base[k] + rank[same] - first[k], at[k]
            columns = [b.column(i) for i, c in enumerate(names) if c != "nth"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence_id), pa.array(offset)], names=out.names)

    return ranked.mapInArrow(look_up, out)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """Every piece of every document with its token ids, its sequence and its offset there."""
    return place(pieces(docs, tokenizer_path, capacity, end_id), capacity)


def pack_digests(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """As :func:`pack`, with ids_crc32 (unsigned) instead of the ids, which never leave the Python workers."""
    return place(pieces(docs, tokenizer_path, capacity, end_id, digest=True), capacity).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
