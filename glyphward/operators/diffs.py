"""Differences of two texts as hunks of lines, and patching by them."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphward.functions.text import let

HUNK = "struct<old_start:int,old_lines:array<string>,new_start:int,new_lines:array<string>>"


def changed_blocks(old: list[str], new: list[str]) -> list[tuple[int, int, int, int]]:
    """(old start, old end, new start, new end) of what differs, by patience: lines that stand once in both are the anchors, of which the longest run in the order of both is kept; what lies between is looked at again. A block without anchors differs as a whole."""
    out, stack = [], [(0, len(old), 0, len(new))]
    while stack:
        a, b, c, d = stack.pop()
        while a < b and c < d and old[a] == new[c]:
            a, c = a + 1, c + 1
        while a < b and c < d and old[b - 1] == new[d - 1]:
            b, d = b - 1, d - 1
        if a == b and c == d:
            continue
        once_old, once_new = Counter(old[a:b]), Counter(new[c:d])
        at = {line: j for j, line in enumerate(new[c:d], c) if once_new[line] == 1}
        pairs = [(i, at[line]) for i, line in enumerate(old[a:b], a) if once_old[line] == 1 and line in at]
        kept = _increasing(pairs)
        if not kept:
            out.append((a, b, c, d))
            continue
        before_old, before_new = a, c
        for i, j in [*kept, (b, d)]:
            stack.append((before_old, i, before_new, j))
            before_old, before_new = i + 1, j + 1
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, which are ordered by the first number, in which the second grows too."""
    ends: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(ends, j)
        before.append(at[k - 1] if k else -1)
        ends[k:], at[k:] = [j, *ends[k + 1 :]], [n, *at[k + 1 :]]
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def with_hunks(df: DataFrame, before: str, after: str, out: str = "hunks") -> DataFrame:
    """``df`` with array column ``out``: where lines of column ``before`` give way to lines of ``after``, from 0 and in order; none for equal texts. A null text counts as empty."""
    names = df.columns
    kind = T._parse_datatype_string(f"array<{HUNK}>")
    arrow = pa.list_(pa.struct([("old_start", pa.int32()), ("old_lines", pa.list_(pa.string())), ("new_start", pa.int32()), ("new_lines", pa.list_(pa.string()))]))

    def hunks(a: str | None, b: str | None) -> list[dict]:
        old, new = (a or "").split("\n"), (b or "").split("\n")
        return [{"old_start": i, "old_lines": old[i:j], "new_start": k, "new_lines": new[k:m]} for i, j, k, m in changed_blocks(old, new)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(*(batch.column(names.index(c)).to_pylist() for c in (before, after)), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([hunks(*p) for p in pairs], arrow)], names=[*names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, kind)]))


def patched(text: Column, hunks: Column) -> Column:
    """``text`` with the old lines of all hunks replaced by the new ones; null where a hunk's old lines do not stand at its place."""

    def apply(lines: Column) -> Column:
        end = lambda i: F.when(i > 0, F.get(hunks, i - 1)["old_start"] + F.size(F.get(hunks, i - 1)["old_lines"])).otherwise(0)
        piece = lambda h, i: F.concat(F.slice(lines, end(i) + 1, F.greatest(h["old_start"] - end(i), F.lit(0))), h["new_lines"])
        rest = F.slice(lines, end(F.size(hunks)) + 1, F.size(lines))
        fits = F.forall(hunks, lambda h: F.slice(lines, h["old_start"] + 1, F.size(h["old_lines"])) == h["old_lines"])
        return F.when(fits, F.array_join(F.concat(F.flatten(F.transform(hunks, piece)), rest), "\n"))

    return let(F.split(F.coalesce(text, F.lit("")), "\n", -1), apply)


def reversed_hunks(hunks: Column) -> Column:
    """The hunks that lead back from the new text to the old."""
    return F.transform(hunks, lambda h: F.struct(h["new_start"].alias("old_start"), h["new_lines"].alias("old_lines"), h["old_start"].alias("new_start"), h["old_lines"].alias("new_lines")))


def hunk_rows(df: DataFrame, key: str, hunks: str = "hunks") -> DataFrame:
    """(key, nth, op, old_start, n_old, new_start, n_new, old_lines, new_lines): a row for each hunk; op is insert, delete or replace."""
    h = df.select(key, F.posexplode(hunks).alias("nth", "h")).select(key, "nth", "h.*")
    op = F.when(F.size("old_lines") == 0, "insert").when(F.size("new_lines") == 0, "delete").otherwise("replace")
    return h.select(key, "nth", op.alias("op"), "old_start", F.size("old_lines").alias("n_old"), "new_start", F.size("new_lines").alias("n_new"), "old_lines", "new_lines")
