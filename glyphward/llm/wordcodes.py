"""Words of many texts at once, as codes into their distinct words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 4 << 20  # bytes of texts that are cut into words together
CAPITALS = np.arange(ord("A"), ord("Z") + 1)


def byte_table(separators: np.ndarray) -> np.ndarray:
    """For each byte what it counts as: A-Z as small letters, the given separators as a space."""
    table = np.arange(256, dtype=np.uint8)
    table[CAPITALS] += 32
    table[separators] = ord(" ")
    return table


# words [^\x20\x09-\x0D]+
BY_SPACE = byte_table(np.r_[9:14])
# words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, after A-Z have become small
BY_SIGN = byte_table(np.r_[0x00:0x30, 0x3A:0x41, 0x5B:0x61, 0x7B:0x80])


@dataclass
class Words:
    """The words of some texts in a row: ``code`` of each, ``text`` that it stands in, and the distinct words."""

    code: np.ndarray
    text: np.ndarray
    distinct: list[bytes]
    texts: int

    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.bincount(self.text, minlength=self.texts)


def words_of(texts: pa.Array, table: np.ndarray) -> Words:
    """``texts``: large_string without nulls. Words are what the spaces of ``table`` part."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    held = table[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] if data is not None else np.zeros(0, np.uint8)
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(ends - ends[0])), pa.py_buffer(held))
    split = pc.ascii_split_whitespace(plain)
    flat = split.flatten().dictionary_encode()
    code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy(zero_copy_only=False))
    distinct = flat.dictionary.cast(pa.large_binary()).to_pylist()
    if b"" in distinct:  # beside white space at the ends of a text
        real = code != distinct.index(b"")
        code, text = code[real], text[real]
    return Words(code, text, distinct, len(texts))


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE bytes; a longer text makes one of its own."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE)))
        yield at, to
        at = to
