"""Words of many texts at once: runs of bytes that are no separators, A-Z in lower case.

Separators are ASCII, so bytes decide: every byte of a character beyond ASCII
belongs to a word. The bytes of all words lie behind each other in one Arrow array,
which Arrow's dictionary encoding compares byte by byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER_AZ = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def byte_table(extra: bytes = b"") -> np.ndarray:
    """The byte that a word holds for each byte of a text, zero for separators.

    Letters and bytes beyond ASCII belong to words, ``extra`` does too.
    """
    table = np.zeros(256, np.uint8)
    table[128:] = np.arange(128, 256)
    letters = np.arange(ord("a"), ord("z") + 1)
    table[letters] = table[letters - 32] = letters
    own = np.frombuffer(extra, np.uint8)
    table[own] = own
    return table


LETTERS = byte_table()
LETTERS_DIGITS = byte_table(b"0123456789")


def split(texts: pa.Array, table: np.ndarray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """Distinct words, the number of the word at each place, and how many places each text has."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    folded = table[raw]
    inside = folded != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = bounds[:-1][bounds[:-1] < len(raw)]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    # a word ends before a separator, before the next text and at the end
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(folded[inside]))
    coded = words.dictionary_encode()
    counts = np.diff(np.searchsorted(starts, bounds))
    return coded.dictionary, coded.indices.to_numpy(), counts
