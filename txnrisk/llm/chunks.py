"""Token ids of many texts at once, through a table of the chunks between spaces.

The tokenizers here cut a text into words before merging, and no word reaches
from a character that is not a space into a following space. A text may therefore
be cut before every space that has a non-space after it, and each piece encoded
by itself. Pieces repeat, so a worker encodes each distinct one once and keeps it
in a table of bounded size; the work per text is a dictionary encoding in Arrow
and a gather in numpy.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once within a task.
SLICE_BYTES = 4 << 20
#: Fixed value: how byte-level BPE files split text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space that may start a new piece: the tokenizers' white space is a subset of Python's.
SAFE_SPACE = re.compile(r" (?=\S)")

Encode = Callable[[Sequence[str]], tuple[np.ndarray, np.ndarray]]


class Pool:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.data = np.zeros(1 << 16, dtype)
        self.size = 0

    def add(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.data):
            grown = np.zeros(max(need, 2 * len(self.data)), self.data.dtype)
            grown[: self.size] = self.data[: self.size]
            self.data = grown
        self.data[self.size : need] = values
        self.size = need


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The concatenation of ``data[s:s+n]`` over all (start, length)."""
    total = int(length.sum())
    before = np.cumsum(length) - length
    at = np.repeat(start - before, length)
    at += np.arange(total)
    return data[at]


class ChunkTable:
    """Encodes texts; remembers up to ``limit`` distinct chunks.

    ``encode`` takes strings and returns their ids in one flat array and the number
    of ids of each. With ``space`` a chunk that is not the first of its text is
    encoded with the space before it; without, spaces carry nothing. ``fold`` says
    that A-Z and a-z encode alike, but in texts that match ``special``.
    """

    def __init__(self, encode: Encode, space: bool, fold: bool = False, limit: int = 500_000, special: str = ""):
        self.encode, self.space, self.fold, self.limit, self.special = encode, space, fold, limit, special
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids, self.start, self.length = Pool(np.uint32), Pool(np.int64), Pool(np.int64)

    def _slots(self, keys: list[str]) -> np.ndarray:
        """Positions of keys; a key that starts with a space is encoded with it."""
        known = self.slots
        new = [k for k in dict.fromkeys(keys) if k not in known]
        if new:
            ids, lengths = self.encode(new)
            first = self.start.size
            self.start.add(self.ids.size + np.cumsum(lengths) - lengths)
            self.length.add(lengths)
            self.ids.add(ids)
            known.update(zip(new, range(first, first + len(new))))
        return np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of each text."""
        if len(self.slots) > self.limit or self.ids.size > 16 * self.limit:
            self.clear()
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.fold:
            lower = pc.ascii_lower(texts)
            # the strings of special tokens are found in the text as it is
            texts = pc.if_else(pc.match_substring_regex(texts, self.special), texts, lower) if self.special else lower
        parts = pc.split_pattern(texts, " ")
        offsets, codes, words = _coded(parts)
        if self.space:
            odd = np.fromiter((not w or w[0].isspace() for w in words), bool, len(words))[codes]
            odd[offsets[:-1]] = False
            odd_text = np.logical_or.reduceat(odd, offsets[:-1])
            if odd_text.any():
                at = np.flatnonzero(odd_text)
                fixed = [SAFE_SPACE.split(t) for t in texts.take(pa.array(at)).to_pylist()]
                order = np.argsort(np.concatenate([np.flatnonzero(~odd_text), at]))
                both = [parts.filter(pa.array(~odd_text)), pa.array(fixed, parts.type)]
                offsets, codes, words = _coded(pa.concat_arrays(both).take(pa.array(order)))
            heads = [words[c] for c in codes[offsets[:-1]]]
            slots = self._slots([" " + w for w in words])[codes]
            slots[offsets[:-1]] = self._slots(heads)
        else:
            slots = self._slots(words)[codes]
        lengths = self.length.data[slots]
        return (
            gather(self.ids.data, self.start.data[slots], lengths),
            np.add.reduceat(lengths, offsets[:-1]),
        )


def _coded(parts: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    coded = parts.flatten().dictionary_encode()
    offsets = parts.offsets.to_numpy()
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    return offsets - offsets[0], coded.indices.to_numpy(), words


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive texts of about ``limit`` bytes each (or one longer text), with the first row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // limit
    begins = np.flatnonzero(np.diff(group, prepend=-1))
    for begin, end in zip(begins, [*begins[1:], len(sizes)]):
        yield int(begin), pc.fill_null(texts.slice(begin, end - begin), "")


def safe_pieces(text: str, limit: int) -> list[str]:
    """``text`` cut into pieces of at least ``limit`` characters at spaces that allow it."""
    pieces, begin = [], 0
    while cut := SAFE_SPACE.search(text, begin + limit):
        pieces.append(text[begin : cut.start()])
        begin = cut.start()
    return [*pieces, text[begin:]]


def library_encoder(path: str, specials: bool = True) -> Encode:
    """Encoding by the tokenizers library, in the task's own thread.

    Without ``specials`` the strings of special tokens are plain text.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = not specials

    def encode(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, lengths = [], np.zeros(len(texts), np.int64)
        for at in range(0, len(texts), 4096):
            ids = [e.ids for e in tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)]
            lengths[at : at + len(ids)] = [len(x) for x in ids]
            flat.append(np.fromiter((i for x in ids for i in x), np.uint32))
        return np.concatenate(flat) if flat else np.zeros(0, np.uint32), lengths

    return encode


#: Characters below are read alike by every version of Unicode; chunks with others go to the library.
STABLE = 0x250


def _rank_names(spec: dict, end: str) -> dict[bytes, int] | None:
    """Token bytes by id if ids follow the merge order, the end mark as byte 255; else None."""
    vocab, byte = spec["model"]["vocab"], {c: b for b, c in enumerate(byte_letters())}
    special = {t["content"] for t in spec["added_tokens"]}

    def raw(name: str) -> bytes:
        marked = bool(end) and name.endswith(end)
        return bytes(byte[c] for c in name.removesuffix(end if marked else "")) + b"\xff" * marked

    merged = ["".join(m if isinstance(m, list) else m.split(" ", 1)) for m in spec["model"]["merges"]]
    if end:
        merged = [m[: -len(end)].replace(end, "") + end if m.endswith(end) else m for m in merged]
    ids = [vocab[m] for m in merged]
    if ids != list(range(ids[0], ids[0] + len(ids))) if ids else True:
        return None
    return {raw(n): i for n, i in vocab.items() if n not in special}


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level file."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters, spare = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


def byte_encoder(path: str, specials: bool = True) -> Encode:
    """As ``library_encoder`` for a byte-level file, several times as fast on many short chunks.

    Chunks that start with a space are joined and encoded in one call of tiktoken
    with the merges of the same file; the lengths of the tokens in bytes tell where
    each chunk ends. Chunks with special strings or characters beyond ``STABLE``
    go to the tokenizers library.
    """
    import tiktoken

    library, spec = library_encoder(path, specials), json.loads(Path(path).read_text())
    names = _rank_names(spec, "")
    if names is None:
        return library
    joined_call = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=names, special_tokens={}).encode_to_numpy
    size = np.zeros(max(names.values()) + 1, np.int64)
    size[list(names.values())] = [len(n) for n in names]
    special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"] if specials) or r"(?!)")

    def encode(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.fromiter((
            len(t) > 1 and t[0] == " " and not t[1].isspace()
            and (t.isascii() or max(t) < chr(STABLE)) and not special.search(t) for t in texts
        ), bool, len(texts))
        easy = [t for t, p in zip(texts, plain) if p]
        flat, lengths = [], np.zeros(len(texts), np.int64)
        counts = [np.zeros(0, np.int64)]
        for at in range(0, len(easy), 8192):
            part = easy[at : at + 8192]
            ids = joined_call("".join(part))
            ends = np.cumsum([len(t) if t.isascii() else len(t.encode()) for t in part])
            counts.append(np.diff(np.searchsorted(np.cumsum(size[ids]), ends, side="right"), prepend=0))
            flat.append(ids)
        lengths[plain] = np.concatenate(counts)
        if len(easy) == len(texts):
            return np.concatenate(flat).astype(np.uint32) if flat else np.zeros(0, np.uint32), lengths
        hard, hard_lengths = library([t for t, p in zip(texts, plain) if not p])
        lengths[~plain] = hard_lengths
        both = np.concatenate([*flat, hard]).astype(np.uint32)
        sizes = np.concatenate([lengths[plain], hard_lengths])
        order = np.argsort(np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)]))
        return gather(both, (np.cumsum(sizes) - sizes)[order], sizes[order]), lengths

    return encode


def word_encoder(path: str) -> Encode:
    """As ``library_encoder`` for a file with word ends, several times as fast.

    Lower-cased words are merged by tiktoken with the rules of the same file, byte
    255 (never part of UTF-8) in place of the end mark. Special strings and
    characters beyond ``STABLE`` go to the tokenizers library.
    """
    import unicodedata

    import regex
    import tiktoken

    library, spec = library_encoder(path), json.loads(Path(path).read_text())
    names = _rank_names(spec, spec["model"]["end_of_word_suffix"])
    if names is None:
        return library
    # the single bytes and the ended bytes come before all merges
    singles = [bytes([b]) for b in range(256)]
    ended = [s + b"\xff" for s in singles if s + b"\xff" in names]
    others = sorted((n for n in names if len(n) > 2 or (len(n) == 2 and n[1] != 255)), key=names.get)
    order = {n: i for i, n in enumerate([*singles, *ended, *others])}
    real = [names.get(n, -1) for n in order]
    merge = tiktoken.Encoding("file", pat_str=r"(?s).+", mergeable_ranks=order, special_tokens={})._core_bpe
    special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)", re.I)
    ascii_words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.A).findall
    all_words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
    known: dict[str, list[int]] = {}

    def encode(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(known) > 400_000:
            known.clear()
        flat: list[int] = []
        lengths = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            if special.search(t) or not (t.isascii() or max(t) < chr(STABLE)):
                ids, _ = library([t])
                flat.extend(ids.tolist())
                lengths[k] = len(ids)
                continue
            if t.isascii():
                words = ascii_words(t.lower())
            else:
                words = all_words("".join(map(str.lower, unicodedata.normalize("NFC", t))))
            n = len(flat)
            for w in words:
                ids = known.get(w)
                if ids is None:
                    ids = known[w] = [real[i] for i in merge.encode_single_piece(w.encode() + b"\xff")]
                flat.extend(ids)
            lengths[k] = len(flat) - n
        return np.array(flat, np.uint32), lengths

    return encode


_TABLES: dict[tuple, ChunkTable] = {}


def table(kind: str, path: str, make: Callable[[], ChunkTable]) -> ChunkTable:
    """The worker's table, kept for its next tasks."""
    if (kind, path) not in _TABLES:
        _TABLES[kind, path] = make()
    return _TABLES[kind, path]


def library(path: str) -> ChunkTable:
    """Table for a byte-level BPE file, by the tokenizers library alone."""
    return table("library", path, lambda: ChunkTable(library_encoder(path), space=True))


def byte_level(path: str) -> ChunkTable:
    """Table for a byte-level BPE file whose words take one space before them."""
    return table("byte", path, lambda: ChunkTable(byte_encoder(path), space=True))


def word_end(path: str) -> ChunkTable:
    """Table for a BPE file that lowers case and drops white space."""
    found = [t["content"] for t in json.loads(Path(path).read_text())["added_tokens"]]
    special = "(?i)" + "|".join(re.escape(c) for c in found) if found else ""
    return table("word", path, lambda: ChunkTable(word_encoder(path), space=False, fold=True, special=special))
