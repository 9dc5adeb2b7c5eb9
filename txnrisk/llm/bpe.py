"""Operator 9: byte-level BPE encoding and decoding by merge rounds in numpy.

The distinct words of a batch lie behind each other in one array of symbols. A
round looks up the rank of every pair of neighbours by binary search over the
sorted pair keys, takes the lowest rank of each word and merges that pair wherever
the word has it; words without a known pair are done. Decoding concatenates the
bytes of the tokens.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from txnrisk.llm import chunks
from txnrisk.llm.tables import text_rows

WORDS = regex.compile(chunks.WORDS)
NONE = np.int64(1) << 40
#: Words of more symbols are merged one pair at a time, by a heap, instead of in rounds.
LONG_WORD = 4096


class Merges:
    """Merge rules and token bytes of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text())
        vocab = spec["model"]["vocab"]
        letters = chunks.byte_letters()
        self.of_byte = np.array([vocab[c] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # longest first, as the library prefers at the same place
        found = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, found)) + ")") if found else None
        byte = {c: b for b, c in enumerate(letters)}
        names = {i: s for s, i in [*vocab.items(), *self.special.items()]}
        raw = [bytes(byte[c] for c in names[i]) if i in names else b"" for i in range(max(names) + 1)]
        self.length = np.array([len(r) for r in raw], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def words(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the number of ids of each (no empty words)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        done_sym, done_word = [], []
        for w in np.flatnonzero(size > LONG_WORD):
            ids = self._long(sym[word == w])
            done_sym.append(ids)
            done_word.append(np.full(len(ids), w))
            sym, word = sym[word != w], word[word != w]
        rank = self._ranks(sym, word)
        while len(sym):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            size = np.diff(first, append=len(sym))
            best = np.repeat(np.minimum.reduceat(rank, first), size)
            open_ = best < NONE
            if not open_.all():
                done_sym.append(sym[~open_])
                done_word.append(word[~open_])
                sym, word, rank, best = sym[open_], word[open_], rank[open_], best[open_]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == best)
            # of overlapping pairs (aaa) the first, third, ... of a run merge
            run = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
            if len(run) < len(hit):
                nth = np.arange(len(hit)) - np.repeat(run, np.diff(run, append=len(hit)))
                hit = hit[nth % 2 == 0]
            sym[hit] = self.result[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, word, rank = sym[keep], word[keep], rank[keep]
            merged = np.cumsum(keep)[hit] - 1
            touched = np.zeros(len(sym), bool)
            touched[merged] = True
            touched[np.maximum(merged - 1, 0)] = True
            stale = np.flatnonzero(touched)
            rank[stale] = self._ranks_at(sym, word, stale)
        all_word = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        all_sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
        order = np.argsort(all_word, kind="stable")
        return all_sym[order], np.bincount(all_word, minlength=len(words)).astype(np.int64)

    def _ranks(self, sym: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self._ranks_at(sym, word, np.arange(len(sym)))

    def _ranks_at(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pair that starts at each position; NONE at the end of a word."""
        if not len(at):
            return np.zeros(0, np.int64)
        after = np.minimum(at + 1, len(sym) - 1)
        rank = self.ranks(sym[at], sym[after])
        rank[(word[after] != word[at]) | (after == at)] = NONE
        return rank

    def _long(self, sym: np.ndarray) -> np.ndarray:
        """Ids of one long word: lowest rank first, then leftmost, from a heap."""
        ids = sym.tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        known = self._pair_ranks()
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1)
                if (r := known.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.result[r]), -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (q := known.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return np.array([i for i in ids if i >= 0], np.int64)

    def _pair_ranks(self) -> dict[tuple[int, int], int]:
        if not hasattr(self, "_known"):
            left, right = self.keys >> 32, self.keys & 0xFFFFFFFF
            self._known = dict(zip(zip(left.tolist(), right.tolist()), self.rank.tolist()))
        return self._known

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each."""
        slot: dict[str, int] = {}
        flat: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        for t, text in enumerate(texts):
            for part in self.cut.split(text) if self.cut and self.cut.search(text) else (text,):
                if part in self.special:
                    flat.append(-1 - self.special[part])
                    counts[t] += 1
                else:
                    found = WORDS.findall(part)
                    flat.extend([slot.setdefault(w, len(slot)) for w in found])
                    counts[t] += len(found)
        ids, sizes = self.words([w.encode() for w in slot])
        specials = sorted(set(self.special.values()))
        ids = np.concatenate([ids, np.array(specials, np.int64)])
        sizes = np.concatenate([sizes, np.ones(len(specials), np.int64)])
        own = {-1 - s: len(slot) + k for k, s in enumerate(specials)}
        at = np.fromiter((own[f] if f < 0 else f for f in flat), np.int64, len(flat))
        lengths = sizes[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        stop = np.cumsum(counts)
        per_text = ends[stop] - ends[stop - counts]
        starts = np.cumsum(sizes) - sizes
        return chunks.gather(ids, starts[at], lengths).astype(np.uint32), per_text

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens; text is their UTF-8 reading, bad bytes replaced."""
        ids = ids.astype(np.int64)
        return chunks.gather(self.bytes, self.start[ids], self.length[ids]).tobytes()


_MERGES: dict[str, Merges] = {}


def merges(path: str) -> Merges:
    if path not in _MERGES:
        _MERGES[path] = Merges(path)
    return _MERGES[path]


def round_trip(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """Per document n_tokens and the sha256 of its ids and of the text decoded from them.

    With ``keep_ids`` also ids (little-endian unsigned 32-bit) and decoded. A null
    text counts as empty. One row per input row, repeated ids included.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids binary, decoded string" if keep_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = merges(path)
        table = chunks.table("merges", path, lambda: chunks.ChunkTable(rules.encode, space=True))
        for batch in batches:
            for begin, part in chunks.slices(batch.column("text")):
                ids, counts = table.texts(part)
                ids = ids.astype("<u4")
                stop = np.cumsum(counts)
                raw, ends = rules.decode(ids), np.cumsum(rules.length[ids])
                ends = np.concatenate([[0], ends])
                rows: list[tuple] = []
                for a, b in zip((stop - counts).tolist(), stop.tolist()):
                    own = ids[a:b].tobytes()
                    text = raw[ends[a] : ends[b]].decode("utf-8", "replace")
                    row = (b - a, hashlib.sha256(own).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                    rows.append((*row, own, text) if keep_ids else row)
                columns = [batch.column("doc_id").slice(begin, len(part)), *map(pa.array, zip(*rows))]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    return text_rows(docs).mapInArrow(run, schema)
