"""Operator 12: how the tokens of two tokenizers lie over each other.

Texts are cut before single spaces that no token of either tokenizer crosses; each
distinct chunk is encoded by both and aligned once per worker. The tokens of many
chunks, of both sides, become intervals of bytes in one array: sorted by their start
(ties by side), with the running maximum of their ends. A group breaks where a start
reaches the running maximum. Within groups the overlaps of A and B tokens are
expanded; those that end together are links.

The links of every document are written to the shared folder. Counting them over the
corpus and scoring documents by these counts then read that table, not the texts. The
counts travel to the tasks if there are at most ``BROADCAST_PAIRS`` pairs, else the
links of the documents are joined with them.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.functions.scale import salted_join
from txnrisk.llm import chunks
from txnrisk.llm.rans import new_folder
from txnrisk.llm.tables import text_rows
from txnrisk.session import checkpoint

#: Distinct pairs of ids that may travel to every task (12 bytes and a mark each).
BROADCAST_PAIRS = 4_000_000
#: Distinct chunks a worker remembers, and distinct pairs a task counts before it passes them on.
LIMIT, HELD_PAIRS = 200_000, 1 << 20
#: A space between chunks: alone, and with something behind it.
CUT = re.compile(r"(?<=[^ ]) (?=\S)")
#: Bytes of text handled at once: a slice of odd text holds its chunks several times over.
SLICE = 1 << 20
#: Fixed value: the sign that stands for a space in pieces.
SPACE = "▁"


@dataclass
class Side:
    """One tokenizer: ids of chunks that stand behind a space, and the bytes of its tokens."""

    encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]
    start: np.ndarray  # of each token in data
    length: np.ndarray
    data: np.ndarray

    @classmethod
    def of(cls, encode, names: list[bytes]) -> Side:
        length = np.array([len(n) for n in names], np.int64)
        return cls(encode, np.cumsum(length) - length, length, np.frombuffer(b"".join(names), np.uint8))

    def bytes(self, ids: np.ndarray) -> np.ndarray:
        return chunks.gather(self.data, self.start[ids], self.length[ids])


def byte_level(path: str) -> Side:
    """A byte-level BPE file of the tokenizers library; strings of special tokens are plain text."""
    spec = json.loads(Path(path).read_text())
    byte = {c: b for b, c in enumerate(chunks.byte_letters())}
    names = {i: bytes(byte[c] for c in n) for n, i in spec["model"]["vocab"].items() if all(c in byte for c in n)}
    encode = chunks.byte_encoder(path, specials=False)
    return Side.of(lambda texts: encode([" " + t for t in texts]), [names.get(i, b"") for i in range(max(names) + 1)])


def pieces(path: str) -> Side:
    """A sentencepiece file that puts a space before every text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = []
    for i in range(model.get_piece_size()):
        name = model.id_to_piece(i)
        names.append(bytes([int(name[3:-1], 16)]) if model.is_byte(i) else name.replace(SPACE, " ").encode())

    size = np.array([len(n) for n in names], np.int64)

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that may stand behind each other, a space between, are encoded in one call, and cut by bytes."""
        plain = np.fromiter((t[:1] != " " and t[-1:] != " " and SPACE not in t for t in texts), bool, len(texts))
        easy, hard = [t for t, p in zip(texts, plain) if p], [t for t, p in zip(texts, plain) if not p]
        flat, counts = [], []
        for at in range(0, len(easy), 4096):
            part = easy[at : at + 4096]
            ids = np.array(model.encode(" ".join(part), num_threads=1), np.int64)
            ends = np.cumsum([1 + (len(t) if t.isascii() else len(t.encode())) for t in part])
            counts.append(np.diff(np.searchsorted(np.cumsum(size[ids]), ends, side="right"), prepend=0))
            flat.append(ids)
        own = model.encode(hard, num_threads=1) if hard else []
        lengths = np.zeros(len(texts), np.int64)
        lengths[plain] = np.concatenate(counts) if counts else 0
        lengths[~plain] = list(map(len, own))
        all_ids = np.concatenate([*flat, *[np.array(x, np.int64) for x in own], np.zeros(0, np.int64)])
        order = np.argsort(np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)]))
        sizes = np.concatenate([lengths[plain], lengths[~plain]])
        return chunks.gather(all_ids, (np.cumsum(sizes) - sizes)[order], sizes[order]), lengths

    return Side.of(encode, names)


def coalesce(start: np.ndarray, end: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of intervals by start, then side; and where, in that order, groups begin.

    A group begins where a start reaches the largest end so far.
    """
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    begins = np.ones(len(order), bool)
    begins[1:] = start[order][1:] >= reach[:-1]
    return order, begins


def overlaps(a_start, a_end, b_start, b_end) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of overlapping intervals, by A then B; both sides tile the same bytes in order."""
    first = np.searchsorted(b_end, a_start, side="right")
    number = np.searchsorted(b_start, a_end, side="left") - first
    a = np.repeat(np.arange(len(a_start)), number)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(number) - number - first, number)


class Aligner:
    """Alignments of chunks, each distinct one worked out once."""

    def __init__(self, a: Side, b: Side, limit: int = LIMIT):
        self.a, self.b, self.limit = a, b, limit
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.text: list[bytes] = []  # groups, each ended by a semicolon
        self.good = chunks.Pool(bool)  # both sides have the bytes of the chunk
        self.facts = chunks.Pool(np.int64)  # n_a, n_b, n_groups per chunk
        self.pairs, self.first, self.number = chunks.Pool(np.int64), chunks.Pool(np.int64), chunks.Pool(np.int64)

    def learn(self, new: list[str]) -> None:
        """Encode and align a space and the chunk, for each chunk."""
        raw = [b" " + c.encode() for c in new]
        size = np.array([len(r) for r in raw], np.int64)
        every = np.frombuffer(b"".join(raw), np.uint8)
        base = np.cumsum(size) - size
        sides = []
        good = np.ones(len(new), bool)
        for side in (self.a, self.b):
            ids, counts = side.encode(new)
            ids = ids.astype(np.int64)
            length = side.length[ids]
            of = np.repeat(np.arange(len(new)), counts)
            total = np.bincount(of, length, len(new)).astype(np.int64)
            good &= total == size
            sides.append((side, ids, length, of))
        for side, ids, length, of in sides:
            # compare bytes of the chunks whose lengths agree
            fits = good[of]
            found = side.bytes(ids[fits])
            expected = chunks.gather(every, base[good], size[good])
            wrong = np.flatnonzero(found != expected)
            at = np.repeat(np.flatnonzero(good), size[good])
            good[at[wrong]] = False
        kept = []
        for side, ids, length, of in sides:
            fits = good[of]
            end = np.cumsum(length[fits])
            kept.append((ids[fits], end - length[fits], end, of[fits]))
        (a, a_start, a_end, a_of), (b, b_start, b_end, b_of) = kept
        order, begins = coalesce(np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end]),
                                 np.repeat([0, 1], [len(a), len(b)]))
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(begins) - 1
        x, y = overlaps(a_start, a_end, b_start, b_end)
        together = a_end[x] == b_end[y]
        x, y = x[together], y[together]
        n = len(new)
        links = np.bincount(a_of[x], minlength=n)
        self.first.add(self.pairs.size + np.cumsum(links) - links)
        self.number.add(links)
        self.pairs.add(a[x] << 32 | b[y])
        n_groups = np.bincount(np.concatenate([a_of, b_of])[order[begins]], minlength=n)
        facts = np.stack([np.bincount(a_of, minlength=n), np.bincount(b_of, minlength=n), n_groups], 1)
        self.facts.add(facts.reshape(-1))
        self.good.add(good)
        self.text += _group_texts(a, group[: len(a)], b, group[len(a) :], n_groups)

    def chunk_slots(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the chunks of all texts, and chunks per text. An empty text has none."""
        if len(self.text) > self.limit:
            self.clear()
        parts = [CUT.split(t) if t else [] for t in texts]
        flat = [c for p in parts for c in p]
        known = self.slots
        new = [c for c in dict.fromkeys(flat) if c not in known]
        if new:
            known.update(zip(new, range(len(self.text), len(self.text) + len(new))))
            self.learn(new)
        return np.fromiter(map(known.__getitem__, flat), np.int64, len(flat)), np.fromiter(map(len, parts), np.int64, len(parts))


def _group_texts(a, a_group, b, b_group, n_groups) -> list[bytes]:
    """``a1,a2|b1;a3|b2;`` of each chunk, as bytes; groups are numbered through all chunks.

    A token is its decimal id and a sign: a comma before one of its own side and
    group, a bar before B tokens, a semicolon at the end of the group.
    """
    ids, group = np.concatenate([a, b]), np.concatenate([a_group, b_group])
    side = np.repeat([0, 1], [len(a), len(b)])
    order = np.lexsort((side, group))
    ids, group, side = ids[order], group[order], side[order]
    sign = np.full(len(ids), ord(";"), np.uint8)
    same = group[1:] == group[:-1]
    sign[:-1][same] = np.where(side[1:] != side[:-1], ord("|"), ord(","))[same]
    digits = np.ones(len(ids), np.int64)
    for k in range(1, 19):
        digits += ids >= 10**k
    ends = np.cumsum(digits + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[ends - 1] = sign
    rest, at, open_ = ids.copy(), ends - 2, np.arange(len(ids))
    while open_.size:
        out[at[open_]] = rest[open_] % 10 + ord("0")
        rest[open_] //= 10
        at[open_] -= 1
        open_ = open_[rest[open_] > 0]
    last = np.searchsorted(group, np.cumsum(n_groups))  # tokens up to the end of each chunk
    stops = np.concatenate([[0], ends])[last].tolist()
    raw = out.tobytes()
    return [raw[s:e] for s, e in zip([0, *stops], stops)]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The worker's aligner, kept for its next tasks."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(byte_level(a_path), pieces(b_path))
    return _ALIGNERS[a_path, b_path]


ALIGNED = "row long, doc_id {}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


def align(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = False) -> DataFrame:
    """Per row: row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and links.

    ``links`` holds the linked ids in order, A times 2^32 plus B, as little-endian
    64-bit numbers. With ``keep_groups`` also groups, the text that is hashed. Null and
    empty texts, and texts whose tokens of either side do not join to a space and the
    text, have no tokens: zeros and ''. Repeated and null ids are rows of their own;
    other columns are not read.
    """
    schema = ALIGNED.format(docs.schema["doc_id"].dataType.simpleString()) + (", groups string" if keep_groups else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = aligner(a_path, b_path), TaskContext.get().partitionId() << 33
        for batch in batches:
            for begin, part in chunks.slices(batch.column("text"), min(SLICE, chunks.SLICE_BYTES)):
                slots, counts = own.chunk_slots(part.to_pylist())
                stops = np.cumsum(counts)
                of = np.repeat(np.arange(len(part)), counts)
                good = counts > 0
                good[of[~own.good.data[slots]]] = False
                names = list(map(own.text.__getitem__, slots.tolist()))
                groups = [b"".join(names[s:e])[:-1] if g else b"" for s, e, g in zip(
                    (stops - counts).tolist(), stops.tolist(), good.tolist())]
                kept = good[of]
                slots, of = slots[kept], of[kept]
                facts = own.facts.data[: own.facts.size].reshape(-1, 3)[slots]
                sums = [np.bincount(of, facts[:, c], len(part)).astype(np.int64) for c in range(3)]
                links = chunks.gather(own.pairs.data, own.first.data[slots], own.number.data[slots]).astype("<i8")
                n_links = np.bincount(of, own.number.data[slots], len(part)).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(8 * n_links)]).astype(np.int32)
                columns = [
                    pa.array(number + np.arange(len(part))), batch.column("doc_id").slice(begin, len(part)),
                    *map(pa.array, sums), pa.array(n_links),
                    pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups]),
                    pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(links.tobytes())]),
                ]
                number += len(part)
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([g.decode() for g in groups])] if keep_groups else columns,
                    [f.split()[0] for f in schema.split(", ")])

    return text_rows(docs).mapInArrow(run, schema)


def _flat(links: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All links of a batch, and how many each row has."""
    counts = pc.binary_length(links).to_numpy().astype(np.int64) // 8
    offsets = np.frombuffer(links.buffers()[1], np.int32)[links.offset : links.offset + len(links) + 1]
    data = links.buffers()[2]
    raw = b"" if data is None else memoryview(data)[offsets[0] : offsets[-1]]
    return np.frombuffer(raw, "<i8"), counts


def link_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (links of the corpus that hold it) and best (n is the highest of its B id)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("pair").aggregate([("n", "sum")]).rename_columns(["pair", "n"])

        for batch in batches:
            pair, n = np.unique(_flat(batch.column("links"))[0], return_counts=True)
            held.append(pa.table({"pair": pa.array(pair), "n": pa.array(n)}))
            if sum(map(len, held)) > HELD_PAIRS:
                held = [summed()]
                if len(held[0]) > HELD_PAIRS // 2:
                    yield from held[0].to_batches()
                    held = []
        if held:
            yield from summed().to_batches()

    counts = aligned.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # a B id has at most as many partners as A has ids
    most = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    return counts.withColumn("best", F.col("n") == F.max("n").over(most))


def scored(aligned: DataFrame, counts: DataFrame, limit: int = BROADCAST_PAIRS) -> DataFrame:
    """``aligned`` without links, with n_best and count_sum. ``aligned`` is a written table, ``counts`` a checkpoint."""
    kept = [c for c in aligned.columns if c != "links"]
    if counts.limit(limit + 1).count() > limit:
        return _scored_by_join(aligned, counts, kept)
    table = counts.toArrow()
    pair, n = table.column("pair").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(pair)
    pair, n, best = pair[order], n[order], table.column("best").to_numpy()[order].astype(bool)
    schema = aligned.drop("links").schema.add("n_best", "long").add("count_sum", "long")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links, counts = _flat(batch.column("links"))
            at = np.searchsorted(pair, links)
            sums = [np.concatenate([[0], np.cumsum(v[at])]) if len(pair) else np.zeros(1, np.int64) for v in (best.astype(np.int64), n)]
            stops = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *(pa.array(s[stops] - s[stops - counts]) for s in sums)],
                [*kept, "n_best", "count_sum"])

    return aligned.mapInArrow(score, schema)


def _scored_by_join(aligned: DataFrame, counts: DataFrame, kept: list[str]) -> DataFrame:
    """Distinct links of each row meet their counts; frequent pairs are salted by row."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links, counts = _flat(batch.column("links"))
            order = np.lexsort((links, of := np.repeat(np.arange(len(batch)), counts)))
            links, of = links[order], of[order]
            first = np.flatnonzero((np.diff(links, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
            times = np.diff(first, append=len(links))
            row = batch.column("row").to_numpy()[of[first]]
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(links[first]), pa.array(times)], ["row", "pair", "times"])

    links = aligned.select("row", "links").mapInArrow(distinct, "row long, pair long, times long")
    # n counts links, so it is at least the number of rows that have the pair
    met = salted_join(links, counts.withColumn("_n", F.col("n")), ["pair"], "row", "_n", stored=True)
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return aligned.select(*kept).join(sums, "row", "left").select(
        *kept, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"))


def alignment(docs: DataFrame, a_path: str, b_path: str, limit: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row, as ``align`` says.

    ``n_best`` counts the links whose pair is the most frequent of its B id in the
    corpus (ties included), ``count_sum`` adds up the frequencies of all links. An empty table gives an
    empty result.
    """
    folder = new_folder(docs.sparkSession, "alignment")
    align(docs, a_path, b_path).write.option("compression", "zstd").parquet(folder)
    aligned = docs.sparkSession.read.parquet(folder)
    counts = checkpoint(link_counts(aligned))
    return scored(aligned, counts, limit).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
