"""Operator 13: benchmark passages in documents, by suffix arrays of the documents.

Each task cuts its documents into shards of about ``chunks.SLICE_BYTES`` and sorts
the suffixes of each shard: a suffix array over words. The suffixes of the items are
then looked up in it by binary search, all at once. The range of a suffix at the
depth of a window holds every place of that window; the neighbours of the place at
which the whole suffix would stand share its longest match with the shard.

Only words of the items can match, and a match has at least the words of the
shortest window. So a shard keeps the runs of that many item words and drops the
rest before it sorts; no match is lost.

Documents are never shuffled. The items travel to the tasks in blocks of at most
``BLOCK_BYTES`` of words, one pass over the documents per block, whatever the number
of items; items of more than ``PIECE`` words go in overlapping pieces.

Shared rules of all functions here: a null text has no words; rows with the same or a
null id are documents (items) of their own, except that equal item ids are one item
and null ids one without a name; columns beyond doc_id, text, item_id have no effect.
An empty table of items leaves every document clean; an empty table of documents gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.functions.scale import stack
from txnrisk.llm import chunks, words
from txnrisk.session import checkpoint

#: Words of a window.
WINDOW = 10
#: Words of an item that travel together, besides the overlap of a window.
PIECE = 4096
#: Bytes of item words sent to the tasks at once.
BLOCK_BYTES = 16 << 20
#: Suffixes looked up at once.
QUERIES = 1 << 16
#: Words compared in one step when a match is followed beyond its window.
STRIDE = 16
#: Fixed value: what is no separator, as a Java pattern.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPANS = "array<struct<start:long,length:long>>"


def item_pieces(items: DataFrame, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """item_id (string), first (place in the item) and words of the pieces of all items that have words.

    Pieces overlap by ``window - 1`` words, so every window lies in one of them.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
        F.regexp_extract_all(F.translate("text", upper, lower), F.lit(WORD), F.lit(0)).alias("words"),
    ).where(F.size("words") > 0)
    last = F.greatest(F.lit(0), F.size("words") - window)
    placed = found.withColumn("first", F.explode(F.sequence(F.lit(0), last, F.lit(piece))))
    return placed.select("item_id", "first", F.slice("words", F.col("first") + 1, F.lit(piece + window - 1)).alias("words"))


def item_blocks(items: DataFrame, window: int = WINDOW, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """All items in blocks of about ``limit`` bytes, read to the driver one at a time."""
    pieces = checkpoint(item_pieces(items, window).withColumn(
        "size", F.aggregate("words", F.lit(0), lambda s, w: s + F.octet_length(w) + 4)))
    total = pieces.agg(F.sum("size")).first()[0] or 0
    n = math.ceil(total / limit)
    # pieces are dealt by a hash; twice as many blocks keep each below the limit
    n = 1 if n <= 1 else 2 * n
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item_id", "first", "words"), F.lit(n)))
    for k in range(n):
        rows = dealt.where(F.col("block") == k).select("item_id", "first", "words").toArrow()
        if len(rows):
            yield Block.of(rows, window)


@dataclass
class Block:
    """Some items: their words, numbered from 1, and their distinct windows."""

    vocabulary: pa.Array
    names: list[str]
    first: np.ndarray  # place of each piece in its item
    item: np.ndarray  # item of each piece
    text: np.ndarray  # word numbers of all pieces
    start: np.ndarray  # of each piece in text
    length: np.ndarray
    windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # per depth: words, and items of each window

    @classmethod
    def of(cls, rows: pa.Table, window: int) -> Block:
        lists = rows.column("words").combine_chunks()
        names, item = np.unique(np.array(rows.column("item_id").to_pylist(), object), return_inverse=True)
        flat = lists.flatten()
        vocabulary = flat.unique()
        text = pc.index_in(flat, vocabulary).to_numpy().astype(np.int32) + 1
        length = pc.list_value_length(lists).to_numpy().astype(np.int64)
        start = np.cumsum(length) - length
        depth, windows = np.minimum(length, window), []
        for w in np.unique(depth):
            of = np.flatnonzero(depth == w)
            number = length[of] - w + 1
            at = np.repeat(start[of] - (np.cumsum(number) - number), number) + np.arange(number.sum())
            distinct, code = np.unique(text[at[:, None] + np.arange(w)], axis=0, return_inverse=True)
            pairs = np.unique(np.stack([code.reshape(-1), np.repeat(item[of], number)], 1), axis=0)
            windows.append((distinct, np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), pairs[:, 1]))
        first = rows.column("first").to_numpy().astype(np.int64)
        return cls(vocabulary, list(names), first, item, text, start, length, windows)

    @property
    def shortest(self) -> int:
        return min(w.shape[1] for w, _, _ in self.windows)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` in the order of their suffixes, compared by ``depth`` numbers at least.

    Doubles the compared length per round and ends early when all suffixes differ.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank, reach = np.empty(n, np.int64), 1
    key = text.astype(np.int64)
    while n:
        rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
        if reach >= depth or rank[order[-1]] == n - 1:
            break
        key = rank * (n + 1)
        key[: n - reach] += rank[reach:] + 1
        order = np.argsort(key, kind="stable")
        reach *= 2
    return order


class Shard:
    """The suffix array of the runs of known words in some documents."""

    def __init__(self, code: np.ndarray, counts: np.ndarray, least: int, depth: int):
        """``code`` numbers all words of the documents, 0 if unknown; ``least`` words make a run worth keeping."""
        self.doc_ends = np.cumsum(counts)
        known = code > 0
        begin = known.copy()
        begin[1:] &= ~known[:-1]
        heads = (self.doc_ends - counts)[counts > 0]
        begin[heads] = known[heads]
        starts = np.flatnonzero(begin)
        last = known.copy()
        last[:-1] &= ~known[1:] | begin[1:]
        length = np.flatnonzero(last) + 1 - starts
        starts, length = starts[length >= least], length[length >= least]
        # a zero behind every run
        ends = np.cumsum(length + 1)
        self.text = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        self.place = np.zeros(len(self.text), np.int64)
        at = np.repeat(ends - length - 1 - (np.cumsum(length) - length), length) + np.arange(length.sum())
        self.place[at] = np.repeat(starts - (np.cumsum(length) - length), length) + np.arange(length.sum())
        self.text[at] = code[self.place[at]]
        order = suffix_array(self.text, depth)
        self.order = order[self.text[order] > 0]
        self.padded = np.concatenate([self.text, np.zeros(STRIDE + WINDOW, np.int32)])

    def search(self, queries: np.ndarray, skip: np.ndarray, low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
        """Where each row of ``queries`` stands among the suffixes ``low`` to ``high``, read from ``skip`` words on.

        Before all suffixes that start with it, or after them.
        """
        low, high, width = low.copy(), high.copy(), np.arange(queries.shape[1])
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) >> 1
            at = np.minimum(self.order[middle] + skip[open_], len(self.text))
            own = self.padded[at[:, None] + width].astype(np.int64) - queries[open_]
            lead = own[np.arange(len(own)), (own != 0).argmax(axis=1)]
            below = lead <= 0 if after else lead < 0
            low[open_[below]] = middle[below] + 1
            high[open_[~below]] = middle[~below]
        return low

    def ranges(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``queries`` the range of suffixes that start with it."""
        low, high = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        for a in range(0, len(queries), QUERIES):
            part = queries[a : a + QUERIES]
            none = np.zeros(len(part), np.int64)
            low[a : a + len(part)] = self.search(part, none, none, none + len(self.order), after=False)
            first = low[a : a + len(part)]
            high[a : a + len(part)] = self.search(part, none, first, none + len(self.order), after=True)
        return low, high


def _codes(texts: pa.Array, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in the block's vocabulary of all words of the texts, 0 if not in it, and words per text."""
    distinct, code, counts = words.split(texts, words.LETTERS_DIGITS)
    number = pc.fill_null(pc.index_in(distinct, block.vocabulary.cast(pa.string())), -1).to_numpy() + 1
    return number.astype(np.int32)[code], counts


def _found(texts: pa.Array, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words per text; +1 and -1 where windows begin and end; and (text, item) of every item found."""
    code, counts = _codes(texts, block)
    shard = Shard(code, counts, block.shortest, WINDOW)
    change, pairs = np.zeros(len(code) + 1, np.int64), [np.zeros((0, 2), np.int64)]
    for window, own, items in block.windows:
        low, high = shard.ranges(window)
        hit = np.flatnonzero(high > low)
        number = high[hit] - low[hit]
        at = shard.place[chunks.gather(shard.order, low[hit], number)]
        change += np.bincount(at, minlength=len(change)) - np.bincount(at + window.shape[1], minlength=len(change))
        doc = np.searchsorted(shard.doc_ends, at, side="right")
        seen = np.unique(np.stack([doc, np.repeat(hit, number)], 1), axis=0)
        number = own[seen[:, 1] + 1] - own[seen[:, 1]]
        pairs.append(np.stack([np.repeat(seen[:, 0], number), chunks.gather(items, own[seen[:, 1]], number)], 1))
    both = np.unique(np.concatenate(pairs), axis=0)
    return counts, change, both[:, 0], both[:, 1]


def _spans(counts: np.ndarray, change: np.ndarray, before: pa.Array | None) -> tuple[pa.Array, np.ndarray]:
    """Hit runs of words of each text, joined with those of earlier blocks, and hit words per text."""
    ends = np.cumsum(counts)
    if before is not None:
        of = np.repeat(ends - counts, pc.list_value_length(before).to_numpy())
        start = of + before.flatten().field("start").to_numpy()
        stop = start + before.flatten().field("length").to_numpy()
        change = change + np.bincount(start, minlength=len(change)) - np.bincount(stop, minlength=len(change))
    hit = np.cumsum(change)[:-1] > 0
    begin = hit.copy()
    begin[1:] &= ~hit[:-1]
    heads = (ends - counts)[counts > 0]
    begin[heads] = hit[heads]
    last = hit.copy()
    last[:-1] &= ~hit[1:] | begin[1:]
    start = np.flatnonzero(begin)
    length = np.flatnonzero(last) + 1 - start
    doc = np.searchsorted(ends, start, side="right")
    per_doc = np.searchsorted(doc, np.arange(len(counts) + 1))
    runs = pa.StructArray.from_arrays([pa.array(start - (ends - counts)[doc]), pa.array(length)], ["start", "length"])
    return pa.ListArray.from_arrays(pa.array(per_doc, pa.int32()), runs), np.bincount(doc, length, len(counts)).astype(np.int64)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per row of ``docs`` its doc_id, n_words, n_hit, spans, items and contaminated.

    ``spans`` are the runs of words inside occurrences of windows, ``items`` the
    sorted ids (as strings) of the items that have such a window.
    """
    found = docs.select("doc_id", "text")
    for block in item_blocks(items):
        found = found.mapInArrow(_marker(block), f"doc_id {found.schema['doc_id'].dataType.simpleString()}, "
                                 f"text string, n_words long, n_hit long, spans {SPANS}, items array<string>")
    if "spans" not in found.columns:
        found = found.mapInArrow(_marker(None), f"doc_id {found.schema['doc_id'].dataType.simpleString()}, "
                                 f"text string, n_words long, n_hit long, spans {SPANS}, items array<string>")
    return found.select("doc_id", "n_words", "n_hit", "spans", "items", (F.col("n_hit") > 0).alias("contaminated"))


def _marker(block: Block | None):
    """Adds the places and items of one block to what earlier blocks found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, part in chunks.slices(batch.column("text")):
                old = batch.slice(begin, len(part))
                if block is None:
                    counts = words.split(part, words.LETTERS_DIGITS)[2]
                    change, doc, item = np.zeros(int(counts.sum()) + 1, np.int64), *[np.zeros(0, np.int64)] * 2
                else:
                    counts, change, doc, item = _found(part, block)
                more = "spans" in batch.schema.names
                spans, n_hit = _spans(counts, change, old.column("spans") if more else None)
                names: list[set] = [set(x) for x in old.column("items").to_pylist()] if more else [set() for _ in range(len(part))]
                for d, i in zip(doc.tolist(), item.tolist()):
                    names[d].add(block.names[i])
                yield pa.RecordBatch.from_arrays([
                    old.column("doc_id"), old.column("text"), pa.array(counts.astype(np.int64)), pa.array(n_hit), spans,
                    pa.array([sorted(x, key=str.encode) for x in names], pa.list_(pa.string())),
                ], ["doc_id", "text", "n_words", "n_hit", "spans", "items"])

    return run


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without those that hold a window of an item."""
    kept = docs
    for block in item_blocks(items):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin, part in chunks.slices(batch.column(batch.schema.get_field_index("text"))):
                    bad = np.zeros(len(part), bool)
                    bad[_found(part, block)[2]] = True
                    yield batch.slice(begin, len(part)).filter(pa.array(~bad))

        kept = kept.mapInArrow(run, docs.schema)
    return kept


def longest_matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per item the longest run of its words that stands in a document, and where.

    item_id (string), n_words, item_start (word of the item), doc_id and doc_start
    (word of the document); of several the first in the item, then of the smallest
    (doc_id, doc_start), null ids last. Items without a match of a whole window have no
    row; matches are followed up to ``PIECE`` words.
    """
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"item_id string, n_words long, item_start long, doc_id {doc_type}, doc_start long"
    parts = [docs.select("doc_id", "text").mapInArrow(_longest(block), schema) for block in item_blocks(items)]
    if not parts:
        return docs.sparkSession.createDataFrame([], T._parse_datatype_string(schema))
    best = F.min_by(
        F.struct("n_words", "item_start", "doc_id", "doc_start"),
        F.struct(-F.col("n_words"), "item_start", F.col("doc_id").isNull(), "doc_id", "doc_start"),
    )
    return stack(parts).groupBy("item_id").agg(best.alias("best")).select("item_id", "best.*")


def _longest(block: Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, part in chunks.slices(batch.column("text")):
                code, counts = _codes(part, block)
                shard = Shard(code, counts, block.shortest, int(block.length.max()))
                piece, at, length, place = follow(shard, block)
                doc = np.searchsorted(shard.doc_ends, place, side="right")
                yield pa.RecordBatch.from_arrays([
                    pa.array([block.names[i] for i in block.item[piece]], pa.string()), pa.array(length),
                    pa.array(block.first[piece] + at), batch.column("doc_id").take(pa.array(begin + doc)),
                    pa.array(place - (shard.doc_ends - counts)[doc]),
                ], ["item_id", "n_words", "item_start", "doc_id", "doc_start"])

    return run


def follow(shard: Shard, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The longest match of every item piece with the shard: piece, start in it, words, first place in the shard.

    Each suffix is narrowed to the range of equal suffixes, ``STRIDE`` words at a time
    and where these no longer match word by word. Of a piece only the longest match
    goes on, the first of equal ones.
    """
    window = np.minimum(block.length, WINDOW)
    number = block.length - window + 1
    piece = np.repeat(np.arange(len(block.length)), number)
    at = np.arange(len(piece)) - np.repeat(np.cumsum(number) - number, number)
    low = np.zeros(len(piece), np.int64)
    high = low.copy()
    for w in np.unique(window):
        of = np.flatnonzero(window[piece] == w)
        low[of], high[of] = shard.ranges(block.text[(block.start[piece[of]] + at[of])[:, None] + np.arange(w)])
    hit = high > low
    piece, at, low, high = piece[hit], at[hit], low[hit], high[hit]
    depth = window[piece].copy()
    for width in (STRIDE, 1):
        going = np.arange(len(piece))
        while (going := going[block.length[piece[going]] - at[going] - depth[going] >= width]).size:
            of = block.text[(block.start[piece[going]] + at[going] + depth[going])[:, None] + np.arange(width)]
            first = shard.search(of, depth[going], low[going], high[going], after=False)
            behind = shard.search(of, depth[going], first, high[going], after=True)
            equal = behind > first
            going = going[equal]
            low[going], high[going] = first[equal], behind[equal]
            depth[going] += width
    order = np.lexsort((at, -depth, piece))
    best = order[np.flatnonzero(np.diff(piece[order], prepend=-1))]
    # pieces with the same match share its range
    ranges, own = np.unique(np.stack([low[best], high[best]], 1), axis=0, return_inverse=True)
    size = ranges[:, 1] - ranges[:, 0]
    places = chunks.gather(shard.order, ranges[:, 0], size)
    first = np.minimum.reduceat(places, np.cumsum(size) - size) if len(size) else places
    return piece[best], at[best], depth[best], shard.place[first[own.reshape(-1)]]
