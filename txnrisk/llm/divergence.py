"""Operator 11: how the sources of a language differ in the words they use.

First pass: in how many documents of its language each term occurs, exactly; the
frequent ones stay. They are dealt to shards per language, and each shard gets a
minimal perfect hash and its terms in the order of their slots. Second pass: the
shards travel to the tasks, and every occurrence adds one to the slot of its term in
a dense array per group; a word is looked up by its hash and counts only if it
equals the term stored in the slot. Shards above ``BROADCAST_BYTES`` in all do not
travel: counts per (group, term) are then joined with the slots instead.

Arrays of one (group, shard) are summed in two steps, so that no task holds those of
all tasks. Pairs of sources are compared by tiles of sources, shard by shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.functions.scale import small_join
from txnrisk.llm import chunks, words
from txnrisk.session import checkpoint

MIN_DOCS = 30
#: Fixed values of the shares: what every count gets, and the unit.
EXTRA, UNIT = 5, 1_000_000_000
TOP = 50
#: Terms of a shard, about; sources of a tile, about.
SHARD_TERMS, TILE = 1 << 11, 64
#: Bytes of all shards that may travel to every task.
BROADCAST_BYTES = 64 << 20
#: Bytes of count arrays, and distinct terms, that a task holds before it passes them on.
HELD_BYTES, HELD_TERMS = 64 << 20, 1 << 20
#: Bytes of text that are split into words at once: a slice takes some twenty times its bytes.
SLICE_BYTES = 1 << 20
#: Tasks whose arrays are summed together first.
FAN_IN = 64
#: Bits of a level of a perfect hash per key left, and levels at most.
ROOM, LEVELS = 2, 48


# --- minimal perfect hash ---------------------------------------------------


def hashes(terms: list[str]) -> np.ndarray:
    """As Spark's ``xxhash64`` of a string."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(t.encode(), 42) for t in terms), np.uint64, len(terms))


def _places(key: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place of each key among the bits of a level: a multiply-shift mix of the key, another per level."""
    mixed = (key ^ key >> np.uint64(31)) * np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & (1 << 64) - 1)
    return ((mixed ^ mixed >> np.uint64(29)) >> np.uint64(3)) % np.uint64(size)


@dataclass
class PerfectHash:
    """Slots 0 to n-1 for n keys.

    A level has bits; a key that is alone at its place sets the bit and leaves, the
    others go on to the next level. The slot is the number of bits set before.
    Keys of equal hashes never part; they take the last slots, by name.
    """

    sizes: list[int]
    bits: np.ndarray  # 64 per word, levels behind each other, each from a new word
    spare: int  # slots of keys that share their hash

    def __post_init__(self):
        ones = np.bitwise_count(self.bits).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.n = int(ones.sum())

    @classmethod
    def of(cls, key: np.ndarray) -> PerfectHash:
        sizes, levels = [], [np.zeros(0, np.uint64)]
        while len(key) and len(sizes) < LEVELS:
            size = (ROOM * len(key) + 63) // 64 * 64
            at = _places(key, len(sizes), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            level = np.zeros(size, np.uint8)
            level[at[alone]] = 1
            levels.append(np.packbits(level, bitorder="little").view(np.uint64))
            sizes.append(size)
            key = key[~alone]
        return cls(sizes, np.concatenate(levels), len(key))

    def slots(self, key: np.ndarray) -> np.ndarray:
        """A slot for every key, that of another key if it was not among those hashed; -1 for none."""
        found = np.full(len(key), -1, np.int64)
        open_, first = np.arange(len(key)), 0
        for level, size in enumerate(self.sizes):
            at = first + _places(key[open_], level, size).astype(np.int64)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            has = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            found[open_[has]] = (self.before[at >> 6] + below)[has]
            open_ = open_[~has]
            first += size
        return found


class Shard:
    """Terms in the order of their slots, and the hash that gives the slot."""

    def __init__(self, terms: pa.Array, hash_: PerfectHash):
        self.terms, self.hash = terms, hash_
        self.spare = {t: hash_.n + i for i, t in enumerate(terms.slice(hash_.n).to_pylist())} if hash_.spare else {}

    @classmethod
    def of(cls, terms: list[str]) -> Shard:
        key = hashes(terms)
        hash_ = PerfectHash.of(key)
        slot = hash_.slots(key)
        # keys of equal hashes all end without a slot of their own
        values, number = np.unique(key, return_counts=True)
        shared = np.flatnonzero(np.isin(key, values[number > 1])) if hash_.spare else np.zeros(0, np.int64)
        slot[shared] = hash_.n + np.arange(len(shared))
        return cls(pa.array(terms, pa.string()).take(pa.array(np.argsort(slot))), hash_)

    def slots(self, found: pa.Array, key: np.ndarray) -> np.ndarray:
        """Slots of words, -1 for those that are not the term stored there."""
        slot = self.hash.slots(key)
        stored = self.terms.take(pa.array(np.maximum(slot, 0))) if len(self.terms) else pa.nulls(len(found), pa.string())
        equal = pc.fill_null(pc.equal(stored, found), False).to_numpy(zero_copy_only=False)
        slot = np.where(equal, slot, -1)
        if self.spare:
            for k in np.flatnonzero(slot < 0):
                slot[k] = self.spare.get(found[int(k)].as_py(), -1)
        return slot


# --- first pass: document frequencies ---------------------------------------


def _groups(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[tuple[str, str]], list[str]]:
    """Group of each row, language of each group, and what groups and languages are called."""
    lang, source = (pc.fill_null(batch.column(c).cast(pa.string()), "").dictionary_encode() for c in ("lang", "source"))
    key = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    distinct, of_row = np.unique(key, return_inverse=True)
    n = max(1, len(source.dictionary))
    names, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
    return of_row, distinct // n, [(names[k // n], sources[k % n]) for k in distinct.tolist()], names


def document_frequencies(docs: DataFrame) -> DataFrame:
    """lang, term and n_docs: rows of the language whose text has the term. Null lang and text are ''."""

    def held(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by("term").aggregate([("n", "sum")]).rename_columns(["term", "n"])

    def passed_on(by_lang: dict[str, list[pa.Table]], least: int = 0) -> Iterator[pa.RecordBatch]:
        """The terms of each language once; those of languages with up to ``least`` stay. Freed memory goes back."""
        for lang in list(by_lang):
            merged = held(by_lang.pop(lang))
            if len(merged) <= least:
                by_lang[lang] = [merged]
                continue
            for batch in merged.to_batches(1 << 16):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(batch), pa.string()), batch.column("term"), batch.column("n")], ["lang", "term", "n"])
        pa.default_memory_pool().release_unused()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, list[pa.Table]] = {}
        n_held = 0
        for batch in batches:
            of_row, lang_of, _, names = _groups(batch)
            for begin, part in chunks.slices(batch.column("text"), SLICE_BYTES):
                distinct, code, counts = words.split(part, words.LETTERS)
                if not len(code):
                    continue
                k = len(distinct)
                once = np.unique(np.repeat(np.arange(len(part)), counts) * k + code)
                lang = lang_of[of_row[begin : begin + len(part)]]
                key, n = np.unique(lang[once // k] * k + once % k, return_counts=True)
                for own in np.split(np.arange(len(key)), np.flatnonzero(np.diff(key // k)) + 1):
                    by_lang.setdefault(names[key[own[0]] // k], []).append(
                        pa.table({"term": distinct.take(pa.array(key[own] % k)), "n": pa.array(n[own])}))
                n_held += len(key)
                if n_held > HELD_TERMS:
                    yield from passed_on(by_lang, HELD_TERMS // 2 // max(1, len(by_lang)))
                    n_held = sum(len(t) for (t,) in by_lang.values())
        yield from passed_on(by_lang)

    rows = docs.select("lang", "source", "text").mapInArrow(count, "lang string, term string, n long")
    return rows.groupBy("lang", "term").agg(F.sum("n").alias("n_docs"))


def shards(kept: DataFrame) -> DataFrame:
    """lang, part, n_terms, terms (by slot), sizes, bits and spare of the perfect hashes of all terms of ``kept``."""
    kept = checkpoint(kept.select("lang", "term"))
    sizes = checkpoint(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "parts", F.ceil(F.col("_n") / SHARD_TERMS).cast("int")))
    dealt = small_join(kept, sizes, ["lang"], "term", "_n").withColumn("part", F.pmod(F.xxhash64("term"), "parts").cast("int"))

    def build(key, rows):
        shard = Shard.of(rows.column("term").to_pylist())
        return pa.table({
            "lang": pa.array([key[0].as_py()], pa.string()), "part": pa.array([key[1].as_py()], pa.int32()),
            "parts": rows.column("parts").slice(0, 1).cast(pa.int32()),
            "n_terms": pa.array([len(shard.terms)], pa.int32()),
            "terms": pa.array([shard.terms.to_pylist()], pa.list_(pa.string())),
            "sizes": pa.array([shard.hash.sizes], pa.list_(pa.int32())),
            "bits": pa.array([shard.hash.bits.astype("<u8").tobytes()], pa.binary()),
            "spare": pa.array([shard.hash.spare], pa.int32()),
        })

    return dealt.select("lang", "part", "parts", "term").groupBy("lang", "part").applyInArrow(
        build, "lang string, part int, parts int, n_terms int, terms array<string>, sizes array<int>, bits binary, spare int")


def _loaded(table: pa.Table) -> dict[str, list[Shard | None]]:
    """Shards of each language by part; parts without terms are None."""
    out: dict[str, list[Shard | None]] = {}
    for row in range(len(table)):
        one = {c: table.column(c)[row] for c in table.column_names}
        own = out.setdefault(one["lang"].as_py(), [None] * one["parts"].as_py())
        bits = np.frombuffer(one["bits"].as_py(), "<u8").astype(np.uint64)
        own[one["part"].as_py()] = Shard(one["terms"].values, PerfectHash(one["sizes"].as_py(), bits, one["spare"].as_py()))
    return out


# --- second pass: dense counts per group -------------------------------------


COUNTS = "lang string, source string, part int, task int, counts binary"


def packed(counts: np.ndarray) -> bytes:
    """Little-endian unsigned numbers of the fewest bytes that hold all."""
    width = np.min_scalar_type(int(counts.max())) if len(counts) else np.dtype(np.uint8)
    return counts.astype(width.newbyteorder("<")).tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    """``n`` counts; nothing stands for zeros."""
    if not raw:
        return np.zeros(n, np.int64)
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64)


def _recount(loaded: dict[str, list[Shard | None]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, size = TaskContext.get().partitionId(), 0
        slots_of: dict[tuple[str, str, int], np.ndarray] = {}

        def passed_on() -> pa.RecordBatch:
            keys = list(slots_of)
            columns = [*zip(*keys)] if keys else [(), (), ()]
            out = pa.RecordBatch.from_arrays([
                pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()),
                pa.array([task] * len(keys), pa.int32()), pa.array([packed(slots_of[k]) for k in keys], pa.binary()),
            ], ["lang", "source", "part", "task", "counts"])
            slots_of.clear()
            pa.default_memory_pool().release_unused()
            return out

        for batch in batches:
            of_row, lang_of, groups, names = _groups(batch)
            for begin, part in chunks.slices(batch.column("text"), SLICE_BYTES):
                for group, shard_part, slot, n in _counted(part, of_row[begin : begin + len(part)], lang_of, names, loaded):
                    lang, source = groups[group]
                    key = (lang, source, shard_part)
                    if key not in slots_of:
                        slots_of[key] = np.zeros(len(loaded[lang][shard_part].terms), np.int64)
                        size += slots_of[key].nbytes
                    slots_of[key][slot] += n
                if size > HELD_BYTES:
                    yield passed_on()
                    size = 0
        yield passed_on()

    return run


def _counted(texts, group, lang_of, names, loaded) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(group, shard, slots, counts) of all kept terms in the texts."""
    distinct, code, counts = words.split(texts, words.LETTERS)
    if not len(code):
        return
    k = len(distinct)
    key, n = np.unique(np.repeat(group, counts) * k + code, return_counts=True)
    in_group, word = key // k, key % k
    hashed = hashes(distinct.to_pylist())
    part, slot = np.full(len(key), -1, np.int64), np.full(len(key), -1, np.int64)
    lang = lang_of[in_group]
    for each in np.unique(lang).tolist():
        own = loaded.get(names[each])
        if own is None:
            continue
        at = np.flatnonzero(lang == each)
        seen, back = np.unique(word[at], return_inverse=True)
        to = np.mod(hashed[seen].view(np.int64), len(own))
        found = np.full(len(seen), -1, np.int64)
        order = np.argsort(to, kind="stable")
        for here in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
            if (shard := own[to[here[0]]]) is not None:
                found[here] = shard.slots(distinct.take(pa.array(seen[here])), hashed[seen[here]])
        part[at], slot[at] = to[back], found[back]
    kept = np.flatnonzero(slot >= 0)
    kept = kept[np.lexsort((part[kept], in_group[kept]))]
    both = in_group[kept] * (int(part.max()) + 1) + part[kept]
    for run in np.split(kept, np.flatnonzero(np.diff(both)) + 1) if len(kept) else ():
        yield int(in_group[run[0]]), int(part[run[0]]), slot[run], n[run]


def _summed(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sum of the arrays ``counts`` (n_terms numbers each) per ``by``, which holds lang and part."""
    schema = {c: rows.schema[c].dataType.simpleString() for c in by}

    def add(key, group):
        n = group.column("n_terms")[0].as_py()
        total = np.zeros(n, np.int64)
        for raw in group.column("counts"):
            total += unpacked(raw.as_py(), n)
        return pa.table({
            **{c: pa.array([k.as_py()], k.type) for c, k in zip(by, key)},
            "n_terms": pa.array([n], pa.int32()), "counts": pa.array([packed(total) if total.any() else b""], pa.binary()),
            "total": pa.array([int(total.sum())], pa.int64()),
        })

    return rows.groupBy(*by).applyInArrow(
        add, ", ".join(f"{c} {t}" for c, t in schema.items()) + ", n_terms int, counts binary, total long")


def group_counts(docs: DataFrame, shard_rows: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """lang, source, part, n_terms, counts (by slot; empty if all are zero) and total of every group and shard.

    ``shard_rows`` is a checkpoint of ``shards``. A language without terms has one
    part without slots.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    size = shard_rows.agg(F.sum(F.aggregate("terms", F.lit(0), lambda s, t: s + F.octet_length(t) + 5) + F.octet_length("bits"))).first()[0]
    if (size or 0) <= limit:
        counted = rows.mapInArrow(_recount(_loaded(shard_rows.toArrow())), COUNTS)
    else:
        counted = _joined_counts(rows, shard_rows)
    parts = shard_rows.select("lang", "part", "n_terms")
    groups = rows.select("lang", "source").distinct()
    every = groups.join(parts, "lang", "left").select(
        "lang", "source", F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"))
    some = counted.join(parts, ["lang", "part"]).select("lang", "source", "part", "n_terms", "counts", F.floor(F.col("task") / FAN_IN).alias("few"))
    some = _summed(some, ["lang", "source", "part", "few"])
    none = every.withColumn("counts", F.lit(b""))
    return _summed(some.select(*none.columns).unionByName(none), ["lang", "source", "part"])


def _joined_counts(rows: DataFrame, shard_rows: DataFrame) -> DataFrame:
    """As the recount by shards in every task, by a join of counts per (group, term) with the slots."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_row, _, groups, _ = _groups(batch)
            for begin, part in chunks.slices(batch.column("text"), SLICE_BYTES):
                distinct, code, counts = words.split(part, words.LETTERS)
                if len(code):
                    k = len(distinct)
                    key, n = np.unique(np.repeat(of_row[begin : begin + len(part)], counts) * k + code, return_counts=True)
                    lang, source = zip(*[groups[g] for g in (key // k).tolist()])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(lang), pa.array(source), distinct.take(pa.array(key % k)), pa.array(n)],
                        ["lang", "source", "term", "n"])

    counted = rows.mapInArrow(count, "lang string, source string, term string, n long")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    slots = shard_rows.select("lang", "part", "n_terms", F.posexplode("terms").alias("slot", "term"))

    def dense(key, group):
        total = np.zeros(group.column("n_terms")[0].as_py(), np.int64)
        total[group.column("slot").to_numpy()] = group.column("n").to_numpy()
        return pa.table({
            **{c: pa.array([k.as_py()], k.type) for c, k in zip(("lang", "source", "part"), key)},
            "task": pa.array([0], pa.int32()), "counts": pa.array([packed(total)], pa.binary()),
        })

    placed = counted.join(slots, ["lang", "term"]).select("lang", "source", "part", "n_terms", "slot", "n")
    return placed.groupBy("lang", "source", "part").applyInArrow(dense, COUNTS)


# --- shares and their differences ---------------------------------------------


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + EXTRA) / (total + EXTRA * terms)), exact for totals below 9e15."""
    whole = total + EXTRA * terms
    out, rest = np.divmod(counts + EXTRA, whole)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + more
    return 1 + out


def _rows(group: pa.Table) -> list[dict]:
    """Source and shares of the rows of a tile."""
    return [{
        "source": r["source"], "counts": (c := unpacked(r["counts"], r["n_terms"])), "shares": shares(c, r["n_all"], r["v"]),
    } for r in group.to_pylist()]


def _tile_pairs(key, group):
    """Sum over a shard of the differences of the shares of all pairs (a < b) that this pair of tiles has."""
    low, high = key[2].as_py(), key[3].as_py()
    rows = sorted(_rows(group), key=lambda r: r["source"])
    tile = dict(zip(group.column("source").to_pylist(), group.column("tile").to_pylist()))
    names = np.array([r["source"] for r in rows], object)
    own = np.array([tile[n] for n in names])
    table = np.stack([r["shares"] for r in rows])
    a, b, value = [], [], []
    for k in range(len(rows) - 1):
        # within one tile all later rows, else those of the other tile
        to = k + 1 + np.flatnonzero((own[k + 1 :] != own[k]) | (low == high))
        a.extend([names[k]] * len(to))
        b.extend(names[to])
        value.append(np.abs(table[to] - table[k]).sum(axis=1))
    return pa.table({
        "lang": pa.array([key[0].as_py()] * len(a), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()),
        "value": pa.array(np.concatenate(value) if value else np.zeros(0, np.int64)),
    })


def _tile_terms(top: int):
    def run(key, group, shard):
        out: tuple[list, list, list] = ([], [], [])
        if len(group) and len(shard):
            one = {c: shard.column(c)[0] for c in shard.column_names}
            whole = shares(unpacked(one["counts"].as_py(), one["n_terms"].as_py()), one["n_all"].as_py(), one["v"].as_py())
            terms = one["terms"].values
            for row in _rows(group):
                value = row["shares"] - whole
                at = np.flatnonzero((row["counts"] > 0) & (value > 0))
                if len(at) > top:
                    least = np.partition(value[at], len(at) - top)[len(at) - top]
                    at = at[value[at] >= least]
                found = sorted(zip((-value[at]).tolist(), (t.encode() for t in terms.take(pa.array(at)).to_pylist())))[:top]
                out[0].extend([row["source"]] * len(found))
                out[1].extend(t.decode() for _, t in found)
                out[2].extend(-v for v, _ in found)
        return pa.table({
            "lang": pa.array([key[0].as_py()] * len(out[0]), pa.string()), "source": pa.array(out[0], pa.string()),
            "item": pa.array(out[1], pa.string()), "value": pa.array(out[2], pa.int64()),
        })

    return run


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def divergence(
    docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, limit: int = BROADCAST_BYTES, tile: int = TILE,
) -> DataFrame:
    """lang, source, part, item, value and rank, ranked per group (lang, source) and part.

    Terms in at least ``min_docs`` rows of their language are kept. Part ``pair`` has a
    row per other source of the language: the sum of the differences of their shares
    over all kept terms, zero without any. Part ``term`` has the ``top`` kept terms whose share in
    the group exceeds that in the language most, if the group has them at all.

    Null lang, source and text count as ''. Every row is a document of its own,
    repeated ones too; a group of empty texts has zero counts; ties rank by item.
    Other columns are not read. An empty table gives an empty result.
    """
    docs = docs.select("lang", "source", "text")
    frequent = document_frequencies(docs).where(F.col("n_docs") >= min_docs)
    shard_rows = checkpoint(shards(frequent))
    counts = checkpoint(group_counts(docs, shard_rows, limit))
    per_group = counts.groupBy("lang", "source").agg(F.sum("total").alias("n_all"), F.sum(F.col("n_terms").cast("long")).alias("v"))
    per_lang = per_group.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources"), F.sum("n_all").alias("n_lang"))
    per_lang = per_lang.withColumn("tiles", F.ceil(F.col("n_sources") / tile))
    tiled = counts.join(per_group, ["lang", "source"]).join(per_lang, "lang").withColumn(
        "tile", F.pmod(F.xxhash64("source"), "tiles").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles").cast("int") - 1)).alias("other")
    # a tile meets every tile of its language, itself included
    met = tiled.select("lang", "part", "source", "tile", "n_terms", "counts", "n_all", "v", other).withColumns({
        "low": F.least("tile", "other"), "high": F.greatest("tile", "other")}).drop("other")
    pairs = met.groupBy("lang", "part", "low", "high").applyInArrow(_tile_pairs, "lang string, a string, b string, value long")
    pairs = pairs.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    both = pairs.select("lang", "value", ways.alias("way")).select("lang", "way.source", "way.item", "value")
    # sums of a language over its sources, few of them at a time
    few = tiled.withColumn("few", F.col("tile")).select("lang", "part", "few", "n_terms", "counts")
    of_lang = _summed(_summed(few, ["lang", "part", "few"]).select("lang", "part", "n_terms", "counts"), ["lang", "part"])
    v = per_group.groupBy("lang").agg(F.max("v").alias("v"))
    facts = of_lang.join(shard_rows.select("lang", "part", "terms"), ["lang", "part"]).join(v, "lang").join(
        per_lang.select("lang", F.col("n_lang").alias("n_all"), "tiles"), "lang")
    facts = facts.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles").cast("int") - 1))).drop("tiles", "total")
    by = ["lang", "part", "tile"]
    own = tiled.where("n_terms > 0").select(*by, "source", "n_terms", "counts", "n_all", "v")
    terms = own.groupBy(*by).cogroup(facts.groupBy(*by)).applyInArrow(
        _tile_terms(top), "lang string, source string, item string, value long")
    best = _ranked(terms, "term").where(F.col("rank") <= top)
    return _ranked(both, "pair").unionByName(best)
