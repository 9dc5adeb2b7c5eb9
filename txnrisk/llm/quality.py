"""Operator 1: quality by the perplexity of a Kneser-Ney model of trusted text.

The model is an interpolated modified Kneser-Ney model of byte n-grams, counted over
all trusted documents that may be learned from. An n-gram of up to seven bytes is a
long, so counts, continuation counts and contexts are plain grouped tables.

Scoring moves no n-gram per document. Documents are dealt into blocks by a hash of
the row, compressed on the way, equal rows of a slice once; the number of blocks and
shards follows from the bytes of the input and the entries of the model; a block gives its distinct n-grams once, packed by
shard. A shard is a group of the two bytes before the last: all counts and contexts
that an n-gram needs, from three bytes on, lie in its own shard, so one join of
packed rows with the sharded counts answers for all orders (those of two bytes have
at most 65,536 entries and go along as arrays). The logarithms of the probabilities
go back to the blocks, where every position of every text looks its own up.

A document is kept if its perplexity is at most the quantile that trusted documents
of its language have that the model was not trained on, and if its words repeat at a
fixed distance no more than theirs do: five bytes reach over one word, so a word that
comes again and again is usual to the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.functions.scale import small_join, stack
from txnrisk.llm import chunks
from txnrisk.llm.tables import fold, spread
from txnrisk.session import checkpoint

ORDER = 5
#: Texts of a block are looked at in parts of about so many bytes.
PART = 1 << 20
#: Bytes of text in a block, and of n-grams in a shard, about.
BLOCK, SHARD = 32 << 20, 512 << 20
#: Distances in words at which a text is compared with itself.
CYCLES = 4


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of each text, and the number of bytes of each text.

    Before its first byte a text has zero bytes.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    pad = bytes(order - 1)
    flat = np.frombuffer(pad + pad.join(texts) if texts else pad, np.uint8).astype(np.int64)
    out = np.zeros(len(flat) - order + 1, np.int64)
    for k in range(order):
        out |= flat[k : k + len(out)] << 8 * (order - 1 - k)
    starts = np.cumsum(size + order - 1) - (size + order - 1)
    return out[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())], size


def _parts(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    for begin, part in chunks.slices(column, PART):
        yield begin, [t.encode() for t in part.to_pylist()]


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """gram and n over all rows of ``texts`` (column text); each task adds up its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in _parts(batch.column("text")):
                gram, n = np.unique(grams(part, order)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n)], ["gram", "n"])

    counted = texts.select("text").mapInArrow(count, "gram long, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def repeats(text: bytes, prior_words: int = 16) -> float:
    """Largest share of words that equal the word 1 to ``CYCLES`` words before, with ``prior_words`` that do not."""
    words = text.lower().split()
    equal = max(sum(map(eq, words[k:], words)) for k in range(1, CYCLES + 1))
    return equal / (len(words) + prior_words)


@dataclass
class Level:
    """One order: ``grams`` (gram, value) and ``contexts`` (context, rest), as logical plans.

    ``value`` is the discounted share of the gram within its context, ``rest`` what
    the context leaves to the next lower order.
    """

    grams: DataFrame
    contexts: DataFrame


def discounts(n: tuple[int, int, int, int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more from the counts of counts."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.75
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(v, 0.05), k + 0.95) for k, v in enumerate(d))


def model(counts: DataFrame, order: int = ORDER) -> list[Level]:
    """Levels of order 1 to ``order`` from ``gram_counts``.

    Lower orders count the distinct bytes before an n-gram.
    """
    tables = [checkpoint(counts)]
    for k in range(order - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
        tables.insert(0, checkpoint(tables[0].groupBy(shorter.alias("gram")).agg(F.count(F.lit(1)).alias("n"))))
    levels = []
    for table in tables:
        row = table.agg(*[F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in range(1, 5)]).first()
        d = discounts(tuple(row))
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        context = F.shiftright("gram", 8).alias("context")
        sums = table.groupBy(context).agg(F.sum("n").alias("total"), F.sum(off).alias("off"))
        shares = table.select("gram", context, (F.col("n") - off).alias("left")).join(sums, "context")
        levels.append(Level(
            checkpoint(shares.select("gram", (F.col("left") / F.col("total")).alias("value"))),
            checkpoint(sums.select("context", (F.col("off") / F.col("total")).alias("rest"))),
        ))
    return levels


def _dense(level: Level, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``value`` and ``rest`` of a level of at most two bytes as arrays (at most 65,536 entries)."""
    value, rest = np.zeros(256**k), np.ones(256 ** (k - 1))
    for r in level.grams.collect():
        value[r["gram"]] = r["value"]
    for r in level.contexts.collect():
        rest[r["context"]] = r["rest"]
    return value, rest


def _shard(two_bytes: Column, shards: int) -> Column:
    return F.pmod(two_bytes * 40_503, F.lit(shards)).cast("int")


def sharded(levels: list[Level], shards: int) -> DataFrame:
    """shard, kind (2 k for n-grams of k bytes, 2 k + 1 for their contexts), key, value, for k from 3."""
    parts = []
    for k, level in enumerate(levels, start=1):
        if k > 2:
            for kind, table, key, value, shift in (
                (2 * k, level.grams, "gram", "value", 8), (2 * k + 1, level.contexts, "context", "rest", 0),
            ):
                two = F.shiftright(key, shift).bitwiseAND(F.lit(0xFFFF))
                parts.append(table.select(
                    _shard(two, shards).alias("shard"), F.lit(kind).alias("kind"), F.col(key).alias("key"),
                    F.col(value).alias("value")))
    return stack(parts) if parts else levels[0].grams.select(
        F.lit(0).alias("shard"), F.lit(0).alias("kind"), F.col("gram").alias("key"), "value").limit(0)


def log_probabilities(
    gram: np.ndarray, low: list[tuple[np.ndarray, np.ndarray]], tables: dict[int, tuple[np.ndarray, np.ndarray]], order: int
) -> np.ndarray:
    """Log probability of the last byte of each n-gram, from the lowest order up: ``value + rest * p``."""
    p = np.full(len(gram), 1 / 256)
    for k in range(1, order + 1):
        own = gram & ((1 << 8 * k) - 1)
        if k <= len(low):
            p = low[k - 1][0][own] + low[k - 1][1][own >> 8] * p
        else:
            p = _find(tables.get(2 * k), own, 0.0) + _find(tables.get(2 * k + 1), own >> 8, 1.0) * p
    return np.log(p)


def _find(table: tuple[np.ndarray, np.ndarray] | None, key: np.ndarray, default: float) -> np.ndarray:
    if table is None or not len(table[0]):
        return np.full(len(key), default)
    at = np.minimum(np.searchsorted(table[0], key), len(table[0]) - 1)
    return np.where(table[0][at] == key, table[1][at], default)


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(payload: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(payload.as_buffer()).read_all()


def perplexities(docs: DataFrame, levels: list[Level], blocks: int | None = None, shards: int | None = None) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity (per byte) and repeated (``repeats``) of every row.

    An empty or null text has no perplexity.
    """
    order = len(levels)
    if not (blocks and shards):
        n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        entries = sum(level.grams.count() + level.contexts.count() for level in levels)
        blocks = blocks or spread(docs.sparkSession, n_bytes, BLOCK)
        # a shard holds its part of the model and at most one n-gram per byte of text
        shards = shards or min(1 << 16, spread(docs.sparkSession, 20 * entries + 8 * n_bytes, SHARD))
    low = [_dense(level, k) for k, level in enumerate(levels[:2], start=1)]
    shard_of = np.arange(1 << 16) * 40_503 % shards

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, part in chunks.slices(batch.column("text")):
                rows = batch.slice(begin, len(part))
                # equal rows of a slice go once, with their number
                key, at, copies = np.unique(rows.column("hash").to_numpy(), return_index=True, return_counts=True)
                block = (key % blocks).astype(np.int32)
                rank = np.argsort(block, kind="stable")
                table = pa.Table.from_batches([rows.drop_columns(["hash"])]).take(pa.array(at[rank]))
                table = table.append_column("copies", pa.array(copies[rank], pa.int64()))
                starts = np.flatnonzero(np.diff(block[rank], prepend=-1))
                payload = [_packed(table.slice(a, b - a)) for a, b in zip(starts, [*starts[1:], len(rank)])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block[rank][starts]), pa.array(payload, pa.binary())], ["block", "payload"])

    key = F.xxhash64("doc_id", "lang", "text", F.col("text").isNull()).alias("hash")
    dealt = docs.select(key, "doc_id", "lang", "text").mapInArrow(deal, "block int, payload binary")

    def of_block(table: pa.Table) -> np.ndarray:
        """The distinct n-grams of a block, by shard and in order within it."""
        own = [np.zeros(0, np.int64)]
        for payload in table.column("payload"):
            own += [np.unique(grams(part, order)[0]) for _, part in _parts(_unpacked(payload).column("text").combine_chunks())]
        gram = np.unique(np.concatenate(own))
        return gram[np.argsort(shard_of[gram >> 8 & 0xFFFF], kind="stable")]

    def distinct(table: pa.Table) -> pa.Table:
        gram = of_block(table)
        shard = shard_of[gram >> 8 & 0xFFFF]
        starts = np.flatnonzero(np.diff(shard, prepend=-1))
        packed = [_packed(pa.table({"gram": gram[a:b]})) for a, b in zip(starts, [*starts[1:], len(gram)])]
        return pa.table({
            "block": pa.array(np.full(len(starts), table.column("block")[0].as_py()), pa.int32()),
            "shard": pa.array(shard[starts], pa.int32()), "payload": pa.array(packed, pa.binary()),
        })

    def look_up(wanted: pa.Table, counts: pa.Table) -> pa.Table:
        kind, key, value = (counts.column(c).to_numpy() for c in ("kind", "key", "value"))
        tables = {}
        for k in np.unique(kind).tolist():
            own = key[kind == k]
            rank = np.argsort(own)
            tables[k] = own[rank], value[kind == k][rank]
        found = [
            log_probabilities(_unpacked(p).column("gram").to_numpy(), low, tables, order).astype("<f4").tobytes()
            for p in wanted.column("payload")
        ] if len(wanted) else []
        return pa.table({
            "block": pa.array(wanted.column("block") if found else [], pa.int32()),
            "shard": pa.array(wanted.column("shard") if found else [], pa.int32()),
            "payload": pa.array(found, pa.binary()),
        })

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        gram = of_block(texts) if len(texts) else np.zeros(0, np.int64)
        shard = found.column("shard").to_numpy()
        logs = [np.frombuffer(found.column("payload")[k].as_buffer(), "<f4") for k in np.argsort(shard)]
        log_p = np.concatenate([np.zeros(0), *logs])
        rank = np.argsort(gram)
        gram, log_p = gram[rank], log_p[rank]
        out = [pa.table({"doc_id": pa.array([], pa.int64()), "lang": pa.array([], pa.string()),
                         "n_bytes": pa.array([], pa.int64()), "perplexity": pa.array([], pa.float64()),
                         "repeated": pa.array([], pa.float64()), "copies": pa.array([], pa.int64())})]
        for payload in texts.column("payload") if len(texts) else ():
            rows = _unpacked(payload)
            n, total, repeated = np.zeros(len(rows), np.int64), np.zeros(len(rows)), np.zeros(len(rows))
            for begin, part in _parts(rows.column("text").combine_chunks()):
                own, size = grams(part, order)
                sums = np.concatenate([[0.0], np.cumsum(log_p[np.searchsorted(gram, own)])])
                ends = np.cumsum(size)
                n[begin : begin + len(part)] = size
                total[begin : begin + len(part)] = sums[ends] - sums[ends - size]
                repeated[begin : begin + len(part)] = [repeats(t) for t in part]
            mean = pa.array(np.exp(-total / np.maximum(n, 1)), mask=n == 0)
            out.append(pa.table({"doc_id": rows.column("doc_id"), "lang": rows.column("lang").cast(pa.string()),
                                 "n_bytes": pa.array(n), "perplexity": mean, "repeated": pa.array(repeated),
                                 "copies": rows.column("copies")}))
        return pa.concat_tables(out)

    wanted = dealt.groupBy("block").applyInArrow(distinct, "block int, shard int, payload binary")
    counts = sharded(levels, shards)
    found = wanted.groupBy("shard").cogroup(counts.groupBy("shard")).applyInArrow(look_up, "block int, shard int, payload binary")
    pair = dealt.groupBy("block").cogroup(found.groupBy("block"))
    scored = pair.applyInArrow(score, "doc_id long, lang string, n_bytes long, perplexity double, repeated double, copies long")
    return scored.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id has quality 1 in ``labels``; ids of trusted rows are few columns."""
    ids = checkpoint(
        labels.where("quality = 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), F.lit(1).alias("_ok"))
    )
    return small_join(docs, ids, ["doc_id"], "doc_id", "_n").where("_ok = 1").drop("_ok")


def by_language(rows: DataFrame, measured: DataFrame, value: Column, name: str, least: int, default: float | None) -> DataFrame:
    """``rows`` with an aggregate of the ``measured`` rows of their language.

    A language with fewer than ``least`` measured rows, and a null one, has that of all
    measured rows; without any it is ``default``.
    """
    overall = measured.agg(value.alias(name)).first()[name]
    per_lang = measured.where("lang is not null").groupBy("lang").agg(value.alias(name), F.count(F.lit(1)).alias("n"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    table = checkpoint(sizes.join(per_lang.where(F.col("n") >= least).drop("n"), "lang"))
    joined = small_join(rows, table, ["lang"], "doc_id", "_n")
    return joined.withColumn(name, F.coalesce(name, F.lit(overall if overall is not None else default).cast("double")))


def quality(
    docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = 0.995, slack: float = 1.1,
    prior_bytes: int = 32, least: int = 30, repeat_slack: float = 2.0, blocks: int | None = None,
) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, judged, threshold, repeated, repeat_limit and kept of every row of ``docs``.

    Trusted are the rows whose id has quality 1 in ``labels``. Those whose crc32 of
    the id leaves remainder 1 give the limits, the others train the model. Few bytes
    say little: ``judged`` is the perplexity of the text and ``prior_bytes`` more of
    the median perplexity of its language. A text is kept if that is at most the
    ``quantile`` of its language times ``slack``, and ``repeated`` at most the same
    quantile of ``repeated`` times ``repeat_slack``. Without ``least`` held-out trusted
    rows in all there is no ``repeat_limit``: so few do not show how often words repeat.

    A language with fewer than ``least`` trusted rows, and a null one, is measured by
    all; without any, every text with a perplexity is kept. A null or empty text has
    no perplexity and is not kept. Repeated rows come back as often.
    """
    docs = docs.select("doc_id", "text", "lang")
    own = trusted(docs, labels)
    levels = model(gram_counts(own.where((fold() != 1) & F.col("text").isNotNull()), order), order)
    scored = checkpoint(perplexities(docs, levels, blocks))
    usable = (fold() == 1) & F.col("perplexity").isNotNull()
    median = F.percentile_approx("perplexity", 0.5, 10_000)
    typical = by_language(scored, trusted(scored, labels).where(usable), median, "typical", least, None)
    bits = F.col("n_bytes") * F.log("perplexity") + prior_bytes * F.log(F.coalesce("typical", "perplexity"))
    judged = checkpoint(typical.withColumn("judged", F.exp(bits / (F.col("n_bytes") + prior_bytes))).drop("typical"))
    high = F.percentile_approx("judged", quantile, 10_000) * slack
    limited = by_language(judged, trusted(judged, labels).where(usable), high, "threshold", least, float("inf"))
    often = F.when(F.count(F.lit(1)) >= least, F.percentile_approx("repeated", quantile, 10_000) * repeat_slack)
    limited = by_language(limited, trusted(judged, labels).where(usable), often, "repeat_limit", least, float("inf"))
    usual = (F.col("judged") <= F.col("threshold")) & (F.col("repeated") <= F.col("repeat_limit"))
    return limited.select("doc_id", "lang", "n_bytes", "perplexity", "judged", "threshold", "repeated", "repeat_limit",
                          F.coalesce(usual, F.lit(False)).alias("kept"))
