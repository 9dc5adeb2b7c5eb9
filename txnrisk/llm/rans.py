"""Operator 10: token ids in files, coded by a static range asymmetric numeral system.

Documents are placed by ranges of doc_id and sorted, so that each task writes one
file in the order of all documents. A file is a Parquet part whose rows are
segments; a segment holds whole documents of together ``SEGMENT`` ids or one longer
document:

* ``table``: the frequencies of its ids, scaled to a sum of 2**BITS (zlib, unsigned
  32-bit), shared by all blocks of the segment
* ``blocks``: independent streams of ``BLOCK`` ids each. ``LANES`` states take turns
  id by id, so a step handles ``LANES`` ids at once; a stream is a list of 32-bit
  words. Before every ``SECTION`` steps a checkpoint keeps all states, the position
  in the words and the crc32 of the section's ids, so a section can be decoded and
  verified without what stands before it
* ``doc_ids`` and ``lengths``: the documents and their numbers of ids

Spark's writer commits a file only when its task succeeds, so lost executors leave
no half-written file behind.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txnrisk.functions.scale import small_join
from txnrisk.llm import chunks
from txnrisk.llm.tables import spread, text_rows
from txnrisk.session import checkpoint, ensure_checkpoint_dir

BITS = 20
LOW = np.uint64(1 << 31)
LANES, BLOCK, SECTION, SEGMENT = 1024, 1 << 19, 256, 1 << 22
_BITS, _WORD = np.uint64(BITS), np.uint64(32)
SCHEMA = ("file int, segment int, n_tokens long, doc_ids array<long>, lengths array<long>, "
          "table binary, blocks array<binary>")


class Table:
    """Frequencies that sum to 2**BITS, every id that occurs at least 1."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.below = np.cumsum(self.freq) - self.freq

    @staticmethod
    def of(ids: np.ndarray) -> Table:
        count = np.bincount(ids)
        seen = np.count_nonzero(count)
        room = (1 << BITS) - seen
        if room < 0:
            raise ValueError(f"more than {1 << BITS} different ids in a segment")
        freq = (count > 0) + (count * room) // max(1, len(ids))
        if seen:
            freq[np.argmax(count)] += (1 << BITS) - freq.sum()
        return Table(freq)

    def pack(self) -> bytes:
        return zlib.compress(self.freq.astype("<u4").tobytes(), 6)

    @staticmethod
    def unpack(data: bytes) -> Table:
        return Table(np.frombuffer(zlib.decompress(data), "<u4"))

    def slots(self) -> np.ndarray:
        """The id of each of the 2**BITS slots."""
        return np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    """One independent stream: sizes, checkpoints (position, crc32, states), words."""
    steps = -(-len(ids) // LANES)
    padded = np.full(steps * LANES, ids[-1] if len(ids) else 0, np.int64)
    padded[: len(ids)] = ids
    padded = padded.reshape(steps, LANES)
    state = np.full(LANES, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, int, bytes]] = []
    written = 0
    for t in range(steps - 1, -1, -1):
        f, below = table.freq[padded[t]], table.below[padded[t]]
        full = state >= f << np.uint64(63 - BITS)
        out = state[full]
        words.append(out.astype("<u4"))
        written += len(out)
        state[full] = out >> _WORD
        q = state // f
        state = (q << _BITS) + (state - q * f) + below
        if t % SECTION == 0:
            crc = zlib.crc32(ids[t * LANES : (t + SECTION) * LANES].astype("<u4").tobytes())
            marks.append((written, crc, state.astype("<u8").tobytes()))
    head = np.array([len(ids), len(marks), written], "<u8").tobytes()
    body = b"".join(np.array([written - at, crc], "<u8").tobytes() + s for at, crc, s in reversed(marks))
    return head + body + b"".join(w.tobytes() for w in reversed(words))


def decode_section(block: bytes, k: int, table: Table, slots: np.ndarray) -> np.ndarray:
    """Ids of section ``k`` alone; raises when their checksum does not hold."""
    n, marks, _ = (int(v) for v in np.frombuffer(block, "<u8", 3))
    size = 16 + 8 * LANES
    at, crc = (int(v) for v in np.frombuffer(block, "<u8", 2, 24 + k * size))
    state = np.frombuffer(block, "<u8", LANES, 24 + k * size + 16).copy()
    words = np.frombuffer(block, "<u4", offset=24 + marks * size)
    steps = min(SECTION, -(-n // LANES) - k * SECTION)
    out = np.empty((steps, LANES), np.uint32)
    mask = np.uint64((1 << BITS) - 1)
    for t in range(steps):
        slot = state & mask
        ids = slots[slot.astype(np.int64)]
        out[t] = ids
        state = table.freq[ids] * (state >> _BITS) + slot - table.below[ids]
        low = np.flatnonzero(state < LOW)
        state[low] = state[low] << _WORD | words[at : at + len(low)]
        at += len(low)
    ids = out.reshape(-1)[: n - k * SECTION * LANES]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError(f"section {k} of a block does not match its checksum")
    return ids


def decode_block(block: bytes, table: Table, slots: np.ndarray) -> np.ndarray:
    marks = int(np.frombuffer(block, "<u8", 1, 8)[0])
    return np.concatenate([np.zeros(0, np.uint32), *(decode_section(block, k, table, slots) for k in range(marks))])


def write_ids(docs: DataFrame, path: str, folder: str, end_id: int = 1, partitions: int | None = None) -> None:
    """Write the ids of all documents, each followed by ``end_id``, in order of doc_id.

    A null text counts as empty: its document holds the end id only. Rows with the
    same doc_id are documents of their own, ordered by text. An empty table gives
    no segment.
    """
    schema = pa.schema([
        ("file", pa.int32()), ("segment", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())), ("table", pa.binary()), ("blocks", pa.list_(pa.binary())),
    ])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, file, segment = chunks.word_end(path), TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        doc_ids: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            ids, table = np.concatenate(held), None
            table = Table.of(ids)
            blocks = [encode_block(ids[at : at + BLOCK], table) for at in range(0, len(ids), BLOCK)]
            row = [file, segment, len(ids), pa.concat_arrays(doc_ids), np.concatenate(lengths), table.pack(), blocks]
            for x in (held, doc_ids, lengths):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for begin, part in chunks.slices(batch.column("text")):
                ids, counts = words.texts(part)
                ends = np.cumsum(counts)
                ids, counts = np.insert(ids, ends, np.uint32(end_id)), counts + 1
                held.append(ids)
                doc_ids.append(batch.column("doc_id").slice(begin, len(part)))
                lengths.append(counts)
                size += len(ids)
                if size >= SEGMENT:
                    yield close()
                    segment, size = segment + 1, 0
        if size:
            yield close()

    n = partitions or spread(docs.sparkSession, None, 1)
    ordered = text_rows(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, SCHEMA).write.parquet(folder)


def read_ids(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files.

    ``start`` counts the ids of all documents before it. With ``keep_ids`` also the
    ids themselves, as an array.
    """
    files = spark.read.schema(SCHEMA).parquet(folder)
    schema = "file int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long"
    schema += ", ids array<long>" if keep_ids else ""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                one = {n: batch.column(n)[row] for n in batch.schema.names}
                table = Table.unpack(one["table"].as_py())
                slots = table.slots()
                ids = np.concatenate([decode_block(b.as_py(), table, slots) for b in one["blocks"].values])
                doc_ids, counts = one["doc_ids"].values, one["lengths"].values.to_numpy()
                if counts.sum() != len(ids):
                    raise ValueError("a segment holds another number of ids than its documents")
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist())]
                n = len(counts)
                columns = [
                    np.full(n, one["file"].as_py(), np.int32), np.full(n, one["segment"].as_py(), np.int32),
                    doc_ids, ends - counts, counts, np.array(crc, np.int64),
                ]
                names = ["file", "segment", "doc_id", "at", "n_tokens", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array([ids[a:b].astype(np.int64) for a, b in zip(ends - counts, ends)], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    sizes = files.select("file", "segment", "n_tokens", F.size("lengths").cast("long").alias("n_docs"))
    # one row per file, then one per segment of a file
    earlier = (Window.unboundedPreceding, -1)
    per_file = sizes.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    per_file = per_file.select("file", F.sum("n").over(Window.orderBy("file").rowsBetween(*earlier)).alias("files_before"))
    within = Window.partitionBy("file").orderBy("segment").rowsBetween(*earlier)
    offsets = sizes.withColumn("segments_before", F.sum("n_tokens").over(within)).join(per_file, "file")
    offsets = checkpoint(offsets.select(
        "file", "segment", "n_docs",
        (F.coalesce("files_before", F.lit(0)) + F.coalesce("segments_before", F.lit(0))).alias("before"),
    ))
    decoded = files.mapInArrow(decode, schema)
    joined = small_join(decoded, offsets, ["file", "segment"], "doc_id", "n_docs")
    kept = ["ids"] if keep_ids else []
    return joined.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *kept)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def store_and_read(docs: DataFrame, path: str) -> DataFrame:
    """Write the ids of ``docs`` to a new shared folder and read them back."""
    spark = docs.sparkSession
    folder = new_folder(spark, "token-ids")
    write_ids(docs, path, folder)
    return read_ids(spark, folder)
