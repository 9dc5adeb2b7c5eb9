"""Token operators against the tokenizers library, round trips and a plain packer."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import TEXTS
from txnrisk.llm import bpe, chunks, packing, rans, token_counts
from txnrisk.llm.queries import BYTE_BPE, WORD_BPE


def odd_texts(n=1500):
    rng = random.Random(7)
    pieces = list(" \n\ta.b'sé<|1　\x1cΣ") + ["the", "<|endoftext|>", "<|EndOfText|>", "<|STARTOFTEXT|>", "<|startoftext|>", "'ll", "ing", "Q"]
    made = ["".join(rng.choice(pieces) for _ in range(rng.randrange(50))) for _ in range(n)]
    return [t or "" for t in TEXTS] + made


def library_ids(path, texts):
    tokenizer = Tokenizer.from_file(path)
    return [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("make, path", [
    (chunks.library, BYTE_BPE), (chunks.byte_level, BYTE_BPE), (chunks.word_end, WORD_BPE),
    (lambda p: chunks.ChunkTable(bpe.merges(p).encode, space=True, limit=50), BYTE_BPE),
])
def test_chunk_tables_equal_the_library(make, path):
    texts = odd_texts()
    ids, counts = make(path).texts(pa.array(texts))
    found = np.split(ids, np.cumsum(counts)[:-1])
    assert [f.tolist() for f in found] == library_ids(path, texts)


def test_one_long_word_by_heap(monkeypatch):
    rules = bpe.merges(BYTE_BPE)
    texts = ["abcabc" * 40, "a" * 333, "thethingother" * 9]
    rounds = rules.encode(texts)
    monkeypatch.setattr(bpe, "LONG_WORD", 2)
    heap = rules.encode(texts)
    assert rounds[0].tolist() == heap[0].tolist() == sum(library_ids(BYTE_BPE, texts), [])


def test_token_counts(odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(token_counts, "PIECE_CHARS", 100)
    got = {r.doc_id: r for r in token_counts.token_counts(odd_docs, BYTE_BPE).collect()}
    for i, ids in enumerate(library_ids(BYTE_BPE, [t or "" for t in TEXTS])):
        assert (got[i].n_tokens, got[i].n_bytes) == (len(ids), len((TEXTS[i] or "").encode()))
        assert got[i].over_limit == (len(ids) > 1024)
    assert token_counts.token_counts(no_docs, BYTE_BPE).count() == 0


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(token_counts, "PIECE_CHARS", 10)
    monkeypatch.setattr(chunks, "SLICE_BYTES", 10)
    texts = odd_texts(200)
    assert token_counts.lengths(pa.array(texts), BYTE_BPE).tolist() == [len(x) for x in library_ids(BYTE_BPE, texts)]


def test_bpe_round_trip(odd_docs, no_docs):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    for r in bpe.round_trip(odd_docs, BYTE_BPE, keep_ids=True).collect():
        ids = tokenizer.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        raw, text = np.array(ids, "<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), raw, text)
        assert r.ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip(no_docs, BYTE_BPE).count() == 0


def check_packing(rows, lengths_of, capacity):
    """Every piece placed once, sequences without gap or overlap; returns their number."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc, n in lengths_of.items():
        own = sorted(by_doc.pop(doc), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert sum(r.length for r in own) == n and all(r.length == capacity for r in own[1:])
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
    assert not by_doc
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq)


def test_packing(odd_docs, no_docs):
    ids = [x + [0] for x in library_ids(BYTE_BPE, [t or "" for t in TEXTS])]
    rows = packing.pack_documents(odd_docs, BYTE_BPE, 64).collect()
    check_packing(rows, {i: len(x) for i, x in enumerate(ids)}, 64)
    for r in rows:
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(own)
    assert packing.pack_documents(no_docs, BYTE_BPE).count() == 0


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("capacity, seed", [(30, 1), (64, 2), (100, 3), (2048, 4)])
def test_plan_is_as_good_as_best_fit(capacity, seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, capacity + 1, 400).tolist() + rng.integers(1, capacity // 4, 300).tolist() + [capacity // 3] * 50
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    steps = packing.plan(counts, capacity)
    fill, places = {}, {n: set() for n in counts}
    for length, rank, n, first, each, offset in steps.tolist():
        for k in range(n):
            places[length].add(rank + k)
            fill.setdefault(first + k // each, []).append((offset + k % each * length, length))
    assert {n: len(p) for n, p in places.items()} == counts
    for own in fill.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(fill) <= best_fit_decreasing(lengths, capacity)
    assert sorted(fill) == list(range(len(fill)))


def test_plan_of_one_hot_length():
    assert len(packing.plan({3: 10**12, 7: 1}, 10)) < 10
    assert packing.plan({}, 10).shape == (0, 6)


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 300_000])
def test_rans_block(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 49_407).astype(np.uint32)
    if not n:
        return
    table = rans.Table.unpack(rans.Table.of(ids).pack())
    assert int(table.freq.sum()) == 1 << rans.BITS
    block, slots = rans.encode_block(ids, table), table.slots()
    assert rans.decode_block(block, table, slots).tolist() == ids.tolist()
    if n == 300_000:
        section = rans.SECTION * rans.LANES
        assert rans.decode_section(block, 1, table, slots).tolist() == ids[section : 2 * section].tolist()
        p = np.bincount(ids) / n
        entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() / 8 * n
        assert len(block) < 1.08 * entropy + 2 * 8 * rans.LANES
        broken = bytearray(block)
        broken[-100] ^= 1
        with pytest.raises(ValueError):
            rans.decode_block(bytes(broken), table, slots)


@pytest.mark.parametrize("segment", [1 << 22, 50])
def test_files_hold_all_ids_in_order(spark, odd_docs, no_docs, segment, monkeypatch):
    monkeypatch.setattr(rans, "SEGMENT", segment)
    folder = rans.new_folder(spark, "test-ids")
    rans.write_ids(odd_docs, WORD_BPE, folder, partitions=4)
    rows = {r.doc_id: r for r in rans.read_ids(spark, folder, keep_ids=True).collect()}
    start = 0
    for i, ids in enumerate(library_ids(WORD_BPE, [t or "" for t in TEXTS])):
        ids = ids + [1]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids) == (start, len(ids), ids)
        assert rows[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert rans.store_and_read(no_docs, WORD_BPE).count() == 0


def test_null_repeated_and_large_ids(spark):
    """Every row is a document of its own, whatever its id; ids above 2^53 come back as they are."""
    large = (1 << 60) + 1
    rows = [(None, "no id"), (None, "no id"), (large, "one two"), (large, "one two"), (7, None)]
    docs = spark.createDataFrame([(*r, 1, "x", "h") for r in rows],
                                 "doc_id long, text string, n int, digest string, hash string").coalesce(1)
    byte, word = ([len(x) for x in library_ids(p, [t or "" for _, t in rows])] for p in (BYTE_BPE, WORD_BPE))

    def found(df, column):
        return sorted((r.doc_id or 0, r[column]) for r in df.collect())

    def expected(counts):
        return sorted((i or 0, n) for (i, _), n in zip(rows, counts))

    assert found(token_counts.token_counts(docs, BYTE_BPE), "n_tokens") == expected(byte)
    assert found(bpe.round_trip(docs, BYTE_BPE), "n_tokens") == expected(byte)
    assert found(packing.pack_documents(docs, BYTE_BPE), "length") == expected([n + 1 for n in byte])
    back = rans.store_and_read(docs, WORD_BPE)
    assert found(back, "n_tokens") == expected([n + 1 for n in word])
    assert sorted(r.start for r in back.collect())[0] == 0
