"""Alignment of two tokenizers against the libraries, document by document."""

import hashlib
import json
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.test_tokens import odd_texts
from txnrisk.llm import alignment, chunks, queries
from txnrisk.llm.queries import BYTE_BPE, PIECES

SF = "/root/testdata/sf0.001"


def plain(texts):
    """The rows of the operator from whole texts, by the libraries."""
    a_lib = Tokenizer.from_file(BYTE_BPE)
    a_lib.encode_special_tokens = True
    vocab = json.load(open(BYTE_BPE))["model"]["vocab"]
    letter = {c: b for b, c in enumerate(chunks.byte_letters())}
    name = {i: n for n, i in vocab.items()}
    b_lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = a_lib.encode(whole.decode(), add_special_tokens=False).ids
        b = b_lib.encode(text or "")
        a_bytes = [bytes(letter[c] for c in name[i]) for i in a]
        b_bytes = [bytes([int(p[1:-1], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode()
                   for i in b for p in [b_lib.id_to_piece(i)]]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            docs.append(([], [], [], ""))
            continue
        a_end, b_end = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        shared = sorted(set(a_end) & set(b_end))
        groups, links, at = [], [], 0
        for end in shared:
            groups.append(",".join(str(i) for i, e in zip(a, a_end) if at < e <= end) + "|"
                          + ",".join(str(i) for i, e in zip(b, b_end) if at < e <= end))
            at = end
        ends = dict(zip(b_end, b))
        links = [(i, ends[e]) for i, e in zip(a, a_end) if e in ends]
        docs.append((a, b, links, ";".join(groups)))
    counts = Counter(link for d in docs for link in d[2])
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(
        len(a), len(b), groups.count(";") + bool(groups), len(links), sum(counts[k] == best[k[1]] for k in links),
        sum(counts[k] for k in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "", groups,
    ) for a, b, links, groups in docs]


def found(df):
    return [tuple(r)[1:] for r in df.orderBy("doc_id").collect()]


def frame(spark, texts):
    rows = [(k, t, 1, "x", 2) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, row int, links string, n long").repartition(4)


@pytest.mark.parametrize("limit, slice_bytes, held", [(10**6, 4 << 20, 1 << 20), (0, 2000, 50)])
def test_alignment_equals_the_libraries(spark, hot, monkeypatch, limit, slice_bytes, held):
    monkeypatch.setattr(chunks, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(alignment, "HELD_PAIRS", held)
    texts = [*odd_texts(400), "x▁y z", "  two", " one", "a   b  \n c", "<s> </s> <unk> <0x41>", "\x00 \x7f é é x",
             "a  b", "字 字字 ", "same words here", "same words here", None]
    expected = plain(texts)
    assert found(alignment.alignment(frame(spark, texts), BYTE_BPE, PIECES, limit)) == [e[:-1] for e in expected]
    assert any(e[0] == 0 and t for e, t in zip(expected, texts)) and any(e[4] < e[3] for e in expected)


def test_groups_and_links_in_full(spark):
    texts = ["the tokenizers' tokens", "über  <|endoftext|>"]
    rows = alignment.align(frame(spark, texts), BYTE_BPE, PIECES, keep_groups=True).orderBy("doc_id").collect()
    for r, e in zip(rows, plain(texts)):
        assert r.groups == e[-1] and len(r.links) == 8 * r.n_links
        pairs = np.frombuffer(r.links, "<i8")
        last = [tuple(int(s.split(",")[-1]) for s in g.split("|")) for g in r.groups.split(";")]
        assert list(zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist())) == last


def test_repeats_nulls_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None), (3, "a b")], "doc_id long, text string")
    got = alignment.alignment(docs, BYTE_BPE, PIECES).collect()
    assert sorted((r.doc_id or -1, r.n_a, r.n_links, r.count_sum) for r in got) == [
        (-1, 2, 2, 6), (-1, 2, 2, 6), (3, 0, 0, 0), (3, 2, 2, 6)]
    for limit in (0, 10):
        assert alignment.alignment(docs.where("false"), BYTE_BPE, PIECES, limit).count() == 0
        one = alignment.alignment(docs.where("text is null"), BYTE_BPE, PIECES, limit).collect()
        assert [tuple(r) for r in one] == [(3, 0, 0, 0, 0, 0, 0, "")]


def test_aligner_forgets_and_learns_again(monkeypatch):
    own = alignment.Aligner(alignment.byte_level(BYTE_BPE), alignment.pieces(PIECES), limit=3)
    texts = ["one two three four", "five six one", "one two"]
    for _ in range(2):
        for t, e in zip(texts, plain(texts)):
            slots, _ = own.chunk_slots([t])
            assert b"".join(own.text[s] for s in slots)[:-1].decode() == e[-1]


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9)), max_size=30))
@settings(max_examples=100, deadline=None)
def test_coalesce_of_any_intervals(intervals):
    start = np.array([s for s, _ in intervals], np.int64)
    end = start + np.array([n for _, n in intervals], np.int64)
    order, begins = alignment.coalesce(start, end, np.zeros(len(start), np.int64))
    covered = np.zeros(64, bool)
    for s, e in zip(start, end):
        covered[s : e - 1] = True  # joints between neighbouring bytes
    # two bytes are in one group if no joint between them is free
    assert begins.sum() == len({0 if s == 0 else int((~covered[:s]).sum()) for s in start.tolist()}) if len(start) else True
    assert sorted(order.tolist()) == list(range(len(start)))


@given(st.lists(st.integers(1, 5), min_size=1, max_size=12), st.data())
@settings(max_examples=80, deadline=None)
def test_overlaps_of_two_tilings(lengths, data):
    a_end = np.cumsum(lengths)
    cuts = sorted(data.draw(st.sets(st.integers(1, max(1, int(a_end[-1]) - 1)))) - {int(a_end[-1])})
    b_end = np.array([*cuts, int(a_end[-1])])
    a_start, b_start = np.concatenate([[0], a_end[:-1]]), np.concatenate([[0], b_end[:-1]])
    x, y = alignment.overlaps(a_start, a_end, b_start, b_end)
    assert list(zip(x.tolist(), y.tolist())) == [
        (i, j) for i in range(len(a_end)) for j in range(len(b_end)) if a_start[i] < b_end[j] and b_start[j] < a_end[i]]


def test_query_equals_the_libraries(spark):
    from txnrisk.llm.tables import read

    docs = read(spark, SF, "documents").orderBy("doc_id").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_token_alignment(spark, SF).collect()}
    assert [got[r.doc_id] for r in docs] == [e[:-1] for e in plain([r.text for r in docs])] and len(got) == len(docs)
