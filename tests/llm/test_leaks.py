"""Benchmark passages against a plain search of every window."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import TEXTS
from txnrisk.llm import leaks, queries, words

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall((text or "").translate(words.LOWER_AZ))


def plain(docs, items):
    """n_words, n_hit, item ids of each document, by all windows of all items."""
    windows = {}
    for item, text in items:
        own = plain_words(text)
        width = min(10, len(own))
        for a in range(len(own) - width + 1) if own else ():
            windows.setdefault(tuple(own[a : a + width]), set()).add("" if item is None else str(item))
    out = []
    for text in docs:
        own, hit, found = plain_words(text), set(), set()
        for width in {len(w) for w in windows}:
            for a in range(len(own) - width + 1):
                if (key := tuple(own[a : a + width])) in windows:
                    hit |= set(range(a, a + width))
                    found |= windows[key]
        out.append((len(own), len(hit), sorted(found, key=str.encode)))
    return out


def plain_longest(docs, items):
    """item: (words, start in it, document, place) of the longest common run of a window or more."""
    best = {}
    for item, text in items:
        own = plain_words(text)
        least = min(10, len(own))
        for d, doc in enumerate(docs):
            other = plain_words(doc)
            for a in range(len(own)):
                for b in range(len(other)):
                    n = 0
                    while a + n < len(own) and b + n < len(other) and own[a + n] == other[b + n]:
                        n += 1
                    if own and n >= least:
                        key = (-n, a, d, b)
                        best[str(item)] = min(best.get(str(item), key), key)
    return {i: (-n, a, d, b) for i, (n, a, d, b) in best.items()}


def rows(table):
    return [(r.n_words, r.n_hit, r["items"]) for r in table.orderBy("doc_id").collect()]


def frame(spark, column, values, first=0):
    made = [(first + i, t, 1, "x") for i, t in enumerate(values)]
    return spark.createDataFrame(made, f"{column} long, text string, n_hit int, words string").repartition(3)


def made_case(seed, n_items=12, n_docs=25):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "c9", "ü", "dd", "字", "e"]

    def run(n):
        return " ".join(rng.choice(vocabulary) + rng.choice(["", ",", " -"]) for _ in range(n))

    items = [run(rng.choice([0, 1, 3, 9, 10, 11, 30, 60])) for _ in range(n_items)] + [None, "", "e " * 40]
    docs = []
    for _ in range(n_docs):
        passage = rng.choice(items) or ""
        cut = rng.randrange(len(passage) + 1)
        docs.append(run(rng.randrange(30)) + " q " + passage[cut // 2 : cut + 30] + " q " + run(rng.randrange(9)))
    return [*docs, *docs[:3], *TEXTS, "e " * 300], items


@pytest.mark.parametrize("seed, slice_bytes, block", [(1, 4 << 20, 16 << 20), (2, 150, 16 << 20), (3, 150, 300)])
def test_leaks_equal_a_plain_search(spark, monkeypatch, seed, slice_bytes, block):
    monkeypatch.setattr(leaks.chunks, "SLICE_BYTES", slice_bytes)
    docs, items = made_case(seed)
    monkeypatch.setattr(leaks.item_blocks, "__defaults__", (leaks.WINDOW, block))
    got = leaks.leaks(frame(spark, "doc_id", docs), frame(spark, "item_id", items, 100))
    expected = plain(docs, list(enumerate(items, 100)))
    assert rows(got) == expected
    for r in got.collect():
        assert sum(s.length for s in r.spans) == r.n_hit and r.contaminated == (r.n_hit > 0)
        assert all(a.start + a.length <= b.start for a, b in zip(r.spans, r.spans[1:]))
    kept = leaks.clean(frame(spark, "doc_id", docs), frame(spark, "item_id", items, 100))
    assert kept.columns == ["doc_id", "text", "n_hit", "words"]
    assert sorted(r.doc_id for r in kept.collect()) == [d for d, (_, hit, _) in enumerate(expected) if not hit]


@pytest.mark.parametrize("seed, block", [(4, 16 << 20), (5, 300)])
def test_longest_matches_equal_a_plain_search(spark, monkeypatch, seed, block):
    monkeypatch.setattr(leaks.chunks, "SLICE_BYTES", 400)
    monkeypatch.setattr(leaks.item_blocks, "__defaults__", (leaks.WINDOW, block))
    docs, items = made_case(seed, 6, 10)
    got = leaks.longest_matches(frame(spark, "doc_id", docs), frame(spark, "item_id", items, 100))
    found = {r.item_id: (r.n_words, r.item_start, r.doc_id, r.doc_start) for r in got.collect()}
    assert found == plain_longest(docs, list(enumerate(items, 100)))


@given(st.lists(st.integers(0, 3), max_size=60))
@settings(max_examples=150, deadline=None)
def test_suffix_array(numbers):
    text = np.array(numbers, np.int32)
    order = leaks.suffix_array(text, len(text))
    assert order.tolist() == sorted(range(len(numbers)), key=lambda i: numbers[i:])


def test_long_items_go_in_overlapping_pieces(spark):
    text = " ".join(f"w{k % 700}" for k in range(2000))
    items = spark.createDataFrame([(1, text), (2, "a b")], "item_id long, text string")
    found = [(r.item_id, r["first"], r.words) for r in leaks.item_pieces(items, 10, 64).collect()]
    windows = {tuple(w[k : k + 10]) for i, _, w in found for k in range(len(w) - 9) if i == "1"}
    own = text.split()
    assert windows == {tuple(own[k : k + 10]) for k in range(1991)} and ("2", 0, ["a", "b"]) in found


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame(
        [(None, "one two"), (None, "One, TWO!"), (7, "one"), (7, "one"), (7, None)], "doc_id long, text string")
    items = spark.createDataFrame([(None, "one two"), (None, "nothing"), (3, None), (4, " ")], "item_id long, text string")
    got = leaks.leaks(docs, items)
    assert sorted((r.doc_id or -1, r.n_words, r.n_hit, r["items"]) for r in got.collect()) == [
        (-1, 2, 2, [""]), (-1, 2, 2, [""]), (7, 0, 0, []), (7, 1, 0, []), (7, 1, 0, [])]
    assert [r.text for r in leaks.clean(docs, items).orderBy("text").collect()] == [None, "one", "one"]
    assert leaks.leaks(docs.where("false"), items).count() == 0
    assert leaks.longest_matches(docs.where("false"), items).count() == 0
    none = items.where("false")
    assert rows(leaks.leaks(docs, none).where("doc_id is null")) == [(2, 0, []), (2, 0, [])]
    assert leaks.clean(docs, none).count() == 5 and leaks.longest_matches(docs, none).count() == 0


def test_words_of_slices_and_nulls():
    texts = pa.array(["skip", "Ab1 c", None, "", "é-b", "b"])[1:]
    distinct, code, counts = words.split(texts, words.LETTERS)
    assert counts.tolist() == [2, 0, 0, 2, 1]
    assert [distinct[i].as_py() for i in code] == ["ab", "c", "é", "b", "b"]


def test_query_equals_a_plain_search(spark):
    from txnrisk.llm.tables import read

    got = {r.doc_id: r for r in queries.op13_benchmark_leaks(spark, SF).collect()}
    docs = read(spark, SF, "documents").orderBy("doc_id").collect()
    items = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    expected = plain([r.text for r in docs], items)
    assert len(got) == len(docs) and sum(e[1] > 0 for e in expected) > 0
    for r, (n_words, n_hit, found) in zip(docs, expected):
        one = got[r.doc_id]
        assert (one.n_words, one.n_hit, one.n_items) == (n_words, n_hit, len(found))
        assert one.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert one.contaminated == (n_hit > 0)
