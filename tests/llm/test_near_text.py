"""Near copies of the pipeline against all pairs of exact Jaccard similarity."""

import random

import numpy as np

import corpus_pipeline
from txnrisk.llm import near_text, simhash

SF = "/root/testdata/sf0.001"


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_survivors(texts, least=0.8):
    sets = {i: plain_set(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            either = len(sets[i] | sets[j])
            if not either or len(sets[i] & sets[j]) / either >= least:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {top(i) for i in ids}


def copies():
    """A text with copies of similarity between 0.5 and 1, for each of several texts."""
    rng = random.Random(3)
    texts = {}
    for base in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([40, 200, 900]))]
        for k in range(6):
            changed = list(words)
            for at in rng.sample(range(len(words)), max(1, len(words) * k // 100)):
                changed[at] = f"n{rng.randrange(10**6)}"
            texts[10 * base + k] = " ".join(changed)
    return texts


def test_survivors_equal_all_pairs(spark, monkeypatch):
    texts = copies()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()],
                                 "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    want = plain_survivors(texts)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want < texts.keys()
    monkeypatch.setattr(near_text, "GROUP", 2)
    assert {r.doc_id for r in near_text.survivors(docs).collect()} == want


def test_survivors_of_given_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.near_dedup(spark, docs, SF)
    assert got.columns == corpus_pipeline.COLUMNS
    assert {r.doc_id for r in got.collect()} == plain_survivors({r.doc_id: r.text for r in docs.collect()})


def test_repeated_and_null_ids(spark, no_docs):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "quite another text of its own"), (None, "a b c d e f g"),
            (None, "only here and nowhere else at all"), (4, None), (5, " ")]
    got = near_text.survivors(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(1, "a b c d e f g"), (1, "quite another text of its own"), (None, "only here and nowhere else at all"), (4, None)], key=str)
    assert near_text.survivors(no_docs).count() == 0


def test_operator_7_alone_brings_near_copies_together(spark, monkeypatch):
    words = [f"w{random.Random(5).random()}-{k}" for k in range(900)]
    loop = "a b c d e f g " * 300
    texts = {3: " ".join(words), 4: " ".join([*words[:-1], "other"]), 5: "quite another text", 6: loop + "one two three four five six",
             7: loop + "un deux trois quatre cinq six sept", 8: None}
    fp = dict(zip(texts, simhash.simhashes([t or "" for t in texts.values()], 5).tolist()))
    assert (fp[3] ^ fp[4]).bit_count() <= 4 and (fp[6] ^ fp[7]).bit_count() <= 4
    monkeypatch.setattr(near_text, "band_keys", lambda own: own[:0].view(np.int64))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()],
                                 "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    # 6 and 7 have a fingerprint alike and sets that are not
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {3, 5, 6, 7, 8}


def test_forest_is_exact_at_the_limit():
    a = np.arange(9, dtype=np.uint64)
    links = near_text.forest([a[:8], np.append(a[:8], [20, 21]).astype(np.uint64), np.append(a[:8], [30, 31, 32]).astype(np.uint64)], 0.8)
    assert [x.tolist() for x in links] == [[0], [1]]
