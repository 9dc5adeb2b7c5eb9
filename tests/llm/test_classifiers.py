"""Language and toxicity: held-out accuracy, gradients by their effect, odd rows."""

import zlib

import numpy as np
import pytest

from txnrisk.llm import language, toxicity

SF = "/root/testdata/sf0.01"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = language.languages(docs).collect()
    assert len(got) == len(truth) and all(r.held_out == held_out(r.doc_id) for r in got)
    right = [truth[r.doc_id] == r.lang_pred for r in got if r.held_out]
    assert np.mean(right) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_windows_cover_the_whole_text():
    assert language.windows("", 4).shape == (0, 4)
    assert language.windows("abcdé", 4).tobytes() == "abcdé".encode() + b"\0\0"
    s = language.Settings(window=16, epochs=20)
    model = language.fit(["aaa bbb " * 4, "ccc ddd " * 4] * 40, ["x", "y"] * 40, s)
    # many windows of y outvote one of x at the start
    assert language.predict(model, ["aaa bbb " * 2 + "ccc ddd " * 50, "aaa bbb ", ""])[0] == ["x", "y"][1:] + ["x", "und"]
    many, one = language.predict(model, ["ccc ddd " * 30_000, "aaa"])[0]
    assert many == "y" and one == "x"


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    got = {r.doc_id: r for r in language.languages(odd_docs).collect()}
    assert [i for i, r in got.items() if r.lang_pred == "und"] and got[0].lang_pred == "und" and got[2].score == 0
    assert {r.lang_pred for r in got.values()} == {"en", "und"}
    assert language.languages(no_docs).count() == 0
    unlabelled = odd_docs.drop("lang").selectExpr("*", "cast(null as string) lang")
    assert {r.lang_pred for r in language.languages(unlabelled).collect()} == {"und"}


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(r.held_out == held_out(r.doc_id) for r in got)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    scores = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    pos, neg = (np.array([s for s, y in scores if y == k]) for k in (1, 0))
    assert (pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2 > 0.85
    assert (neg >= 0.7).mean() < 0.03 and (pos >= 0.7).mean() > 0.4


def test_misspelt_words_are_near_the_words_they_come_from():
    rng = np.random.default_rng(2)
    plain = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(300)]
    texts, labels = [], []
    for k in range(400):
        own = list(rng.choice(plain, 60))
        if k % 4 == 0:
            own[rng.integers(60)] = "xyzzywort"
        texts.append(" ".join(own))
        labels.append(int(k % 4 == 0))
    model = toxicity.fit(texts, labels, toxicity.Settings())
    score = toxicity.Scorer(model)
    filler = " ".join(plain[:40])
    clean, same, near, long = score([
        filler, f"{filler} xyzzywort", f"{filler} xyzzywurt", " ".join(plain) + " xyzzywort" * 30 + " " + " ".join(plain)])
    assert clean < 0.3 < 0.7 < min(same, near, long)


@pytest.mark.parametrize("text, rows", [("", 0), ("Ab ab", 2)])
def test_words(text, rows):
    assert len(toxicity.words(text)) == rows
    s = toxicity.Settings()
    flat, n = toxicity.subwords(["ab", "abcdefg"], s)
    assert n.tolist() == [4 - 3 + 1 + 1 + 1, 7 + 6 + 5 + 4 + 1] and len(flat) == n.sum()


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(no_docs, labels).count() == 0
    none = toxicity.toxicity(odd_docs, labels.where("doc_id < 0")).collect()
    assert {r.predicted for r in none} == {0}
