"""The Kneser-Ney model against a plain one, and the decisions on given and odd rows."""

import math
from collections import Counter

import numpy as np
import pytest

from txnrisk.llm import quality

SF = "/root/testdata/sf0.001"


class Plain:
    """Interpolated modified Kneser-Ney by the definition, with dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        counts = Counter()
        for t in texts:
            raw = bytes(order - 1) + t.encode()
            counts.update(raw[i : i + order] for i in range(len(raw) - order + 1))
        self.counts = {order: counts}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.context = {}
        self.d = {}
        for k, table in self.counts.items():
            self.d[k] = quality.discounts(tuple(sum(c == j for c in table.values()) for j in range(1, 5)))
            for g, c in table.items():
                own = self.context.setdefault((k, g[:-1]), [0, 0.0])
                own[0] += c
                own[1] += self.d[k][min(c, 3) - 1]

    def p(self, gram):
        if not gram:
            return 1 / 256
        k = len(gram)
        lower = self.p(gram[1:])
        if (k, gram[:-1]) not in self.context:
            return lower
        total, off = self.context[k, gram[:-1]]
        c = self.counts[k].get(gram, 0)
        return (max(c - self.d[k][min(c, 3) - 1], 0) if c else 0) / total + off / total * lower

    def perplexity(self, text):
        raw = bytes(self.order - 1) + text.encode()
        logs = [math.log(self.p(raw[i : i + self.order])) for i in range(len(raw) - self.order + 1)]
        return math.exp(-sum(logs) / len(logs)) if logs else None


def test_grams_end_at_every_byte():
    flat, size = quality.grams([b"ab", b"", b"xyz"], 3)
    assert size.tolist() == [2, 0, 3]
    assert [g.to_bytes(3, "big") for g in flat.tolist()] == [b"\0\0a", b"\0ab", b"\0\0x", b"\0xy", b"xyz"]


@pytest.mark.parametrize("order", [2, 5])
def test_perplexity_equals_the_plain_model(spark, order, monkeypatch):
    monkeypatch.setattr(quality, "PART", 5000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    texts = {r.doc_id: r.text for r in docs.collect()}
    learned = [t for i, t in texts.items() if i % 2]
    plain = Plain(learned, order)
    own = spark.createDataFrame([(t,) for t in learned], "text string").repartition(4)
    levels = quality.model(quality.gram_counts(own, order), order)
    # every context is a distribution over the bytes
    p = sum(plain.p(b"the "[: order - 1] + bytes([b])) for b in range(256))
    assert abs(p - 1) < 1e-9
    got = {r.doc_id: r for r in quality.perplexities(docs, levels, 7).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        assert got[i].n_bytes == len(t.encode())
        assert got[i].perplexity == pytest.approx(plain.perplexity(t), rel=1e-5)


def test_trusted_texts_stay_and_junk_goes(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert len(got) == docs.count()
    label = {r.doc_id: r.quality for r in labels.collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    good = [got[i].kept for i, q in label.items() if q == 1]
    assert np.mean(good) > 0.98
    loud = [got[i].kept for i, q in label.items() if q == 0 and ("&&&" in text[i] or text[i].isupper())]
    assert loud and np.mean(loud) < 0.05


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, 1, "x") for i in range(12)] + [(None, 1, "x"), (3, None, "y")], "doc_id long, quality int, text string")
    got = {r.doc_id: r for r in quality.quality(odd_docs, labels, least=1).collect()}
    assert len(got) == odd_docs.count()
    assert not got[0].kept and not got[1].kept and got[0].perplexity is None
    twice = quality.quality(odd_docs.unionByName(odd_docs), labels).collect()
    assert len(twice) == 2 * len(got)
    untrusted = quality.quality(odd_docs, labels.where("doc_id < 0")).collect()
    assert {r.kept for r in untrusted if r.n_bytes} == {True}
    assert all(r.perplexity == pytest.approx(256) for r in untrusted if r.n_bytes)
    assert quality.quality(no_docs, labels).count() == 0


def test_repeated_words_go_and_good_rows_stay(spark):
    assert quality.repeats(b"") == 0 and quality.repeats(b"The the The the", 0) == 0.75
    assert quality.repeats(b"a b c a b c a b c", 0) == pytest.approx(6 / 9)
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    label = {r.doc_id: r.quality for r in labels.collect()}
    words = {r.doc_id: r.text.split() for r in docs.collect()}
    same = {i for i, w in words.items() if 2 * sum(a == b for a, b in zip(w, w[1:])) > len(w)}
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert any(label[i] == 0 for i in same if i in label) and not any(got[i].kept for i in same)
    usual = [i for i, q in label.items() if q == 1]
    assert np.mean([got[i].repeated <= got[i].repeat_limit for i in usual]) > 0.99
    assert np.mean([got[i].kept for i in usual]) > 0.98


def test_blocks_follow_the_bytes_and_repeated_ids_are_spread(spark, monkeypatch):
    rows = [(7, f"text number {k} " * 20, "en") for k in range(300)] + [(7, "the same row", "en")] * 200 + [(7, None, "en")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    own = spark.createDataFrame([(t,) for _, t, _ in rows if t], "text string")
    levels = quality.model(quality.gram_counts(own))
    sizes = []
    monkeypatch.setattr(quality, "spread", lambda session, n_bytes, target: sizes.append(n_bytes) or max(8, n_bytes // 4000))
    got = quality.perplexities(docs, levels)
    assert len(sizes) == 2 and sizes[0] == sum(len(t.encode()) for _, t, _ in rows if t) < sizes[1]
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    found = got.withColumn("part", quality.F.spark_partition_id()).collect()
    spark.conf.set(coalesce, before)
    assert len(found) == len(rows) and sum(r.perplexity is None for r in found) == 3
    few = {(r.n_bytes, round(r.perplexity or 0, 4)) for r in quality.perplexities(docs, levels, 1, 1).collect()}
    assert {(r.n_bytes, round(r.perplexity or 0, 4)) for r in found} == few
    assert len({r.part for r in found}) > 1
