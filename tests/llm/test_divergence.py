"""Source divergence against a plain recount, and perfect hashes."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import TEXTS
from txnrisk.llm import divergence, queries, words

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, min_docs, top):
    """rows: (lang, source, text); the operator's rows by Python integers."""
    seen, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = WORD.findall((text or "").translate(words.LOWER_AZ))
        seen[lang or ""].update(set(found))
        counts[lang or "", source or ""].update(found)
    kept = {lang: [t for t, n in c.items() if n >= min_docs] for lang, c in seen.items()}
    out = []

    def share(count, total, v):
        return 1 + 1_000_000_000 * (count + 5) // (total + 5 * v)

    for lang, terms in kept.items():
        v = len(terms)
        own = {s: c for (g, s), c in counts.items() if g == lang}
        total = {s: sum(c[t] for t in terms) for s, c in own.items()}
        everything = sum(total.values())
        p = {s: {t: share(c[t], total[s], v) for t in terms} for s, c in own.items()}
        q = {t: share(sum(c[t] for c in own.values()), everything, v) for t in terms}
        for s in own:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in terms), o.encode()) for o in own if o != s]
            term = [(q[t] - p[s][t], t.encode()) for t in terms if own[s][t] > 0 and p[s][t] > q[t]]
            for part, found, last in (("pair", pair, len(pair)), ("term", term, top)):
                out += [(lang, s, part, i.decode(), -f, k) for k, (f, i) in enumerate(sorted(found)[:last], 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r.source, r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def made(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "aBcdé字" for b in ("", "x", "yz", "ß")]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "é", None, "s3"]),
             " ".join(rng.choices(vocabulary, k=rng.randrange(12)))) for _ in range(n)]
    return rows + rows[:5] + [("xx", "s1", None), ("xx", "s2", ""), ("yy", None, None)] + [("en", "s1", t) for t in TEXTS]


def frame(spark, rows):
    return spark.createDataFrame(
        [(k, *r, 1, "p", 2) for k, r in enumerate(rows)],
        "doc_id long, lang string, source string, text string, part int, term string, n int").repartition(4)


@pytest.mark.parametrize("limit, shard, tile, held", [
    (1 << 20, 1 << 14, 64, 1 << 20), (1 << 20, 7, 2, 100), (0, 7, 1, 1 << 20)])
def test_divergence_equals_a_plain_recount(spark, monkeypatch, limit, shard, tile, held):
    monkeypatch.setattr(divergence, "SHARD_TERMS", shard)
    monkeypatch.setattr(divergence, "HELD_BYTES", held)
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    monkeypatch.setattr(divergence.chunks, "SLICE_BYTES", 500)
    rows = made(shard)
    got = divergence.divergence(frame(spark, rows), min_docs=3, top=4, limit=limit, tile=tile)
    assert rows_of(got) == plain(rows, 3, 4)


def test_no_kept_terms_and_no_rows(spark):
    rows = [("en", "a", "x y"), ("en", "b", None), ("en", "c", "x")]
    assert rows_of(divergence.divergence(frame(spark, rows))) == plain(rows, 30, 50)
    empty = divergence.divergence(frame(spark, rows).where("false"))
    assert empty.count() == 0 and empty.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_query_equals_a_plain_recount(spark):
    from txnrisk.llm.tables import read

    rows = [(r.lang, r.source, r.text) for r in read(spark, SF, "documents").collect()]
    expected = plain(rows, 30, 50)
    assert rows_of(queries.op11_source_divergence(spark, SF)) == expected and any(r[2] == "term" for r in expected)


@given(st.sets(st.text(min_size=1, max_size=6), max_size=300))
@settings(max_examples=60, deadline=None)
def test_perfect_hash_gives_every_term_its_own_slot(terms):
    terms = sorted(terms)
    shard = divergence.Shard.of(terms)
    slots = shard.slots(pa.array(terms, pa.string()), divergence.hashes(terms))
    assert sorted(slots.tolist()) == list(range(len(terms)))
    others = [t + "~" for t in terms if t + "~" not in terms]
    assert (shard.slots(pa.array(others, pa.string()), divergence.hashes(others)) == -1).all()


def test_terms_of_equal_hashes(monkeypatch):
    monkeypatch.setattr(divergence, "hashes", lambda terms: np.array([len(t) for t in terms], np.uint64))
    terms = ["a", "b", "cc", "ddd", "eee", "ffff"]
    shard = divergence.Shard.of(terms)
    found = ["a", "b", "z", "cc", "yy", "ddd", "eee", "ffff"]
    slots = shard.slots(pa.array(found), divergence.hashes(found)).tolist()
    assert [s for f, s in zip(found, slots) if f not in terms] == [-1, -1]
    assert sorted(s for f, s in zip(found, slots) if f in terms) == list(range(6))


def test_shares_are_exact_for_large_counts():
    counts = np.array([0, 7, 10**13, 8 * 10**15], np.int64)
    assert divergence.shares(counts, 8 * 10**15 + 17, 10**6).tolist() == [
        1 + 10**9 * (c + 5) // (8 * 10**15 + 17 + 5 * 10**6) for c in counts.tolist()]


def test_first_pass_holds_little_and_gives_it_back(spark, monkeypatch):
    """What a worker keeps after a task adds to the next stage; with many distinct words it kept hundreds of MB."""

    class Caught:
        def __getattr__(self, name):
            return lambda *args: self if name != "mapInArrow" else caught.append(args[0]) or self

    class Pool:
        def release_unused(self):
            given_back.append(1)

    def split(texts, table):
        sizes.append(pa.compute.sum(pa.compute.binary_length(texts)).as_py())
        return plain_split(texts, table)

    rng, caught, given_back, sizes, plain_split = random.Random(1), [], [], [], words.split
    texts = [" ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(50_000)) for _ in range(18)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["en", "de", None] * 6), pa.array(["s"] * 18), pa.array(texts)], ["lang", "source", "text"])
    divergence.document_frequencies(Caught())
    monkeypatch.setattr(words, "split", split)
    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    got = Counter()
    for out in caught[0](iter([batch])):
        for lang, term, n in zip(*(out.column(c).to_pylist() for c in ("lang", "term", "n"))):
            got[lang, term] += n
    assert got == Counter((lang, w) for lang, text in zip(["en", "de", ""] * 6, texts) for w in set(text.split()))
    assert max(sizes) < 2 << 20 and given_back
