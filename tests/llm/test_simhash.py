"""Fingerprints, Golay keys, links and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from txnrisk.llm import golay, simhash
from txnrisk.llm.components import components


def plain_fingerprint(text, width=4):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, max_bits):
    """values: {id: fingerprint}; the smallest id reachable of each."""
    root = {i: i for i in values}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(values)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if bin(values[i] ^ values[j]).count("1") <= max_bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints_equal_the_definition():
    rng = random.Random(3)
    words = ["A", "bé", "Zß", "c,", "İ", "\x1c", "the"]
    texts = ["", " \t\n", "One", "one two THREE", "É é"] + [
        rng.choice([" ", "\n", " \x0b"]).join(rng.choices(words, k=rng.randrange(40))) for _ in range(200)
    ] + ["long text " * 70_000]
    assert simhash.simhashes(texts[:-1], 4).tolist() == [plain_fingerprint(t) for t in texts[:-1]]
    assert int(simhash.simhashes(texts, 4)[-1]) == plain_fingerprint(texts[-1])


def test_words_within_two_bits_share_a_codeword():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 300)
    for flips in [(), (3,), (0, 22), (7, 8)]:
        other = words ^ sum(1 << b for b in flips)
        for x, y in zip(words, other):
            a, b = (set(golay.codewords(np.array([v]))[0].tolist()) for v in (x, y))
            assert a & b and len(a) in (1, 6)


def test_fingerprints_within_four_bits_share_a_key():
    rng = np.random.default_rng(2)
    for _ in range(2000):
        fp = rng.integers(0, 1 << 64, dtype=np.uint64)
        flips = rng.choice(64, rng.integers(0, 5), replace=False)
        other = fp ^ np.uint64(sum(1 << int(b) for b in flips))
        keys, row = golay.keys(np.array([fp, other], np.uint64))
        assert set(keys[row == 0].tolist()) & set(keys[row == 1].tolist())


@pytest.mark.parametrize("limit", [4096, 12])
def test_links_connect_as_all_pairs_do(spark, limit):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 64, 60, dtype=np.uint64)
    made = set(base.tolist())
    for v in base[:20].tolist():  # chains of changes, and one dense group
        for _ in range(8):
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                v ^= 1 << int(b)
            made.add(v)
    dense = [int(base[30]) ^ (1 << i) ^ (1 << j) for i in range(10) for j in range(i)]
    made |= set(dense)
    values = {i * 3: v for i, v in enumerate(sorted(made))}
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in values.items()]
    nodes = spark.createDataFrame(rows, "node long, fp long").repartition(5)
    found = {r.node: r.root for r in components(simhash.links(nodes, limit=limit)).collect()}
    want = plain_components(values, 4)
    assert {i: found.get(i, i) for i in values} == want
    assert len(set(want.values())) < len(want)


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(100, 160)]
    pairs += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(5, 5), (None, 3)]
    frame = spark.createDataFrame(pairs, "a long, b long")
    found = {r.node: r.root for r in components(frame).collect()}
    root = {n: n for p in pairs if None not in p for n in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a is not None and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    alone = {5} - {n for a, b in pairs if a != b and None not in (a, b) for n in (a, b)}
    assert found == {n: r for n, r in root.items() if n not in alone}
    assert components(frame.where("a > 5000")).count() == 0


def test_components_with_split_hubs(spark, hot):
    frame = spark.createDataFrame([(0, i) for i in range(1, 80)] + [(79, 100)], "a long, b long")
    assert {r.root for r in components(frame).collect()} == {0}


def test_near_duplicates(spark, odd_docs, no_docs, hot):
    got = simhash.near_duplicates(odd_docs).collect()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = plain_components(prints, 4)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {
        (i, f"{prints[i]:016x}", want[i]) for i in texts
    }
    assert simhash.near_duplicates(no_docs).count() == 0
    again = odd_docs.unionByName(odd_docs.where("doc_id = 8").selectExpr(
        "cast(null as long) doc_id", "text", "lang", "source", "n_chars", "_rank", "length"))
    rows = [r for r in simhash.near_duplicates(again).collect() if r.doc_id in (8, None)]
    assert [r.component_id for r in rows] == [8, 8]


def test_given_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    want = plain_components(prints, 4)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got == want and len(set(want.values())) < len(want)
