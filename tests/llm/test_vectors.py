"""Near-duplicate embeddings against all pairs in double precision."""

import numpy as np
import pytest

from txnrisk.llm import vectors


def all_pairs(rows, threshold):
    ok = {}
    for k, (_, v) in enumerate(rows):
        if v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            m = np.array(v, np.float64)
            ok[k] = m / np.linalg.norm(m)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in ok:
        for j in ok:
            if i < j and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(j)] = find(i)
    smallest = {}
    for k, (vec_id, _) in enumerate(rows):
        smallest[find(k)] = min(vec_id, smallest.get(find(k), vec_id))
    return sorted((r[0], links[k], smallest[find(k)], r[0] == smallest[find(k)]) for k, r in enumerate(rows))


def made(n=300, width=16):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(40, width))
    rows = [base[k % 40] + rng.normal(size=width) * (0.02 + 0.01 * (k % 20)) for k in range(n)]
    rows += [rows[0]] * 50 + [2 * rows[0]] * 5
    return [[float(np.float32(c)) for c in r] for r in rows]


@pytest.mark.parametrize("tile, pivots", [(None, 64), (7, 5), (64, 1)])
def test_equals_all_pairs(spark, tile, pivots, hot):
    rows = [(1000 - k, v) for k, v in enumerate(made())]
    rows += [(2001, None), (2002, []), (2003, [0.0] * 16), (2004, [None] + [1.0] * 15),
             (2005, [float("nan")] * 16), (2006, [float("inf")] + [1.0] * 15), (2007, [1.0, 2.0]), (2008, [2.0, 4.0]),
             (2009, [-0.0, 1.0]), (2010, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 node", "'x' v").repartition(5)
    got = vectors.near_vectors(frame, 0.95, pivots, tile).collect()
    assert sorted(tuple(r) for r in got) == all_pairs(rows, 0.95)
    assert max(r.n_links for r in got) > 50
    assert vectors.near_vectors(frame.where("vec_id < 0")).count() == 0


def test_bounds_hold_for_every_pair():
    rng = np.random.default_rng(1)
    x = vectors._unit(rng.normal(size=(200, 64)) * rng.lognormal(size=(200, 1)))
    q, s, length, error = vectors.quantise(x)
    got = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s
    assert (np.abs(got - x @ x.T) <= length[:, None] * error + error[:, None] + 1e-12).all()


def test_forest_connects():
    close = np.array([[1, 1, 0, 0], [0, 1, 1, 0], [0, 0, 0, 1]], bool)
    a, b = vectors.forest(close)
    assert len(a) == 5 and {tuple(x) for x in zip(a.tolist(), b.tolist())} <= set(zip(*map(np.ndarray.tolist, np.nonzero(close))))
