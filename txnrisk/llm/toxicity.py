"""Operator 5: toxicity by averaged subword embeddings and a linear softmax.

A word is the bag of its character n-grams (with marks at both ends) and of the
whole word; each hashes to a row of an embedding table. A word's vector is the mean
of its rows, a window of words has the mean of its words, and a linear softmax reads
the class from it. Table and softmax are trained jointly by Adam in numpy, on the
driver, from a bounded sample of labelled rows: first all windows carry the label of
their text, then only the windows that score highest in their text, because a toxic
text is mostly made of harmless words. A misspelt word shares most n-grams with the
word it comes from. The score of a text is a logistic function, fitted to the same
labels, of the mean over its highest windows.

For scoring, table and softmax fold into one number per row, a word's number is the
mean over its rows, and a worker keeps the numbers of the words it has seen. All
windows of the whole text are scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.llm import chunks
from txnrisk.llm.tables import fold, sample, text_rows

WORD = re.compile(r"\w+(?:['@*$!.]\w+)*")
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """Shape and training.

    ``sample`` bounds the labelled rows that training reads, ``sample_chars`` the
    characters of one of them. A text's score looks at one window and one more per
    ``per`` windows.
    """

    bits: int = 18
    dim: int = 8
    shortest: int = 3
    longest: int = 6
    window: int = 8
    per: int = 8
    passes: int = 2
    top_passes: int = 3
    batch: int = 256
    rate: float = 0.015
    decay: float = 1e-5
    scale: float = 10.0
    min_share: float = 0.0075
    sample: int = 4000
    sample_chars: int = 50_000
    seed: int = 5


def words(text: str) -> list[str]:
    """Runs of letters, digits and underscores, joined over single marks inside a word, in lower case."""
    return WORD.findall(text.lower())


def subwords(found: Sequence[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all words behind each other, and how many each word has."""
    marked = [f"<{w}>" for w in found]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(marked)), size)
    at, rows, of = np.arange(len(points)), [], []
    end = np.repeat(np.cumsum(size), size)
    total = np.zeros(len(points), np.uint64)
    for n in range(1, s.longest + 1):
        total = total[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :]
        if n >= s.shortest:
            inside = at[: len(total)] + n <= end[: len(total)]
            rows.append(total[inside] + np.uint64(n))
            of.append(word[: len(total)][inside])
    # the whole word: one more row, whatever its length
    power = np.uint64(0x100000001B3) ** (at - np.repeat(np.cumsum(size) - size, size)).astype(np.uint64)
    if len(points):
        rows.append(np.add.reduceat(points * power, np.cumsum(size) - size))
        of.append(np.arange(len(marked)))
    rows, of = np.concatenate(rows), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    mixed = (rows ^ rows >> np.uint64(29)) * _MIX >> np.uint64(64 - s.bits)
    return mixed[order].astype(np.int64), np.bincount(of, minlength=len(marked))


@dataclass
class Model:
    """``rows``: the logit of each table row; ``slope`` and ``shift`` turn a text's number into its score."""

    rows: np.ndarray
    slope: float
    shift: float
    settings: Settings


def highest(numbers: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """The windows of the highest means, and the mean over them; ``numbers`` has one per word."""
    starts = np.arange(0, len(numbers), s.window)
    sizes = np.diff(starts, append=len(numbers))
    means = np.add.reduceat(numbers, starts) / min(s.window, len(numbers))
    best = np.argsort(-means, kind="stable")[: 1 + len(sizes) // s.per]
    return starts[best], float(means[best].mean())


def fit(texts: Sequence[str], labels: Sequence[int], s: Settings) -> Model:
    """Train the embedding table and the softmax together by cross entropy."""
    rng = np.random.default_rng(s.seed)
    slot: dict[str, int] = {}
    docs = [np.array([slot.setdefault(w, len(slot)) for w in words(t)], np.int32) for t in texts]
    kept = [k for k, d in enumerate(docs) if len(d)]
    docs, y = [docs[k] for k in kept], np.array([labels[k] for k in kept], np.int64)
    if len(np.unique(y)) < 2:  # nothing to tell apart: the share of the label
        share = np.clip(float(y.mean()) if len(y) else 0.0, 1e-3, 1 - 1e-3)
        return Model(np.zeros(1 << s.bits, np.float32), 1.0, float(np.log(share / (1 - share))), s)
    vocabulary = list(slot)
    pieces = [subwords(vocabulary[at : at + (1 << 14)], s) for at in range(0, len(vocabulary), 1 << 14)]
    rows = np.concatenate([r.astype(np.int32) for r, _ in pieces])
    n = np.concatenate([c for _, c in pieces])
    start = np.cumsum(n) - n
    # rows that few texts have would only learn these texts by heart
    seen = np.zeros(1 << s.bits, np.int64)
    for d in docs:
        own = np.unique(d)
        seen[np.unique(chunks.gather(rows, start[own], n[own]))] += 1
    frequent = seen >= max(2, int(s.min_share * len(docs)))
    keep = frequent[rows]
    word = np.repeat(np.arange(len(n), dtype=np.int32), n)[keep]
    compact = (np.cumsum(frequent) - 1).astype(np.int32)[rows[keep]]
    n_kept = np.bincount(word, minlength=len(n))
    start_kept = np.cumsum(n_kept) - n_kept

    table = rng.normal(0, 0.02, (int(frequent.sum()), s.dim)).astype(np.float32)
    out = rng.normal(0, 0.5, (s.dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    params = [table, out, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0

    def train(windows: list[tuple[int, int]], rate: float) -> None:
        nonlocal step
        order = rng.permutation(len(windows))
        for b in range(0, len(order), s.batch):
            picked = [windows[k] for k in order[b : b + s.batch]]
            parts = [docs[d][at : at + s.window] for d, at in picked]
            size = np.array([len(x) for x in parts])
            own, window = np.concatenate(parts), np.repeat(np.arange(len(parts)), size)
            count = n_kept[own]
            row = chunks.gather(compact, start_kept[own], count)
            weight = np.repeat(s.scale / n[own] / size[window], count).astype(np.float32)
            at = np.repeat(window, count)
            vectors = np.zeros((len(parts), s.dim), np.float32)
            np.add.at(vectors, at, table[row] * weight[:, None])
            logit = vectors @ out + bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(parts)), y[[d for d, _ in picked]]] -= 1
            p /= len(parts)
            g_table = s.decay * table
            np.add.at(g_table, row, weight[:, None] * (p @ out.T)[at])
            step += 1
            size_of_step = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for m, v, q, g in zip(first, second, params, (g_table, vectors.T @ p, p.sum(axis=0))):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                q -= size_of_step * m / (np.sqrt(v) + 1e-6)

    def numbers() -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum((table @ (out[:, 1] - out[:, 0]))[compact], dtype=np.float64)])
        return s.scale * (sums[start_kept + n_kept] - sums[start_kept]) / n

    every = [(d, at) for d, own in enumerate(docs) for at in range(0, len(own), s.window)]
    for _ in range(s.passes):
        train(every, s.rate)
    for _ in range(s.top_passes):
        of_word = numbers()
        train([(d, int(at)) for d, own in enumerate(docs) for at in highest(of_word[own], s)[0]], s.rate / 2)
    of_word = numbers()
    x = np.array([highest(of_word[own], s)[1] for own in docs])
    slope, shift = logistic(x, y)
    logits = np.zeros(1 << s.bits, np.float32)
    logits[frequent] = s.scale * (table @ (out[:, 1] - out[:, 0]))
    return Model(logits, slope, shift, s)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic regression on one number, with a small ridge, by Newton steps."""
    middle, spread = float(x.mean()), float(x.std()) or 1.0
    z = np.stack([(x - middle) / spread, np.ones(len(x))], axis=1)
    ridge = 1e-2 * np.eye(2)
    w = np.array([0.0, np.log(y.mean() / (1 - y.mean()))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        w = w - step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
    return float(w[0] / spread), float(w[1] - w[0] * middle / spread)


class Scorer:
    """Scores texts with a model; remembers the numbers of words seen."""

    def __init__(self, model: Model, limit: int = 1_000_000):
        self.model, self.limit = model, limit
        self.known: dict[str, float] = {}

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        if len(self.known) > self.limit:
            self.known.clear()
        known, model = self.known, self.model
        found = [words(t) for t in texts]
        new = list({w for ws in found for w in ws} - known.keys())
        for at in range(0, len(new), 1 << 15):
            part = new[at : at + (1 << 15)]
            rows, n = subwords(part, model.settings)
            sums = np.add.reduceat(model.rows[rows].astype(np.float64), np.cumsum(n) - n)
            known.update(zip(part, (sums / n).tolist()))
        x = np.array([
            highest(np.fromiter(map(known.__getitem__, ws), np.float64, len(ws)), model.settings)[1] if ws else 0.0
            for ws in found
        ])
        return 1 / (1 + np.exp(-np.clip(model.slope * x + model.shift, -500, 500)))


def train_on(docs: DataFrame, labels: DataFrame, s: Settings) -> Model:
    """Fit on a bounded sample of labelled rows that may be learned from, the smallest hashes of ids.

    Rows with a null text or label or a text beyond ``sample_chars`` are not sampled;
    of equal texts one row is kept.
    """
    labelled = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.where(F.col("text").isNotNull() & (fold() != 1) & (F.length("text") <= s.sample_chars))
    rows = rows.select("doc_id", "text").join(sample(labelled.where(fold() != 1), s.sample, labelled.count()), "doc_id")
    rows = rows.select("text", "toxic").collect()
    of = dict(sorted((r["text"], int(r["toxic"])) for r in rows))  # in the same order each time
    return fit(list(of), list(of.values()), s)


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= ``threshold``) of every row of ``docs``.

    ``labels`` has doc_id and toxic (0 or 1). A null text counts as empty; a text
    without words gets the score of a text of neutral words. Without labels of both
    kinds every score is the share of the label. Repeated rows come back as often.
    """
    model = train_on(docs, labels, settings or Settings())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for begin, part in chunks.slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(begin, len(part)), pa.array(scorer(part.to_pylist()))],
                    ["doc_id", "score"],
                )

    scored = text_rows(docs).mapInArrow(score, "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
