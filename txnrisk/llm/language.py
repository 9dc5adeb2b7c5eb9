"""Operator 8: language of a text by a byte convolutional network.

A window is ``WINDOW`` bytes of UTF-8, the last one filled up with zeros. Every byte
has a vector; filters of several widths slide over the window, each keeps its
highest response, and a linear softmax reads the language from these. The network
is trained by Adam in numpy, on the driver, from windows of a bounded sample of
labelled texts. A text is all its windows: their log probabilities are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.llm import chunks
from txnrisk.llm.tables import fold, sample, text_rows

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """Shape and training; ``sample`` bounds the texts and ``sample_windows`` the windows of each."""

    window: int = 256
    dim: int = 8
    widths: tuple[int, ...] = (2, 3, 4, 5)
    filters: int = 8
    epochs: int = 6
    batch: int = 64
    rate: float = 0.01
    sample: int = 3000
    sample_windows: int = 3
    seed: int = 8


@dataclass
class Model:
    """``bytes``: vector of each byte; ``filters``: (longest width x dim, all filters); ``out``: softmax."""

    languages: list[str]
    bytes: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    settings: Settings


def windows(text: str, size: int) -> np.ndarray:
    """All windows of a text, one row each; none for an empty text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    full = np.zeros(-(-len(raw) // size) * size, np.uint8)
    full[: len(raw)] = raw
    return full.reshape(-1, size)


def _responses(model: Model, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of neighbouring byte vectors (window, position, width x dim) and all filter responses."""
    longest = max(model.settings.widths)
    padded = np.concatenate([batch, np.zeros((len(batch), longest - 1), np.uint8)], axis=1)
    vectors = model.bytes[padded]
    near = np.lib.stride_tricks.sliding_window_view(vectors, longest, axis=1)  # (n, position, dim, width)
    near = np.ascontiguousarray(near.transpose(0, 1, 3, 2)).reshape(len(batch), batch.shape[1], -1)
    return near, near @ model.filters


def log_probabilities(model: Model, batch: np.ndarray) -> np.ndarray:
    """Log probability of each language for each window."""
    out = np.empty((len(batch), len(model.languages)), np.float64)
    for at in range(0, len(batch), 128):
        _, response = _responses(model, batch[at : at + 128])
        pooled = np.maximum(response.max(axis=1) + model.bias, 0)
        logit = (pooled @ model.out + model.out_bias).astype(np.float64)
        top = logit.max(axis=1, keepdims=True)
        out[at : at + 128] = logit - top - np.log(np.exp(logit - top).sum(axis=1, keepdims=True))
    return out


def fit(texts: Sequence[str], langs: Sequence[str], s: Settings) -> Model:
    """Train on up to ``sample_windows`` evenly spaced windows of each text."""
    rng = np.random.default_rng(s.seed)
    languages = sorted(set(langs))
    longest, n = max(s.widths), s.filters * len(s.widths)
    mask = np.zeros((longest, s.dim, n), np.float32)  # narrower filters see their first bytes only
    for k, w in enumerate(s.widths):
        mask[:w, :, k * s.filters : (k + 1) * s.filters] = 1
    mask = mask.reshape(-1, n)
    model = Model(
        languages, rng.normal(0, 0.5, (256, s.dim)).astype(np.float32),
        (rng.normal(0, 0.3, (longest * s.dim, n)) * mask).astype(np.float32), np.zeros(n, np.float32),
        rng.normal(0, 0.3, (n, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32), s,
    )
    x, y = [], []
    for text, lang in zip(texts, langs):
        own = windows(text, s.window)
        pick = np.unique(np.linspace(0, len(own) - 1, s.sample_windows).astype(int)) if len(own) else []
        for k in pick:
            x.append(own[k])
            y.append(languages.index(lang))
            if rng.random() < 0.3:  # short texts are mostly filling
                short = own[k].copy()
                short[rng.integers(4, max(5, s.window // 2)) :] = 0
                x.append(short)
                y.append(languages.index(lang))
    if len(languages) < 2:
        return model
    x, y = np.stack(x), np.array(y)
    params = [model.bytes, model.filters, model.bias, model.out, model.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, steps = 0, s.epochs * -(-len(x) // s.batch)
    for _ in range(s.epochs):
        order = rng.permutation(len(x))
        for b in range(0, len(x), s.batch):
            pick = order[b : b + s.batch]
            near, response = _responses(model, x[pick])
            at = response.argmax(axis=1)  # (n, filters)
            pooled = np.take_along_axis(response, at[:, None], axis=1)[:, 0] + model.bias
            live = np.maximum(pooled, 0)
            logit = live @ model.out + model.out_bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            p /= len(pick)
            g_pooled = (p @ model.out.T) * (pooled > 0)
            taken = np.take_along_axis(near, at[:, :, None], axis=1)  # (n, filters, width x dim)
            g_filters = np.einsum("nf,nfd->df", g_pooled, taken) * mask
            g_near = (g_pooled[:, :, None] * model.filters.T).reshape(len(pick), n, longest, s.dim)
            g_bytes = np.zeros_like(model.bytes)
            padded = np.concatenate([x[pick], np.zeros((len(pick), longest - 1), np.uint8)], axis=1)
            seen = np.take_along_axis(padded[:, None], at[:, :, None] + np.arange(longest), axis=2)
            np.add.at(g_bytes, seen.reshape(-1), g_near.reshape(-1, s.dim))
            step += 1
            rate = s.rate * (1 - step / (steps + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for m, v, q, g in zip(first, second, params, (g_bytes, g_filters, g_pooled.sum(axis=0), live.T @ p, p.sum(axis=0))):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                q -= rate * m / (np.sqrt(v) + 1e-7)
    return model


def predict(model: Model, texts: Sequence[str]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; an empty text is unknown with score 0."""
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    held: list[np.ndarray] = []
    owner: list[int] = []
    sums = np.zeros((len(texts), max(1, len(model.languages))))
    count = np.zeros(len(texts))

    def flush() -> None:
        if held and model.languages:
            logs = log_probabilities(model, np.concatenate(held))
            np.add.at(sums, np.repeat(owner, [len(h) for h in held]), logs)
        held.clear()
        owner.clear()

    size = 0
    for k, text in enumerate(texts):
        own = windows(text, model.settings.window)
        count[k] = len(own)
        for at in range(0, len(own), 4096):
            held.append(own[at : at + 4096])
            owner.append(k)
            size += len(held[-1])
            if size >= 4096:
                flush()
                size = 0
    flush()
    for k in np.flatnonzero(count) if model.languages else []:
        mean = sums[k] / count[k]
        p = np.exp(mean - mean.max())
        best = int(p.argmax())
        names[k], scores[k] = model.languages[best], p[best] / p.sum()
    return names, scores


def train_on(docs: DataFrame, s: Settings) -> Model:
    """Fit on a bounded sample of rows that may be learned from, the smallest hashes of ids."""
    labelled = docs.where(F.col("lang").isNotNull() & (fold() != 1))
    rows = labelled.where(F.col("text").rlike(r"\p{L}")).select(
        "doc_id", F.substring("text", 1, 16 * s.window).alias("text"), "lang")
    rows = sample(rows, s.sample, labelled.count()).select("text", "lang").collect()
    return fit([r["text"] for r in rows], [r["lang"] for r in rows], s)


def languages(docs: DataFrame, settings: Settings | None = None, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row.

    A text that is null or has no letter is ``und`` with score 0; so is every text if
    no labelled row may be learned from. With one label, all others get that label.
    Repeated rows come back as often. ``model`` skips the training.
    """
    model = model or train_on(docs, settings or Settings())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, part in chunks.slices(batch.column("text")):
                names, scores = predict(model, part.to_pylist())
                own = [batch.column(c).slice(begin, len(part)) for c in ("doc_id", "letters")]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "letters", "lang_pred", "score"])

    rows = text_rows(docs).withColumn("letters", F.col("text").rlike(r"\p{L}"))
    found = rows.mapInArrow(run, "doc_id long, letters boolean, lang_pred string, score double")
    return found.select(
        "doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"),
        F.when(F.col("letters"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"),
    )
