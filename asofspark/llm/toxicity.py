"""Toxicity: a convolutional text classifier trained in numpy on a bounded sample, applied to every whole text.

A word's vector is the sum of hashed embeddings of its prefixes and of itself. Filters of widths 1 to 3 slide over
the words; the maximum of each filter over the text goes to a logistic output. Training starts from smoothed
log-odds of the hashed features and then runs stochastic gradient descent (Adagrad), where the gradient reaches the
words at the maxima. A part of the sample is kept out of training to calibrate the score to a probability (Platt)
and to choose a rejection threshold for each language; a language with few such rows has the common threshold.

Defined results: null and empty texts have a score, that of a text without words; rows without doc_id can't be
labelled and so aren't learnt from; labels that disagree about one doc_id count as toxic; without labels of both
classes the score is the smoothed share of toxic labels; repeated rows have equal scores; a very long text is scored as a
whole, for which a worker holds some 30 bytes a character; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, kept_arrays, kept_schema, map_batches
from .textnet import FEATURES, chunks, word_features

BITS, DIM, FILTERS, WIDTHS = 16, 12, 6, (1, 2, 3)
#: Bound of the sample that a model is fitted on: so many rows of each class.
SAMPLE_PER_CLASS = 1500


@dataclass
class Model:
    table: np.ndarray
    kernels: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    offset: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)


def _pooled(model: Model, texts: list[str], want: bool = False) -> tuple:
    """Maxima of each filter for each text; if asked, also what the gradient needs."""
    ids, n_words = word_features(texts, BITS)
    pad = max(WIDTHS) - 1
    stop = np.cumsum(n_words + pad)
    at = np.arange(len(ids)) + pad * np.repeat(np.arange(len(texts)), n_words)
    x = np.zeros((int(stop[-1]) + pad, DIM), np.float32)
    own = model.table[ids[:, 0]]
    for k in range(1, FEATURES):
        own = own + model.table[ids[:, k]]
    x[at] = own
    begin, n = stop - n_words - pad, int(stop[-1])
    tops, where = [], []
    for width, kernel in zip(WIDTHS, model.kernels, strict=True):
        c = x[:n] @ kernel[0]
        for j in range(1, width):
            c += x[j : n + j] @ kernel[j]
        for j in range(1, width):  # windows that would reach into the next text
            c[stop - j] = -np.inf
        top = np.maximum.reduceat(c, begin, axis=0)
        tops.append(top)
        if want:
            text_of = np.repeat(np.arange(len(texts)), n_words + pad)
            rows, cols = np.nonzero(c == top[text_of])
            key, first = np.unique(text_of[rows] * c.shape[1] + cols, return_index=True)
            where.append(rows[first].reshape(len(texts), -1))
    top = np.maximum(np.concatenate(tops, 1) + model.bias, 0)
    return (top, x, where, at, ids) if want else top


def logits(model: Model, texts: list[str]) -> np.ndarray:
    return _pooled(model, texts) @ model.dense + model.offset


def _start(texts: list[str], y: np.ndarray, rng: np.random.Generator) -> Model:
    seen = np.zeros((2, 1 << BITS), np.float32)
    for t, label in zip(texts, y, strict=True):
        seen[int(label), np.unique(word_features([t], BITS)[0])] += 1
    n = np.maximum([(y == 0).sum(), (y == 1).sum()], 1)[:, None]
    p = (seen + 0.5) / (n + 1)
    odds = np.log(p[1] / p[0]) * (seen.sum(0) >= 4) * seen.sum(0) / (seen.sum(0) + 6)
    table = rng.normal(0, 0.02, (1 << BITS, DIM)).astype(np.float32)
    table[:, 0] += odds.astype(np.float32) / FEATURES
    kernels = [rng.normal(0, 0.3 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for k in kernels:
        k[0, 0, 0] = 1.0
    dense = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
    dense[::FILTERS] = 1.0 / len(WIDTHS)
    return Model(table, kernels, np.zeros(FILTERS * len(WIDTHS), np.float32), dense, -2.0)


def fit(texts: list[str], y: np.ndarray, langs: list[str | None] | None = None, epochs: int = 6, batch: int = 24, rate: float = 0.05, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    y = np.asarray(y, np.float32)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        model = _start(texts[:0], y[:0], rng)
        model.dense[:] = 0
        model.offset = float(np.log(share / (1 - share)))
        return model
    order = rng.permutation(len(y))
    apart = order[: len(y) // 5] if len(y) >= 50 else order
    learn = order[len(y) // 5 :] if len(y) >= 50 else order
    model = _start([texts[i] for i in learn], y[learn], rng)
    g_table = np.full(1 << BITS, 1e-3, np.float32)
    g_rest = [np.full_like(k, 1e-3) for k in model.kernels] + [np.full_like(model.bias, 1e-3), np.full_like(model.dense, 1e-3)]

    def step(value: np.ndarray, grad: np.ndarray, past: np.ndarray) -> None:
        past += grad * grad
        value -= rate * grad / np.sqrt(past)

    for _ in range(epochs):
        order = rng.permutation(learn)
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            part = [texts[i] for i in rows]
            top, x, where, at, ids = _pooled(model, part, want=True)
            error = (1 / (1 + np.exp(-(top @ model.dense + model.offset))) - y[rows]) / len(rows)
            back = np.outer(error, model.dense).astype(np.float32) * (top > 0)
            gx: dict[int, np.ndarray] = {}
            for k, (width, kernel) in enumerate(zip(WIDTHS, model.kernels, strict=True)):
                grad = np.zeros_like(kernel)
                for t, f in zip(*np.nonzero(back[:, k * FILTERS : (k + 1) * FILTERS]), strict=True):
                    i, g = where[k][t, f], back[t, k * FILTERS + f]
                    for j in range(width):
                        grad[j, :, f] += g * x[i + j]
                        gx[i + j] = gx.get(i + j, 0) + g * kernel[j, :, f]
                step(kernel, grad, g_rest[k])
            step(model.bias, back.sum(0), g_rest[-2])
            step(model.dense, error @ top, g_rest[-1])
            model.offset -= rate * float(error.sum())
            places = np.array([i for i in gx], np.int64)
            words = np.searchsorted(at, places)
            real = (words < len(at)) & (at[np.minimum(words, len(at) - 1)] == places) if len(at) else np.zeros(len(places), bool)
            if real.any():
                g = np.stack([gx[i] for i in places[real]])
                which, inverse = np.unique(ids[words[real]].ravel(), return_inverse=True)
                total = np.zeros((len(which), DIM), np.float32)
                np.add.at(total, inverse, np.repeat(g, FEATURES, 0))
                g_table[which] += (total * total).mean(1)
                model.table[which] -= rate * total / np.sqrt(g_table[which])[:, None]
    z = np.concatenate([logits(model, c) for c in chunks([texts[i] for i in apart])])
    _calibrate(model, z, y[apart], [langs[i] if langs else None for i in apart])
    return model


def _calibrate(model: Model, z: np.ndarray, y: np.ndarray, langs: list[str | None], least: int = 15) -> None:
    """Platt scaling by Newton steps on softened targets, then a threshold for each language by its best F1."""
    pos, neg = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, [((p - target) * z).sum() + 1e-3 * (a - 1), (p - target).sum() + 1e-3 * b])
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
    model.scale, model.shift = max(float(a), 0.05), float(b)
    p = 1 / (1 + np.exp(-np.clip(model.scale * z + model.shift, -30, 30)))
    for lang in {x for x in langs if x is not None}:
        own = np.array([x == lang for x in langs])
        if y[own].sum() >= least and (1 - y[own]).sum() >= least:
            f1 = [(2 * ((p[own] >= t) & (y[own] == 1)).sum() / max(1, (p[own] >= t).sum() + y[own].sum()), -abs(t - 0.5), t) for t in np.linspace(0.3, 0.7, 9).round(2)]
            model.thresholds[lang] = float(max(f1)[2])


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    z = np.concatenate([logits(model, c) for c in chunks(texts)]) if texts else np.empty(0)
    return 1 / (1 + np.exp(-np.clip(model.scale * z + model.shift, -30, 30)))


def fold(id_col: str) -> F.Column:
    """crc32 of the id as text, modulo 5."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", learn_from: F.Column | None = None, sample_per_class: int = SAMPLE_PER_CLASS, **options) -> Model:
    """Fit on at most ``sample_per_class`` labelled documents of each class, the least by a hash of the id."""
    named = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if learn_from is not None:
        named = named.where(learn_from)
    named = named.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    picked = [named.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_per_class) for v in (0, 1)]
    sample = picked[0].unionByName(picked[1])
    columns = ["doc_id", "text"] + (["lang"] if "lang" in docs.columns else [])
    # of several texts of one id the first by hash
    first = F.min(F.struct(F.xxhash64("text").alias("_t"), *[c for c in columns if c != "doc_id"])).alias("r")
    rows = docs.select(*columns).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(first).select("doc_id", "y", "r.*").collect()  # bounded by the sample
    rows.sort(key=lambda r: r["doc_id"])
    return fit([r["text"] or "" for r in rows], np.array([r["y"] for r in rows]), [r["lang"] for r in rows] if "lang" in columns else None, **options)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """All columns and a score from 0 to 1 (in place of a column of that name); only the text is looked at. Runs without a
    shuffle."""
    columns = [c for c in docs.columns if c != out_col]
    rows = beside(docs, columns, text=F.col(f"`{text_col}`"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = scores(model, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*kept_arrays(b), pa.array(p, pa.float64())], [*columns, out_col])

    return map_batches(rows, run, kept_schema(rows, columns).add(out_col, "double"))


def reject(scored: DataFrame, model: Model, lang_col: str | None = "lang", score_col: str = "score", default: float = 0.5) -> DataFrame:
    """Adds ``rejected``: the score reaches the threshold of the row's language."""
    limit = F.lit(default)
    if lang_col and model.thresholds:
        for lang, t in sorted(model.thresholds.items()):
            limit = F.when(F.col(lang_col) == lang, F.lit(t)).otherwise(limit)
    return scored.withColumn("rejected", F.col(score_col) >= limit)
