"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text's vector is the mean of the embeddings of its hashed byte n-grams of 1 to 4; a linear softmax gives the
languages. Embeddings and output layer learn together by stochastic gradient descent on a bounded sample. A part kept
out of training sets the temperature of the probabilities and the rejection bound: the least bound at which the
texts above it are right to ``precision``.

For a prediction the embeddings are multiplied out: each n-gram adds its share to every language.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties go to the language first by
name; without any labelled text all are ``und``; rows of null id aren't learnt from; repeated rows get equal results; a
very long text is counted as a whole into one vector; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, kept_arrays, kept_schema, map_batches, stash
from .textnet import chunks, gram_features

BITS, DIM, ORDERS = 13, 16, (1, 2, 3, 4)
#: Bounds of the sample that a model is fitted on: so many texts of each language, and so many in all (many languages share
#: them evenly, with at least five each).
SAMPLE_PER_LANG, SAMPLE_ROWS = 400, 40_000


@dataclass
class Model:
    langs: list[str]
    shares: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    bound: float = 0.0


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """texts x buckets: how often each bucket comes; and the number of n-grams of each text."""
    out, n = np.zeros(len(texts) << BITS, np.float32), np.zeros(len(texts))
    for ids, begin in gram_features(texts, BITS, ORDERS):
        size = np.diff(np.concatenate([begin, [len(ids)]]))
        out += np.bincount((np.repeat(np.arange(len(texts)), size) << BITS) + ids, minlength=len(out))
        n += size
    return out.reshape(len(texts), 1 << BITS), n


def averages(vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sparse vectors (buckets, shares) as rows."""
    out = np.zeros((len(vectors), 1 << BITS), np.float32)
    for row, (ids, shares) in zip(out, vectors, strict=True):
        row[ids] = shares
    return out


def sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams and their shares."""
    row, n = counts([text])
    ids = np.flatnonzero(row[0]).astype(np.int32)
    return ids, (row[0][ids] / n[0]).astype(np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(vectors: list[tuple[np.ndarray, np.ndarray]], langs: list[str], epochs: int = 40, batch: int = 32, rate: float = 0.5, precision: float = 0.99, seed: int = 5) -> Model:
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    if not names:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0, np.float32))
    y = np.array([names.index(x) for x in langs])
    order = rng.permutation(len(y))
    apart, learn = (order[: len(y) // 5], order[len(y) // 5 :]) if len(y) >= 50 else (order, order)
    weight = 1 / np.maximum(np.bincount(y[learn], minlength=len(names)), 1)
    weight *= len(learn) / len(names)
    emb = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 0.3, (DIM, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    past_e, past_o, past_b = np.full(emb.shape[0], 1e-6, np.float32), np.full_like(out, 1e-6), np.full_like(bias, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(learn)
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            x = averages([vectors[i] for i in rows])
            v = x @ emb
            g = _softmax(v @ out + bias)
            g[np.arange(len(rows)), y[rows]] -= 1
            g *= (weight[y[rows]] / len(rows))[:, None]
            grad_o, grad_e = v.T @ g, x.T @ (g @ out.T)
            past_o += grad_o**2
            past_b += g.sum(0) ** 2
            past_e += (grad_e**2).mean(1)
            out -= rate * 0.1 * grad_o / np.sqrt(past_o)
            bias -= rate * 0.1 * g.sum(0) / np.sqrt(past_b)
            emb -= rate * grad_e / np.sqrt(past_e)[:, None]
    shares = emb @ out
    z = np.concatenate([averages([vectors[i] for i in apart[k : k + 256]]) @ shares for k in range(0, len(apart), 256)]) + bias
    loss = lambda t: -np.log(_softmax(z * t)[np.arange(len(apart)), y[apart]] + 1e-9).mean()
    model = Model(names, shares.astype(np.float32), bias, float(min((0.25, 0.5, 1.0, 1.5, 2.0, 3.0, 5.0), key=loss)))
    p = _softmax(z * model.temperature)
    right, top = p.argmax(1) == y[apart], p.max(1)
    for t in np.unique(np.concatenate([[0.0], np.sort(top)[:: max(1, len(top) // 100)]])):
        if right[top >= t].mean() >= precision:
            model.bound = float(t)
            break
    return model


def probabilities(model: Model, texts: list[str | None]) -> np.ndarray:
    out = [np.empty((0, len(model.langs)))]
    for part in chunks(texts, 200_000):
        for k in range(0, len(part), 64):
            x, n = counts(part[k : k + 64])
            out.append(_softmax((x @ model.shares / n[:, None] + model.bias) * model.temperature))
    return np.concatenate(out)


def train(docs: DataFrame, learn_from: F.Column | None = None, sample_per_lang: int = SAMPLE_PER_LANG, sample_rows: int = SAMPLE_ROWS, **options) -> Model:
    """Fit on at most ``sample_per_lang`` texts of each language and about ``sample_rows`` in all, the first by a hash of the id.

    The sample's vectors are made by Spark; the driver gets them sparse, at most 8192 numbers a text however long it is."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    if learn_from is not None:
        rows = rows.where(learn_from)
    keys = rows.select("lang", "doc_id", F.xxhash64("doc_id").alias("_r"), F.xxhash64("text").alias("_t"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("_r", "doc_id", "_t"))
    first = stash(keys.withColumn("_n", nth).where(F.col("_n") <= sample_per_lang), "language-sample")
    langs = first.where("_n = 1").count()
    first = first.where(F.col("_n") <= max(5, sample_rows // max(1, langs))).drop("_r", "_n").distinct()
    picked = rows.select("doc_id", "lang", "text", F.xxhash64("text").alias("_t")).join(first, ["doc_id", "lang", "_t"]).dropDuplicates(["doc_id", "lang", "_t"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sparse(t) for t in b.column("text").to_pylist()]
            columns = [b.column("doc_id"), b.column("_t"), b.column("lang"), pa.array([x for x, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_t", "lang", "ids", "shares"])

    sample = map_batches(picked.select(F.col("doc_id").cast("string").alias("doc_id"), "_t", "lang", "text"), vectors, "doc_id string, _t long, lang string, ids array<int>, shares array<float>")
    got = sample.toArrow().combine_chunks()  # bounded by the sample
    keys = list(zip(*[got.column(c).to_pylist() for c in ("doc_id", "lang", "_t")], strict=True))
    order = sorted(range(len(keys)), key=keys.__getitem__)
    ids, shares = (x for c in ("ids", "shares") for x in [[y.values.to_numpy() for y in got.column(c)]])
    return fit([(ids[i], shares[i]) for i in order], [keys[i][1] for i in order], **options)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns, lang_pred, score and rejected (in place of columns of these names). Only the text is looked at; runs
    without a shuffle."""
    columns = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    text = F.col(f"`{text_col}`")
    rows = beside(docs, columns, text=text, letters=F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.array(b.column("letters").to_pylist(), bool) & bool(model.langs)
            p = probabilities(model, b.column("text").to_pylist()) if model.langs else np.zeros((b.num_rows, 1))
            top = np.where(ok, p.max(1), 0.0)
            names = [model.langs[k] if o else "und" for k, o in zip(p.argmax(1), ok, strict=True)]
            yield pa.RecordBatch.from_arrays([*kept_arrays(b), pa.array(names, pa.string()), pa.array(top, pa.float64()), pa.array(~ok | (top < model.bound))], [*columns, "lang_pred", "score", "rejected"])

    return map_batches(rows, run, kept_schema(rows, columns).add("lang_pred", "string").add("score", "double").add("rejected", "boolean"))
