"""Toxicity: subword-bag embeddings, averaged over a text, under a linear softmax; all of it trained jointly in numpy.

A word is the mean of the vectors of its character n-grams and of the word itself, hashed into buckets, so a misspelling
shares most of its n-grams with the word it stands for. A text is the mean of its words. The softmax is linear, so after
training a bucket's vector is folded into one number, the difference of the classes, and a text is scored in one pass over
its words. Texts of all lengths are learned and scored alike, as the mean of all their words.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritally.llm import common
from veritally.llm.words import WordStore, by_text

BUCKETS, DIM = 1 << 16, 8
WORD = re.compile(r"\w+")
GAIN = 100.0  #: by which means are multiplied before the softmax; it sets the pace of training, not what can be learned
CALM = 10  #: words without any meaning that each text is taken to have besides its own, so that one odd word doesn't settle a short text


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def buckets_of(word: str) -> list[int]:
    """Buckets of the whole word and of its n-grams of 3 to 5 letters, with marks at its ends."""
    s = f"<{word}>"
    grams = {s}
    for n in (3, 4, 5):
        grams.update(s[i : i + n] for i in range(len(s) - n + 1))
    return [zlib.crc32(g.encode()) & BUCKETS - 1 for g in sorted(grams)]


@dataclass(eq=False)  # a model is itself; its arrays have no one truth
class Model:
    weight: np.ndarray  # bucket: its vector times the softmax's rows, class 1 less class 0
    bias: float


def bags(words: list[list[str]], times: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text, the buckets of its words' n-grams and their shares in the mean of its words."""
    known: dict[str, np.ndarray] = {}
    out = []
    for own, n in zip(words, times, strict=True):
        found = [known[w] if w in known else known.setdefault(w, np.array(buckets_of(w), np.uint16)) for w in own]
        sizes = np.array([len(x) for x in found], np.int64)
        share = np.repeat(n / (CALM + n.sum()) / sizes, sizes) if len(own) else np.zeros(0)
        whole = np.bincount(np.concatenate(found) if len(own) else np.zeros(0, np.int64), share, BUCKETS).astype(np.float32)
        at = np.flatnonzero(whole)
        out.append((at.astype(np.uint16), whole[at]))
    return out


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, rate: float = 0.1, batch: int = 64, decay: float = 1e-4, weight: float = 4.0, seed: int = 11) -> Model:
    """Adagrad on mini-batches; vectors, softmax and bias are trained together. A toxic text weighs ``weight`` times a clean one."""
    rng = np.random.default_rng(seed)
    g = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
    w = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    rate1 = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    b = np.array([0, math.log(rate1 / (1 - rate1))])
    seen_g, seen_w, seen_b = np.full_like(g, 1e-6), np.full_like(w, 1e-2), np.ones(2)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            own, inverse = np.unique(np.concatenate([texts[i][0] for i in part]), return_inverse=True)
            x = np.zeros((len(part), len(own)), np.float32)
            x[np.repeat(np.arange(len(part)), [len(texts[i][0]) for i in part]), inverse] = np.concatenate([texts[i][1] for i in part]) * GAIN
            mean = x @ g[own]
            z = mean @ w + b
            d = np.exp(z - z.max(axis=1, keepdims=True))
            d /= d.sum(axis=1, keepdims=True)
            y = labels[part]
            d[np.arange(len(part)), y] -= 1
            d *= np.where(y == 1, weight, 1.0)[:, None] / len(part)
            dg = x.T @ (d @ w.T).astype(np.float32) + decay * g[own]
            seen_g[own] += dg * dg
            g[own] -= rate * dg / np.sqrt(seen_g[own])
            dw, db = mean.T @ d, d.sum(axis=0)
            seen_w += dw * dw
            w -= rate * dw / np.sqrt(seen_w)
            seen_b += db * db
            b -= rate * db / np.sqrt(seen_b)
    return Model(GAIN * (g @ (w[:, 1] - w[:, 0])).astype(np.float64), float(b[1] - b[0]))


def _constant(rate: float) -> Model:
    rate = float(np.clip(rate, 1e-3, 1 - 1e-3))
    return Model(np.zeros(BUCKETS), math.log(rate / (1 - rate)))


def learn(table: pa.Table) -> Model:
    """The model of rows (words, times, target), the same for any order of them."""
    y = np.array([int(x > 0) for x in table.column("target").to_pylist()], np.int64)
    words, times = table.column("words").to_pylist(), [np.array(x, np.float64) for x in table.column("times").to_pylist()]
    if len(set(y.tolist())) < 2 or not any(words):
        return _constant(y.mean())
    texts = bags(words, times)
    marks = [zlib.crc32(a.tobytes() + b.tobytes()) for a, b in texts]
    order = np.lexsort((y, [len(a) for a, _ in texts], marks))
    return train([texts[i] for i in order.tolist()], y[order])


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", held: int = 0, folds: int = 5, bound: int = 8000) -> Model:
    """Learn from the whole texts of at most ``bound`` labelled rows outside the fold ``held``; a task trains, not the driver."""
    sample = common.labelled(docs.select("doc_id", "text").where("text is not null"), labels, target, folds, held, bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 64):
            found = [Counter(words_of(t)) for t in batch.column("text").to_pylist()]
            words = [sorted(c) for c in found]
            times = [[c[w] for w in own] for c, own in zip(found, words, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32())), batch.column("target").cast(pa.int64()), batch.column("order"), batch.column("tie")], names=["words", "times", "target", "order", "tie"])

    rows = sample.select("text", "target", "order", F.xxhash64("text").alias("tie")).mapInArrow(run, "words array<string>, times array<int>, target long, order long, tie long")
    return common.trained(common.first_rows(rows, bound), learn) or _constant(0.0)


def store_of(model: Model) -> WordStore:
    return WordStore(lambda words: np.array([[np.mean(model.weight[buckets_of(w)])] for w in words]), 1)


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """Add ``column``, the probability of class 1, to each row; every column is kept.

    Only the text is read, all of it, as one mean of its words. Null and empty texts and texts without words have the
    score of the bias alone. If the labels hold one class only, or none, the score is constant. Repeated rows and null
    ids give rows of their own; an input column named ``column`` is replaced.
    """
    kept = [f for f in docs.schema.fields if f.name != column]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField(column, T.DoubleType())])
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        store = common.kept("toxicity", m, lambda: store_of(m))
        for batch in common.slices(batches, 64):
            found = [words_of(t) for t in batch.column(at).to_pylist()]
            sizes = [len(x) for x in found]
            z = by_text(store.find([w for x in found for w in x])[:, 0], sizes) / (CALM + np.array(sizes)) + m.bias
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=[*names, column])

    return docs.select(*names).mapInArrow(run, schema)
