"""Quality: a factorisation machine over hashed words, structure statistics and metadata.

The score is w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j. The pairs are taken in linear time as half of the
squared sum less the sum of squares, for each factor.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritally.llm import common
from veritally.llm.words import WordStore

HASHED, RANK = 1 << 15, 8
MARKS = (b"!", b"?", b"|", b".", b",", b"#$%&*@^~_=+<>/\\", b"\n", b"\"'()[]{}", b":;-")  #: groups of signs, counted by share
STATS = 12 + len(MARKS)


def _groups() -> np.ndarray:
    out = np.zeros((256, 4 + len(MARKS)))
    out[ord("A") : ord("Z") + 1, 0] = out[ord("a") : ord("z") + 1, 1] = out[ord("0") : ord("9") + 1, 2] = out[128:, 3] = 1
    for k, signs in enumerate(MARKS):
        out[list(signs), 4 + k] = 1
    return out


GROUPS = _groups()


def _bucket(words: list[str]) -> np.ndarray:
    return np.array([[zlib.crc32(w.lower().encode()) & HASHED - 1] for w in words], float)


def features(texts: list[str | None], n_chars: list[int | None], store: WordStore) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of hashed words, values of a text with squares that sum to 1; and the statistics by text."""
    words = [(t or "").split() for t in texts]
    sizes = np.array([len(x) for x in words])
    flat = store.find([w for x in words for w in x])[:, 0].astype(np.int64)
    keys, times = np.unique(np.repeat(np.arange(len(texts)), sizes) * HASHED + flat, return_counts=True)
    of, bucket = keys // HASHED, keys % HASHED
    value = np.sqrt(times / sizes[of])
    stats = np.zeros((len(texts), STATS))
    most = np.zeros(len(texts))
    np.maximum.at(most, of, times)
    kinds = np.bincount(of, minlength=len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)
    again = np.bincount(owner[1:][(flat[1:] == flat[:-1]) & (owner[1:] == owner[:-1])], minlength=len(texts))
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        n, k = max(1, len(raw)), max(1, int(sizes[i]))
        stats[i, : GROUPS.shape[1]] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ GROUPS / n
        lines = (t or "").split("\n")
        stated = n_chars[i] if n_chars[i] is not None and n_chars[i] >= 0 else len(t or "")
        stats[i, GROUPS.shape[1] :] = (n / k, len(set(lines)) / len(lines), most[i] / k, kinds[i] / k, again[i] / k, math.log1p(sizes[i]), math.log1p(stated), math.log1p(stated) - math.log1p(len(t or "")))
    return of, bucket, value, stats


@dataclass(eq=False)  # a model is itself; its arrays have no one truth
class Model:
    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def inputs(self, of, bucket, value, stats):
        """All features of all texts, in order of text: statistics follow the words."""
        x = np.clip((stats - self.mean) / self.spread, -4, 4) / math.sqrt(STATS)
        rows = np.concatenate([of, np.repeat(np.arange(len(stats)), STATS)])
        order = np.argsort(rows, kind="stable")
        cols = np.concatenate([bucket, np.tile(np.arange(HASHED, HASHED + STATS), len(stats))])
        return rows[order], cols[order], np.concatenate([value, x.ravel()])[order]

    def logits(self, rows, cols, x, n: int) -> np.ndarray:
        starts = np.searchsorted(rows, np.arange(n))
        vx = self.v[cols] * x[:, None]
        total, squares = np.add.reduceat(vx, starts, axis=0), np.add.reduceat(vx * vx, starts, axis=0)
        return self.w0 + np.add.reduceat(self.w[cols] * x, starts) + 0.5 * (total * total - squares).sum(axis=1)


def train(texts: list[tuple[np.ndarray, np.ndarray]], stats: np.ndarray, y: np.ndarray, epochs: int = 30, rate: float = 0.05, decay: float = 1e-5, batch: int = 64, seed: int = 5) -> Model:
    """Adagrad on the log loss; texts: (buckets, values)."""
    rng = np.random.default_rng(seed)
    size = HASHED + STATS
    rate0 = float(np.clip(y.mean(), 0.01, 0.99))
    model = Model(math.log(rate0 / (1 - rate0)), np.zeros(size), rng.normal(0, 0.05, (size, RANK)), stats.mean(axis=0), stats.std(axis=0) + 1e-3)
    gw, gv, g0 = np.full(size, 1e-4), np.full((size, RANK), 1e-4), 1e-4
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            of = np.repeat(np.arange(len(part)), [len(texts[i][0]) for i in part])
            rows, cols, x = model.inputs(of, np.concatenate([texts[i][0] for i in part]), np.concatenate([texts[i][1] for i in part]), stats[part])
            d = (1 / (1 + np.exp(-np.clip(model.logits(rows, cols, x, len(part)), -30, 30))) - y[part]) / len(part)
            vx = model.v[cols] * x[:, None]
            total = np.add.reduceat(vx, np.searchsorted(rows, np.arange(len(part))), axis=0)
            own, inverse = np.unique(cols, return_inverse=True)
            dx = d[rows] * x
            dw = np.bincount(inverse, dx) + decay * model.w[own]
            pull = dx[:, None] * (total[rows] - vx)
            dv = np.stack([np.bincount(inverse, pull[:, k]) for k in range(RANK)], axis=1) + decay * model.v[own]
            gw[own] += dw * dw
            gv[own] += dv * dv
            g0 += d.sum() ** 2
            model.w[own] -= rate * dw / np.sqrt(gw[own])
            model.v[own] -= rate * dv / np.sqrt(gv[own])
            model.w0 -= rate * d.sum() / math.sqrt(g0)
    return model


def _stated(docs: DataFrame):
    return F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")


def _empty() -> Model:
    return Model(0.0, np.zeros(HASHED + STATS), np.zeros((HASHED + STATS, RANK)), np.zeros(STATS), np.ones(STATS))


def learn(table: pa.Table) -> Model:
    """The model of rows (bucket, value, stats, target), the same for any order of them."""
    stats = np.array(table.column("stats").to_pylist(), float).reshape(-1, STATS)
    bucket, value = table.column("bucket").combine_chunks(), table.column("value").combine_chunks()
    texts = [(bucket[i].values.to_numpy(), value[i].values.to_numpy()) for i in range(len(stats))]
    y = np.array([int(x > 0) for x in table.column("target").to_pylist()], float)
    marks = [zlib.crc32(a.tobytes() + b.tobytes()) for a, b in texts]
    order = np.lexsort((y, marks, *stats.T))
    return train([texts[i] for i in order.tolist()], stats[order], y[order])


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", held: int = 0, folds: int = 5, bound: int = 4000) -> Model:
    """Learn from at most ``bound`` labelled rows outside the fold ``held``; features are taken where texts are, a task trains."""
    rows = docs.where("text is not null").select("doc_id", "text", _stated(docs).alias("size"))
    sample = common.labelled(rows, labels, target, folds, held, bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = WordStore(_bucket, 1)
        for batch in common.slices(batches, 64):
            of, bucket, value, stats = features(batch.column(0).to_pylist(), batch.column(1).to_pylist(), store)
            cuts = np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (bucket, value)]
            yield pa.RecordBatch.from_arrays([*lists, pa.array(stats.tolist(), pa.list_(pa.float64())), batch.column(2).cast(pa.int64()), *batch.columns[3:]], names=["bucket", "value", "stats", "target", "order", "tie"])

    made = sample.select("text", "size", "target", "order", F.xxhash64("text", "size").alias("tie")).mapInArrow(run, "bucket array<long>, value array<double>, stats array<double>, target long, order long, tie long")
    return common.trained(common.first_rows(made, bound), learn) or _empty()


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """Add ``column``, the probability of class 1, to each row; every column is kept.

    Text (all of it) and n_chars are read, nothing else. A null text counts as empty; empty texts are scored by their
    statistics. A missing, null or negative n_chars counts as the text's length. Without labels the score is 0.5.
    Repeated rows and null ids give rows of their own; an input column named ``column`` is replaced.
    """
    kept = [f for f in docs.schema.fields if f.name != column]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField(column, T.DoubleType())])
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, store = shipped.value, common.kept("quality", "words", lambda: WordStore(_bucket, 1))
        for batch in common.slices(batches, 64):
            columns = batch.column(0).flatten()
            got = m.inputs(*features(columns[at].to_pylist(), batch.column(1).to_pylist(), store))
            z = m.logits(*got, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=[*names, column])

    return docs.select(F.struct(*names).alias("row"), _stated(docs).alias("size")).mapInArrow(run, schema)
