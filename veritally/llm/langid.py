"""Language identification by unigram piece models whose segmentations are summed.

Each language has a probability for each piece of a public byte vocabulary. A word's probability is the sum over all
segmentations into pieces, by a forward pass over its bytes, and a text's is the product over its words. The piece
probabilities come from expectation maximisation (forward-backward counts) on the words of a bounded sample.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritally.llm import common
from veritally.llm.words import WordStore, by_text

WORD = re.compile(r"[^\W\d_]+")
VECTOR = 64  #: bytes up to which words are computed many at a time; longer ones one by one, in logarithms, with the same result
SCALE = 7.0  #: probabilities are kept times exp(SCALE) for each byte, so that they stay in range
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case. Numbers that aren't digits, such as fractions or Roman numerals, are no letters."""
    found = WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]


def trie(pieces: list[bytes]) -> tuple[dict[int, int], list[int]]:
    """(node << 8 | byte -> node, piece that ends at each node or -1); the root is 0."""
    branch, ends = {}, [-1]
    for i, piece in enumerate(pieces):
        node = 0
        for b in piece:
            if (key := node << 8 | b) not in branch:
                branch[key] = len(ends)
                ends.append(-1)
            node = branch[key]
        ends[node] = i
    return branch, ends


def arcs_of(word: str, vocabulary: tuple[dict[int, int], list[int]]) -> tuple[int, list[tuple[int, int, int]]]:
    """Number of bytes of a word with a blank before it, and the (from, to, piece) that match there, by from."""
    step, ends, s = vocabulary[0].get, vocabulary[1], b" " + word.encode()
    n, out = len(s), []
    for i in range(n):
        node = 0
        for j in range(i, n):
            node = step(node << 8 | s[j])
            if node is None:
                break
            if ends[node] >= 0:
                out.append((i, j + 1, ends[node]))
    return n, out


def _plus(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def long_word(word: str, vocabulary: tuple[dict[int, int], list[int]], logp: np.ndarray, expected: np.ndarray | None = None, times: float = 1.0) -> float:
    """Log of the sum over all segmentations of a word of any length; adds each piece's expected count to ``expected``."""
    n, arcs = arcs_of(word, vocabulary)
    ahead = [-math.inf] * (n + 1)
    ahead[0] = 0.0
    p = [float(logp[x]) for _, _, x in arcs]
    for (i, j, _), q in zip(arcs, p, strict=True):
        ahead[j] = _plus(ahead[j], ahead[i] + q)
    if expected is not None and ahead[n] > -math.inf:
        back = [-math.inf] * (n + 1)
        back[n] = 0.0
        for (i, j, x), q in zip(reversed(arcs), reversed(p), strict=True):
            back[i] = _plus(back[i], back[j] + q)
            expected[x] += times * math.exp(min(0.0, ahead[i] + q + back[j] - ahead[n]))
    return ahead[n]


class Lattice:
    """All arcs (from byte, to byte, piece) of a list of words, in order of their ends."""

    def __init__(self, words: list[str], vocabulary: tuple[dict[int, int], list[int]]):
        arcs, lengths, base = [], [], 0
        step, ends = vocabulary[0].get, vocabulary[1]
        for w in words:
            s = b" " + w.encode()
            n = len(s)
            for i in range(n):
                node = 0
                for j in range(i, n):
                    node = step(node << 8 | s[j])
                    if node is None:
                        break
                    p = ends[node]
                    if p >= 0:  # one number: the word's first byte, from, to, piece
                        arcs.append(base << 40 | i << 32 | j + 1 << 24 | p)
            lengths.append(n)
            base += n + 1
        self.size, self.lengths = base, np.array(lengths, np.int64)
        self.first = np.cumsum(self.lengths + 1) - self.lengths - 1
        x = np.array(arcs, np.int64)
        depth = x >> 24 & 255
        order = np.argsort(depth, kind="stable")
        x, depth = x[order], depth[order]
        self.at, self.end, self.piece = (x >> 40) + (x >> 32 & 255), (x >> 40) + depth, x & 0xFFFFFF
        self.cuts = np.searchsorted(depth, np.arange(1, (int(depth[-1]) if len(depth) else 0) + 2))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """p: scaled probability by piece. Of each place, the sum over all segmentations of what lies before it."""
        alpha = np.zeros(self.size)
        alpha[self.first] = 1
        for s, e in zip(self.cuts, self.cuts[1:], strict=False):
            alpha += np.bincount(self.end[s:e], alpha[self.at[s:e]] * p[self.piece[s:e]], self.size)[: self.size] if e > s else 0
        return alpha

    def backward(self, p: np.ndarray) -> np.ndarray:
        beta = np.zeros(self.size)
        beta[self.first + self.lengths] = 1
        for s, e in reversed(list(zip(self.cuts, self.cuts[1:], strict=False))):
            if e > s:
                np.add.at(beta, self.at[s:e], beta[self.end[s:e]] * p[self.piece[s:e]])
        return beta


@dataclass(eq=False)  # a model is itself; its arrays have no one truth
class Model:
    languages: list[str]
    pieces: list[bytes]
    logp: np.ndarray  # language x piece

    def scaled(self) -> np.ndarray:
        return np.exp(self.logp + SCALE * np.array([len(x) for x in self.pieces]))


def vocabulary(file: bytes) -> list[bytes]:
    return [base64.b64decode(line.split()[0]) for line in file.splitlines() if line.strip()]


def train(counts: list[tuple[str, str, int]], pieces: list[bytes], rounds: int = 4, smooth: float = 0.05) -> Model:
    """counts: (language, word, times). Each language's counts are smoothed with the pooled ones and a constant."""
    languages = sorted({x[0] for x in counts})
    index = trie(pieces)
    number = {x: i for i, x in enumerate(languages)}
    words = sorted({x[1] for x in counts}, key=lambda w: (len(w.encode()) >= VECTOR, w))
    place = {w: i for i, w in enumerate(words)}
    times = np.zeros((len(languages), len(words)))
    for lang, w, n in counts:
        times[number[lang], place[w]] += n
    short = sum(len(w.encode()) < VECTOR for w in words)
    logp = np.full((len(languages), len(pieces)), -np.log(len(pieces)))
    model = Model(languages, pieces, logp)
    step = 20_000
    parts = [(Lattice(words[i : min(short, i + step)], index), i) for i in range(0, short, step)]
    for _ in range(rounds):
        scaled = model.scaled()
        expected = np.zeros_like(logp)
        for lattice, i in parts:
            for k in range(len(languages)):
                n = times[k, i : min(short, i + step)]
                a, b = lattice.forward(scaled[k]), lattice.backward(scaled[k])
                ends = lattice.first + lattice.lengths
                weight = np.repeat(n / np.maximum(a[ends], 1e-300), lattice.lengths + 1)
                arcs = a[lattice.at] * scaled[k][lattice.piece] * b[lattice.end] * weight[lattice.at]
                expected[k] += np.bincount(lattice.piece, arcs, len(pieces))
        for i in range(short, len(words)):
            for k in np.flatnonzero(times[:, i]).tolist():
                long_word(words[i], index, model.logp[k], expected[k], times[k, i])
        pooled = (expected.sum(axis=0) + 0.01) / (expected.sum() + 0.01 * len(pieces))
        mixed = (1 - smooth) * expected / np.maximum(expected.sum(axis=1, keepdims=True), 1e-9) + smooth * pooled
        model.logp = np.log(mixed / mixed.sum(axis=1, keepdims=True))
    return model


def fit(docs: DataFrame, held: int = 2, folds: int = 4, bound: int = 300, pieces_file: str = "byte_bpe_multi_50k.tiktoken") -> Model:
    """Learn from text and lang of at most ``bound`` documents of each language outside the fold ``held``, all words of them.

    The documents with the smallest hashes of ids are chosen, language by language, so a rare language isn't crowded out. A
    task trains; rows with null text, lang or id don't count.
    """
    rows = docs.where("doc_id is not null and lang is not null and text is not null").where(common.fold_of("doc_id", folds) != held)
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    sizes = common.staged(rows.groupBy("lang").agg((2.0 * bound / F.count(F.lit(1))).alias("share")), "languages")
    near = rows.select("doc_id", F.col("lang").cast("string").alias("lang"), "text", order.alias("order")).join(sizes.withColumn("lang", F.col("lang").cast("string")), "lang").where("order < share")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 64):
            seen = [Counter(words_of(t)) for t in batch.column("text").to_pylist()]
            lists = [pa.array([list(c) for c in seen], pa.list_(pa.string())), pa.array([list(c.values()) for c in seen], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), *lists, batch.column("order"), batch.column("tie")], names=["lang", "words", "times", "order", "tie"])

    found = near.select("lang", "text", "order", F.xxhash64("text").alias("tie")).mapInArrow(run, "lang string, words array<string>, times array<long>, order double, tie long")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("order", "tie"))
    chosen = found.withColumn("nth", first).where(F.col("nth") <= bound).select("lang", "words", "times").repartition(1)
    file = common.vocabulary_bytes(pieces_file)

    def learn(table: pa.Table) -> Model:
        seen: Counter = Counter()
        for lang, words, times in zip(*(table.column(c).to_pylist() for c in ("lang", "words", "times")), strict=True):
            for w, n in zip(words, times, strict=True):
                seen[lang, w] += n
        return train([(*k, n) for k, n in sorted(seen.items())], vocabulary(file))

    return common.trained(chosen, learn) or Model([], [], np.zeros((0, 0)))


def scorer(model: Model) -> WordStore:
    """Of words, the log probability in each language."""
    index, scaled = trie(model.pieces), model.scaled()

    def compute(words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(model.languages)))
        small = np.array([len(w.encode()) < VECTOR for w in words], bool)
        for i in np.flatnonzero(~small).tolist():
            out[i] = [long_word(words[i], index, p) for p in model.logp]
        small = np.flatnonzero(small)
        for i in range(0, len(small), 2000):
            part = small[i : i + 2000]
            lattice = Lattice([words[k] for k in part.tolist()], index)
            ends = lattice.first + lattice.lengths
            for k, p in enumerate(scaled):
                out[part, k] = np.log(np.maximum(lattice.forward(p)[ends], 1e-300)) - SCALE * lattice.lengths
        return out

    return WordStore(compute, len(model.languages))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred and score (the winner's share of the summed likelihoods) to each row; every column is kept.

    Only the text is read, all of it. A null text, or one without letters, is ``und`` with score 0, and so is every
    text if no language was learned. Equal scores go to the first language in alphabetical order. Repeated rows and
    null ids give rows of their own; input columns with the names of added ones are replaced.
    """
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = [f.name for f in kept]
    at = names.index(text)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        store = common.kept("langid", m, lambda: scorer(m)) if m.languages else None
        for batch in common.slices(batches, 64):
            found = [words_of(t) for t in batch.column(at).to_pylist()]
            sizes = [len(x) for x in found]
            pred, score = [UNKNOWN] * len(found), np.zeros(len(found))
            if store is not None and sum(sizes):
                total = by_text(store.find([w for x in found for w in x]), sizes)
                share = np.exp(total - total.max(axis=1, keepdims=True))
                share /= share.sum(axis=1, keepdims=True)
                best = share.argmax(axis=1)
                for i, n in enumerate(sizes):
                    if n:
                        pred[i], score[i] = m.languages[best[i]], share[i, best[i]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return docs.select(*names).mapInArrow(run, schema)
