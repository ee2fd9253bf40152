"""Benchmark decontamination: fingerprints of item-sized windows, Hamming blocks, and exact shingle similarity.

Each benchmark item of n words is compared to all windows of n words of a document. A window's SimHash, over the hashes
of its five-word shingles, is looked up in an index of the items of that size by blocks of bits: of two fingerprints
within the radius at least one block differs in no more than its share of the radius, and all such values of a block are
probed, so none of them is missed. For items so found the weighted Jaccard similarity of the two multisets of shingles
decides. A fingerprint depends on the words of its window alone.

A similarity of s over k shingles on each side needs 2 s k / (1 + s) of them in common. Windows that have fewer shingles
of any item of their size can't pass the last test, and are left out before fingerprints are taken.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.llm import common

WORD = re.compile(r"\w+")
WIDTH, SIMILARITY, RADIUS = 5, 0.8, 16
PASS_BYTES = 32_000_000  #: of benchmark text that one pass over the documents compares
BLOCKS = 4  #: of 16 bits of a fingerprint
_all = np.arange(1 << 64 // BLOCKS, dtype=np.uint16)
FACTORS = np.random.default_rng(23).integers(1 << 62, 1 << 63, WIDTH, dtype=np.uint64) | np.uint64(1)  #: one for each place in a shingle


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode(), 42) or 1


def shingle_hashes(ids: np.ndarray, width: int, at: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash for each run of ``width`` hashes of words, or for those that start at ``at``; all bits depend on all words."""
    at = np.arange(max(0, len(ids) - width + 1)) if at is None else at
    with np.errstate(over="ignore"):
        x = np.full(len(at), width, np.uint64)
        for k in range(width):
            x += ids[at + k].astype(np.uint64) * FACTORS[k]
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def simhash(hashes: np.ndarray) -> int:
    ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: sum of minima over sum of maxima."""
    low = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return low / (sum(a.values()) + sum(b.values()) - low) if a or b else 0.0


class Hashes:
    """A set of 64-bit hashes; a table of their first bits turns most others away at once."""

    def __init__(self, values: np.ndarray):
        self.sorted = np.unique(values)
        self.shift = np.uint64(64 - min(26, max(16, len(self.sorted).bit_length() + 4)))
        self.table = np.zeros(1 << int(64 - self.shift), bool)
        self.table[(self.sorted >> self.shift).astype(np.int64)] = True

    def among(self, hashes: np.ndarray) -> np.ndarray:
        """Places of ``hashes`` that are in the set."""
        at = np.flatnonzero(self.table[(hashes >> self.shift).astype(np.int64)])
        if len(at):
            near = np.minimum(np.searchsorted(self.sorted, hashes[at]), len(self.sorted) - 1)
            at = at[self.sorted[near] == hashes[at]]
        return at


class Size:
    """The items of one number of words."""

    def __init__(self, words: int, items: list[tuple[int, np.ndarray]], radius: int):
        self.words, self.width, self.radius = words, min(WIDTH, words), radius
        self.items = [i for i, _ in items]
        hashes = [shingle_hashes(x, self.width) for _, x in items]
        self.known = Hashes(np.concatenate(hashes))
        self.bags = [Counter(h.tolist()) for h in hashes]
        self.prints = [simhash(h) for h in hashes]
        self.wide = np.array(self.prints, np.uint64)
        self.masks = _all[np.bitwise_count(_all) <= radius // BLOCKS]  # what a block may differ in if all do not exceed the radius
        self.index = []
        for k in range(BLOCKS):
            block = (self.wide >> np.uint64(16 * k)).astype(np.uint16)
            order = np.argsort(block, kind="stable")
            self.index.append((block[order], order))

    def near(self, fingerprint: int) -> list[int]:
        """Items whose fingerprint differs in ``radius`` bits or fewer."""
        found = []
        for k, (block, order) in enumerate(self.index):
            own = np.uint16(fingerprint >> 16 * k & 0xFFFF)
            if len(block) <= len(self.masks):  # then a look at each item costs less than the probes
                found.append(order[np.bitwise_count(block ^ own) <= self.radius // BLOCKS])
                continue
            low, high = (np.searchsorted(block, own ^ self.masks, side) for side in ("left", "right"))
            found += [order[a:b] for a, b in zip(low[high > low].tolist(), high[high > low].tolist(), strict=True)]
        some = np.unique(np.concatenate(found))
        return some[np.bitwise_count(self.wide[some] ^ np.uint64(fingerprint)) <= self.radius].tolist()


class Benchmark:
    """Items by size, ready to be compared."""

    def __init__(self, rows: list[tuple[int, str]], threshold: float = SIMILARITY, radius: int = RADIUS):
        self.threshold = threshold
        self.ids: dict[str, int] = {}
        by_words: dict[tuple[str, ...], list[int]] = {}
        for item, text in sorted(rows):
            if words := tuple(WORD.findall((text or "").lower())):
                by_words.setdefault(words, []).append(item)
        sizes: dict[int, list] = {}
        self.same: list[list[int]] = []
        for words, items in by_words.items():
            sizes.setdefault(len(words), []).append((len(self.same), np.array([self.ids.setdefault(w, word_hash(w)) for w in words], np.uint64)))
            self.same.append(items)
        self.sizes = [Size(n, x, radius) for n, x in sorted(sizes.items())]
        widths = {s.width for s in self.sizes}
        self.any = {w: Hashes(np.concatenate([s.known.sorted for s in self.sizes if s.width == w])) for w in widths}
        self.shortest = min((s.words for s in self.sizes), default=1 << 60)

    def leaks(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """(item, first word, number of words, similarity) of the best window of each place where an item leaks."""
        words = WORD.findall(text.lower()) if text else []
        n = len(words)
        if n < self.shortest:
            return []
        ids = np.fromiter(map(self.ids.get, words, repeat(0)), np.uint64, n)  # 0: a word that no item has
        strange = np.concatenate(([0], np.cumsum(ids == 0)))
        out = []
        hits_of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width, known in self.any.items():
            at = np.flatnonzero(strange[width:] == strange[: max(0, n + 1 - width)])  # a shingle with a strange word is in no item
            h = shingle_hashes(ids, width, at)
            own = known.among(h)
            hits_of[width] = at[own], h[own]
        for size in self.sizes:
            at, h = hits_of[size.width]
            if size.words > n or not len(at):
                continue
            k = size.words - size.width + 1
            need = math.ceil(2 * self.threshold / (1 + self.threshold) * k - 1e-9)
            if len(at) < need:
                continue
            hits = at[size.known.among(h)]
            if len(hits) < need:
                continue
            # windows [s, s + k) of shingles with enough hits
            mark = np.zeros(n - size.width + 2, np.int32)
            mark[hits + 1] = 1
            total = np.cumsum(mark)
            starts = np.flatnonzero(total[k:] - total[: len(total) - k] >= need)
            if not len(starts):
                continue
            low = int(starts[0])
            end = int(starts[-1]) + size.words
            own = np.array([x or word_hash(w) for x, w in zip(ids[low:end].tolist(), words[low:end], strict=True)], np.uint64)
            around = shingle_hashes(own, size.width)
            best: dict[int, list] = {}
            for s in starts.tolist():
                part = around[s - low : s - low + k]
                for i in size.near(simhash(part)):
                    x = similarity(Counter(part.tolist()), size.bags[i])
                    if x >= self.threshold:
                        runs = best.setdefault(i, [])
                        if runs and s - runs[-1][2] < size.words:
                            runs[-1][2] = s
                            if x > runs[-1][1]:
                                runs[-1][:2] = s, x
                        else:
                            runs.append([s, x, s])
            out += [(item, s, size.words, x) for i, runs in best.items() for s, x, _ in runs for item in self.same[size.items[i]]]
        return sorted(out)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, radius: int = RADIUS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, item_id, start, words, similarity: where a benchmark item leaks into a document.

    Words are runs of letters, digits and underscores in lower case; ``start`` counts them. Of overlapping windows the
    most similar counts, the first of equals. Items without words, and null ones, leak nowhere; equal items leak
    together; items of fewer than five words are one shingle. Null and short texts have no leaks; each row with leaks gives
    its own rows, also when ids repeat or are null. The benchmark's size is checked: it goes to the tasks in parts of at
    most PASS_BYTES on average, with a pass over the documents for each; the parts have no bearing on the result.
    """
    source = docs.select(id_col, text)
    kind = source.schema[0].dataType.simpleString()
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // PASS_BYTES) or 1
    out = None
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).collect()
        shipped = docs.sparkSession.sparkContext.broadcast(([(r[0], r[1]) for r in rows], threshold, radius))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            b = common.kept("benchmark", shipped.value, lambda: Benchmark(*shipped.value))
            for batch in common.slices(batches):
                found = [b.leaks(t) for t in batch.column(1).to_pylist()]
                take = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in found]))
                flat = [x for y in found for x in y]
                cols = [pa.array([x[k] for x in flat], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), *cols], names=[id_col, "item_id", "start", "words", "similarity"])

        one = source.mapInArrow(run, f"{id_col} {kind}, item_id long, start int, words int, similarity double")
        out = one if out is None else out.unionByName(one)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, radius: int = RADIUS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows into which a benchmark item leaks; see ``leaks``. Clean rows stay as they are.

    Rows that share an id with a leaking one go with it; rows with a null id stay.
    """
    found = leaks(docs, benchmark, threshold, radius, id_col, text).select(id_col).where(F.col(id_col).isNotNull()).distinct()
    found = common.staged(found, "leaks")  # its size is known, so Spark broadcasts it if it is small, and shuffles if not
    return docs.join(found, id_col, "left_anti").select(*docs.columns)
