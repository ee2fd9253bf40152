"""Near-duplicate documents by SimHash fingerprints and a self-join of their binary trie.

Fingerprints that differ in at most r of 64 bits agree on one of r + 1 blocks of bits. For each block the fingerprints
are rotated so that the block comes first: in the trie of the rotated fingerprints the pairs that agree on it lie below
one node at the block's depth, where no error has been spent. Each such node is a unit of work: its subtrie is joined
with itself, node pairs are walked down together, differing bits add up, and a pair is left when they exceed r. Nodes
with very many fingerprints are dealt out as the pairs of their descendants eight levels further down.

``near_duplicates`` links fingerprints. ``near_copies`` links documents by the shingles they share: there the tries of
several slices of a longer fingerprint give candidates, and the shingle sets of a candidate pair decide.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.llm import common, graph

SEED = 42
LEAF = 2048  #: node pairs with no more fingerprint pairs than this are compared at once
HOT, DEEPER = 1_000_000, 8  #: fingerprints below one node (up to 48 bytes each) from which its descendants so many levels down are dealt out


def fingerprint(text: str | None, width: int = 3) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes. No words: zero."""
    hashes = shingle_hashes(text, width)
    return int(majority(hashes)) if len(hashes) else 0


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words, of the whole sequence if it is shorter; nothing if there are no words."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and blanks 09-0D and 20
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:k].tolist(), ends[min(width, len(words)) - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, k)


def majority(hashes: np.ndarray) -> np.uint64:
    """Bit i is 1 if it is 1 in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        ones += np.add.reduce(np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, fp (long, the 64 bits) of each row."""
    source = docs.select(id_col, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.kept("simhash", None, lambda: None)  # memory that other operators hold in this worker
        for batch in common.slices(batches):
            fps = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    return source.mapInArrow(run, f"{id_col} {source.schema[0].dataType.simpleString()}, fp long")


class Forest:
    """Union-find over 0..n-1 that keeps the links it needed."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def link(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((x, y))


def trie_join(fps: np.ndarray, radius: int, level: int = 0, pair: tuple[int, int] | None = None) -> list[tuple[int, int]]:
    """Links, as positions, that connect the sorted distinct ``fps`` as all pairs within ``radius`` would.

    ``level`` top bits are equal in all of them. ``pair`` starts from two nodes DEEPER levels below instead of the root.
    """
    forest = Forest(len(fps))
    n = len(fps)
    if pair is None:
        work = [(0, n, 0, n, level, radius)]
    else:
        at = np.uint64(64 - level - DEEPER)
        sub = fps >> at & np.uint64((1 << DEEPER) - 1)
        (a0, a1), (b0, b1) = ((int(np.searchsorted(sub, p)), int(np.searchsorted(sub, p, "right"))) for p in pair)
        work = [(a0, a1, b0, b1, level + DEEPER, radius - (pair[0] ^ pair[1]).bit_count())]
    while work:
        a0, a1, b0, b1, bit, left = work.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        same = a0 == b0
        if same and a1 - a0 < 2:
            continue
        if bit == 64 or (a1 - a0) * (b1 - b0) <= LEAF:
            near = np.bitwise_count(fps[a0:a1, None] ^ fps[None, b0:b1]) <= radius
            for x, y in np.argwhere(np.triu(near, 1) if same else near).tolist():
                forest.link(a0 + x, b0 + y)
            continue
        # the children: where the next bit turns to one
        mask = np.uint64(1 << (63 - bit))
        a = a0 + int(np.count_nonzero(fps[a0:a1] & mask == 0))
        b = a if same else b0 + int(np.count_nonzero(fps[b0:b1] & mask == 0))
        work.append((a0, a, b0, b, bit + 1, left))
        work.append((a, a1, b, b1, bit + 1, left))
        if left:
            work.append((a0, a, b, b1, bit + 1, left - 1))
            if not same:
                work.append((a, a1, b0, b, bit + 1, left - 1))
    return forest.links


def _turned(fp: Column, by: int) -> Column:
    return fp if not by else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def units(batches: Iterator[pa.RecordBatch], key: list[str], columns: list[str]) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """Of rows in order of ``key`` (numbers), each key that has two rows or more, with their ``columns``."""
    held: list[list[np.ndarray]] = []
    at: tuple | None = None

    def whole() -> Iterator[tuple[tuple, list[np.ndarray]]]:
        if at is not None and sum(len(x[0]) for x in held) > 1:
            yield at, [np.concatenate(x) for x in zip(*held, strict=True)]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, cols = [batch.column(c).to_numpy() for c in key], [batch.column(c).to_numpy() for c in columns]
        cut = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1
        for s, e in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
            own = tuple(int(k[s]) for k in keys)
            if own != at:
                yield from whole()
                held, at = [], own
            held.append([c[s:e] for c in cols])
    yield from whole()


def dealt(rows: DataFrame, parts: list[tuple[int, int, int]], depth: int, radius: int, hot: int) -> DataFrame:
    """``rows`` (turn, block, bits, ...) dealt out by unit and sorted within it, with ``sub``: -1, or a pair of descendants.

    ``parts`` has (turn, first bit, number of bits) of the blocks; bits come turned, so that the block is on top.
    """
    many = rows.groupBy("turn", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("turn", "block", F.lit(True).alias("many"))
    width = F.element_at(F.array(*[F.lit(w) for _, _, w in parts]), F.pmod(F.col("turn"), F.lit(len(parts))) + 1)
    own = F.expr("cast(shiftrightunsigned(bits, 64 - width - deeper) & ((1 << deeper) - 1) as int)".replace("deeper", str(DEEPER)))
    flips = F.array(*[F.lit(x) for x in range(1 << DEEPER) if x.bit_count() <= radius])
    other = F.transform(flips, lambda x: F.col("own").bitwiseXOR(x))
    sub = F.when(F.col("many"), F.transform(other, lambda o: F.least("own", o) * (1 << DEEPER) + F.greatest("own", o))).otherwise(F.array(F.lit(-1)))
    rows = rows.join(many, ["turn", "block"], "left").withColumn("width", width).withColumn("own", own)
    rows = rows.withColumn("sub", F.explode(sub)).drop("many", "width", "own")
    return rows.repartition("turn", "block", "sub").sortWithinPartitions("turn", "block", "sub", "bits")


def blocks_of(depth: int, radius: int) -> list[tuple[int, int, int]]:
    """(turn, first bit, bits) of radius + 1 blocks, on one of which fingerprints within ``radius`` agree."""
    edges = np.linspace(0, depth, radius + 2).round().astype(int).tolist()
    return [(r, a, b - a) for r, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


def links(nodes: DataFrame, radius: int = 2, hot: int = HOT) -> DataFrame:
    """(a, b) fingerprints whose links connect the distinct ``nodes`` (fp) as all pairs within ``radius`` bits would."""
    parts = blocks_of(64, radius)
    turned = [F.struct(F.lit(r).alias("turn"), F.shiftrightunsigned(_turned(F.col("fp"), a), 64 - w).alias("block"), _turned(F.col("fp"), a).alias("bits")) for r, a, w in parts]
    rows = dealt(nodes.select(F.inline(F.array(*turned))), parts, 64, radius, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (turn, _, sub), (bits,) in units(batches, ["turn", "block", "sub"], ["bits"]):
            _, shift, w = parts[turn]
            fps = np.unique(bits.view(np.uint64))
            got = np.array(trie_join(fps, radius, w, None if sub < 0 else (sub >> DEEPER, sub & (1 << DEEPER) - 1)), np.int64).reshape(-1, 2)
            if len(got):
                if shift:
                    fps = fps >> np.uint64(shift) | fps << np.uint64(64 - shift)
                yield pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)[got[:, k]]) for k in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, id_col: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id of each row.

    Documents link if their fingerprints differ in at most ``radius`` bits; component_id is the smallest id reachable.
    Null, empty and blank texts have fingerprint zero, which links like any other. Each row gives a row, also when rows
    or ids repeat; a null id takes the smallest non-null id of its component, null if there is none. Other columns are
    not carried on. Copies are one fingerprint from the start, so groups of any size are one vertex.
    """
    fps = common.staged(fingerprints(docs, width, id_col, text), "fingerprints", compact=True)
    nodes = fps.groupBy("fp").agg(F.min(id_col).alias("least"))
    found = graph.connected_components(links(nodes.select("fp"), radius, hot), "simhash")
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return fps.join(of, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


SIMILARITY, WIDTH = 0.8, 5
RECALL = 0.995  #: chance that a pair just at the similarity meets in some slice
SPREAD = 5.0  #: standard deviations by which a pair just at the similarity may exceed its expected number of differing bits


def bit_chance(similarity: float) -> float:
    """Chance that a bit of the fingerprints of two sets differs: the angle between the sets' vectors over a half turn."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def plan(n: int, similarity: float, recall: float = RECALL) -> tuple[int, int, int]:
    """(bits, radius, slices) for n documents: slices grow with the logarithm of n, so few pairs meet by chance.

    Beyond 2 ** 24 documents the radius stays at two, and bits grow so that a block has half of HOT documents on average:
    no unit but one of more alike slices than that is dealt out, and a document has 144 postings at 10 ** 9.
    """
    n = max(n, 2)
    bits = min(62, max(16, math.ceil(math.log2(n)), 3 * math.ceil(math.log2(max(1, 2 * n / HOT)))))
    radius, p = min(2, max(1, bits // 12)), bit_chance(similarity)
    alike = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(radius + 1))
    return bits, radius, math.ceil(math.log(1 - recall) / math.log(1 - alike))


def differing(similarity: float, bits: int) -> int:
    """Bits of a long fingerprint that a pair may differ in and still be a candidate."""
    p = bit_chance(similarity)
    return math.ceil(bits * p + SPREAD * math.sqrt(bits * p * (1 - p)))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; of a text without words, the hash of nothing."""
    h = shingle_hashes(text, width)
    return np.unique(h) if len(h) else np.array([xxhash.xxh64_intdigest(b"", SEED)], np.uint64)


def node_of(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes())).view(np.int64))


def long_print(hashes: np.ndarray, words: int) -> np.ndarray:
    """A fingerprint of 64 times ``words`` bits over mixed hashes."""
    out = np.zeros(words, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            x = hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            out[k] = majority(x ^ x >> np.uint64(31))
    return out


def slices_of(prints: np.ndarray, bits: int, slices: int) -> np.ndarray:
    """Of long fingerprints (rows), ``slices`` stretches of ``bits`` bits, each on top of a 64-bit number."""
    flat = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")[:, : bits * slices]
    wide = np.zeros((len(prints), slices, 64), np.uint8)
    wide[:, :, 64 - bits :] = flat.reshape(len(prints), slices, bits)
    return np.packbits(wide, axis=2, bitorder="little").view("<u8")[:, :, 0]


def signatures(docs: DataFrame, width: int, bits: int, slices: int, id_col: str, text: str) -> DataFrame:
    """id, mark (hash of the text), node (hash of the shingle set), n (its size), slices of its fingerprint, and 128 bits."""
    source = docs.select(id_col, F.xxhash64(text).alias("mark"), text)
    words = -(-bits * slices // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.kept("simhash", None, lambda: None)  # memory that other operators hold in this worker
        for batch in common.slices(batches):
            sets = [shingle_set(t, width) for t in batch.column(2).to_pylist()]
            prints = np.array([long_print(s, words) for s in sets], np.uint64).reshape(-1, words)
            cut = slices_of(prints, bits, slices).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * slices, pa.array(cut.reshape(-1)))
            columns = [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), lists, *(pa.array(prints[:, k].view(np.int64)) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=[id_col, "mark", "node", "n", "slices", "x", "y"])

    return source.mapInArrow(run, f"{id_col} {source.schema[0].dataType.simpleString()}, mark long, node long, n long, slices array<long>, x long, y long")


def shingle_sets(docs: DataFrame, marks: DataFrame, width: int, text: str) -> DataFrame:
    """node and hashes (binary) of the texts that ``marks`` (mark) names."""
    source = docs.select(F.xxhash64(text).alias("mark"), text).join(marks, "mark", "left_semi").select(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            sets = [shingle_set(t, width) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["node", "hashes"])

    return source.mapInArrow(run, "node long, hashes binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, least: float, read: list[DataFrame], each: int = 512) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are as similar as ``least``. What it stages for them is added to ``read``.

    A node in many pairs has its set repeated once for ``each`` of them, and its pairs dealt out, so none gathers in a task.
    """
    rows = pairs
    for side, far in (("a", "b"), ("b", "a")):
        load = pairs.groupBy(side).agg(F.ceil(F.count(F.lit(1)) / each).cast("int").alias("copies")).where("copies > 1")
        load = common.staged(load, "loads", compact=True)
        read.append(load)
        copies = F.coalesce("copies", F.lit(1))
        own = sets.withColumnRenamed("node", side).join(load, side, "left").select(side, F.col("hashes").alias(f"{side}_hashes"), F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
        rows = rows.join(load, side, "left").withColumn("copy", F.pmod(F.xxhash64(far), copies).cast("int")).drop("copies")
        rows = rows.join(own, [side, "copy"]).drop("copy")
    both = rows.select("a", "b", "a_hashes", "b_hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            near = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both >= least * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def unlike_pairs(bits: np.ndarray, root: np.ndarray, near: Callable[[slice, slice], np.ndarray], radius: int, level: int, depth: int, pair: tuple[int, int] | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs of the trie of sorted ``bits`` within ``radius`` that have different roots and are ``near``.

    ``depth`` top bits count, and ``level`` of them are equal in all rows. A node pair below which all rows have one root
    is passed over, so a group that is linked already costs a look, not its pairs.
    """
    top = bits >> np.uint64(64 - depth)
    n = len(bits)
    change = np.concatenate(([0], np.cumsum(root[1:] != root[:-1])))  # rows a to b have one root if this is the same at both ends
    if pair is None:
        work = [(0, n, 0, n, level, radius)]
    else:
        sub = bits >> np.uint64(64 - level - DEEPER) & np.uint64((1 << DEEPER) - 1)
        (a0, a1), (b0, b1) = ((int(np.searchsorted(sub, p)), int(np.searchsorted(sub, p, "right"))) for p in pair)
        work = [(a0, a1, b0, b1, level + DEEPER, radius - (pair[0] ^ pair[1]).bit_count())]
    while work:
        a0, a1, b0, b1, bit, left = work.pop()
        same = a0 == b0
        if a0 >= a1 or b0 >= b1 or left < 0 or (same and a1 - a0 < 2):
            continue
        if change[a0] == change[a1 - 1] and change[b0] == change[b1 - 1] and root[a0] == root[b0]:
            continue
        if bit >= depth or (a1 - a0) * (b1 - b0) <= 16 * LEAF:
            for s in range(a0, a1, 4096):
                for t in range(b0, b1, 4096):
                    i, j = slice(s, min(s + 4096, a1)), slice(t, min(t + 4096, b1))
                    hit = (root[i, None] != root[None, j]) & (np.bitwise_count(top[i, None] ^ top[None, j]) <= radius)
                    if same:
                        hit &= np.arange(i.start, i.stop)[:, None] < np.arange(j.start, j.stop)[None, :]
                    if hit.any():
                        x, y = np.nonzero(hit & near(i, j))
                        yield x + s, y + t
            continue
        mask = np.uint64(1 << (63 - bit))
        a = a0 + int(np.count_nonzero(bits[a0:a1] & mask == 0))
        b = a if same else b0 + int(np.count_nonzero(bits[b0:b1] & mask == 0))
        work.append((a0, a, b0, b, bit + 1, left))
        work.append((a, a1, b, b1, bit + 1, left))
        if left:
            work.append((a0, a, b, b1, bit + 1, left - 1))
            if not same:
                work.append((a, a1, b0, b, bit + 1, left - 1))


def near_copies(docs: DataFrame, width: int = WIDTH, least: float = SIMILARITY, id_col: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """id and component_id of each row.

    Documents link if they share ``least`` of their distinct shingles; component_id is the smallest id reachable. Each row
    gives a row, also when rows or ids repeat; a null id takes the smallest non-null id of its component, null if there is
    none. Texts without words are alike. Copies are one node from the start.

    A pair is a candidate if it lies within the radius in the trie of one of several slices of the fingerprint, and within
    the expected number of differing bits and SPREAD deviations over 128 bits. Each node is first held against the
    smallest one that has an equal slice, twice; then all candidates of different components, pair by pair.
    """
    n = max(1, docs.count())
    bits, radius, slices = plan(n, least)
    rows = common.staged(signatures(docs, width, bits, slices, id_col, text), "signatures", compact=True)
    nodes = rows.groupBy("node").agg(F.min(id_col).alias("least"), F.min("mark").alias("mark"), F.first("n").alias("n"), F.first("slices").alias("slices"), F.first("x").alias("x"), F.first("y").alias("y"))
    nodes = common.staged(nodes, "nodes", compact=True)
    limit = differing(least, 128)
    far = lambda x, y: F.bit_count(F.col("x").bitwiseXOR(x)) + F.bit_count(F.col("y").bitwiseXOR(y))
    fits = F.least("n", "n2") >= F.greatest("n", "n2") * least
    linked: DataFrame | None = None
    found: DataFrame | None = None
    marks = nodes.select("node", "mark")
    for _ in range(2):
        posts = nodes.select("node", "n", "x", "y", F.posexplode("slices").alias("turn", "block"))
        if found is not None:
            posts = posts.join(found, "node", "left")
        root = F.coalesce("root", "node") if found is not None else F.col("node")
        posts = posts.withColumn("root", root)
        group = posts.groupBy("turn", "block").agg(F.min(F.struct("root", "node", "n", "x", "y")).alias("first"), F.max("root").alias("last")).where("first.root <> last").select("turn", "block", "first")
        group = common.staged(group, "groups", compact=True)
        tried = posts.join(group, ["turn", "block"]).select("node", "root", "n", "x", "y", F.col("first.root").alias("root2"), F.col("first.node").alias("b"), F.col("first.n").alias("n2"), F.col("first.x").alias("x2"), F.col("first.y").alias("y2"))
        tried = tried.where((F.col("root") != F.col("root2")) & fits & (far(F.col("x2"), F.col("y2")) <= limit)).groupBy("node").agg(F.min(F.struct("root2", "b")).alias("to"))
        stars = common.staged(tried.select(F.col("node").alias("a"), F.col("to.b").alias("b")), "stars", compact=True)
        common.discard(group)
        linked, found = _linked(docs, stars, marks, linked, width, least, text)
    # all candidate pairs that those links leave apart
    parts = blocks_of(bits, radius)
    turned = lambda v, a: v if not a else F.shiftleft(v, a).bitwiseOR(F.shiftleft(F.shiftrightunsigned(v, 64 - a), 64 - bits))
    posts = nodes.select("node", "n", "x", "y", F.posexplode("slices").alias("slice", "v")).join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    blocks = [F.struct((F.col("slice") * len(parts) + r).alias("turn"), F.shiftrightunsigned(turned(F.col("v"), a), 64 - w).alias("block"), turned(F.col("v"), a).alias("bits")) for r, a, w in parts]
    units_ = dealt(posts.select("node", "n", "x", "y", "root", F.inline(F.array(*blocks))), parts, bits, radius, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (turn, _, sub), (value, node, size, x, y, root) in units(batches, ["turn", "block", "sub"], ["bits", "node", "n", "x", "y", "root"]):
            order = np.argsort(value.view(np.uint64), kind="stable")
            value, node, size, x, y, root = value.view(np.uint64)[order], node[order], size[order], x[order].view(np.uint64), y[order].view(np.uint64), root[order]

            def near(i: slice, j: slice, size=size, x=x, y=y) -> np.ndarray:
                fit = np.minimum(size[i, None], size[None, j]) >= np.maximum(size[i, None], size[None, j]) * least
                return fit & (np.bitwise_count(x[i, None] ^ x[None, j]).astype(np.int16) + np.bitwise_count(y[i, None] ^ y[None, j]) <= limit)

            pair = None if sub < 0 else (sub >> DEEPER, sub & (1 << DEEPER) - 1)
            for i, j in unlike_pairs(value, root, near, radius, parts[turn % len(parts)][2], bits, pair):
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["a", "b"])

    apart = common.staged(units_.mapInArrow(run, "a long, b long").distinct(), "apart", compact=True)
    linked, found = _linked(docs, apart, marks, linked, width, least, text)
    rooted = nodes.select("node", "least").join(found, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select(id_col, "node").join(rooted.join(ids, "root").select("node", "component_id"), "node").select(id_col, "component_id")


def _linked(docs: DataFrame, pairs: DataFrame, marks: DataFrame, linked: DataFrame | None, width: int, least: float, text: str) -> tuple[DataFrame, DataFrame]:
    """All links so far, and the components (node, root) that they make."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    named = common.staged(ends.join(marks, "node").select("mark"), "marks", compact=True)
    sets = common.staged(shingle_sets(docs, named, width, text), "sets", compact=True)
    loads: list[DataFrame] = []
    new = common.staged(verified(pairs, sets, least, loads), "links", compact=True)
    for used in (pairs, named, sets, *loads):
        common.discard(used)
    linked = new if linked is None else linked.unionByName(new)
    return linked, graph.connected_components(linked, "copies")
