"""Near-duplicate embeddings: sign hashing by random hyperplanes in several tables, exact cosines, components.

Equal vectors of one label are one class, compared once. A class has a code, the signs of its vector against random
hyperplanes; a table's key is a few bits of it. Classes that share a key in some table meet twice: first as codes alone,
where those are kept that have a partner whose code differs in no more bits than a pair at the threshold may; then the
vectors of those, whose cosines are taken in double precision. A pair that meets in several tables counts in the first.
Buckets are compared in square blocks: a large bucket becomes block pairs, which are tasks of bounded size; of a block
pair only the number of links of each class and a spanning forest come out, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.llm import common, graph
from veritally.llm.simhash import Forest

BLOCK, CODE_BLOCK = 1024, 8192  #: classes in a block of a bucket, of vectors and of codes
RECALL = 0.997  #: chance that a pair just at the threshold shares a key in some table
LEAST_BITS, SPREAD = 128, 5.0  #: bits of a code; standard deviations that a pair at the threshold may exceed its expected distance by


def plan(n: int, cosine: float, recall: float | None = None) -> tuple[int, int]:
    """(bits, tables) for n classes: keys grow with the logarithm of n, so buckets stay small; tables hold the recall."""
    bits = max(6, math.ceil(math.log2(max(n, 2))) - 10)
    alike = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - (RECALL if recall is None else recall)) / math.log(1 - alike))


def code_bits(bits: int, tables: int) -> int:
    return 8 * -(-max(LEAST_BITS, bits * tables) // 8)


def differing(cosine: float, bits: int) -> int:
    """Bits in which the codes of a pair may differ and the pair still be a candidate."""
    p = math.acos(cosine) / math.pi
    return math.ceil(bits * p + SPREAD * math.sqrt(bits * p * (1 - p)))


def planes(dim: int, count: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, count))


def keys_of(codes: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Of codes (rows of bytes), the keys by table."""
    flat = np.unpackbits(codes, axis=1, bitorder="little")[:, : bits * tables].reshape(len(codes), tables, bits)
    return (flat.astype(np.int64) << np.arange(bits)).sum(axis=2)


def block_links(a: np.ndarray, b: np.ndarray, keys_a: np.ndarray, keys_b: np.ndarray, table: int, same: bool, cosine: float) -> np.ndarray:
    """Of two blocks of unit vectors, the pairs that link and have no key in common before ``table``."""
    near = a @ b.T >= cosine
    if same:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    seen = np.zeros(len(i), bool)
    for t in range(table):
        seen |= keys_a[i, t] == keys_b[j, t]
    return np.stack([i[~seen], j[~seen]])


def spanning(forest: Forest, u: np.ndarray, v: np.ndarray) -> None:
    """Link the pairs in ``forest``, looking only at those that still join two of its trees."""
    while len(u):
        roots = np.array([forest.root(x) for x in range(len(forest.up))])
        apart = roots[u] != roots[v]
        u, v = u[apart], v[apart]
        first = np.unique(u, return_index=True)[1]
        for x, y in zip(u[first].tolist(), v[first].tolist(), strict=True):
            forest.link(x, y)


def hashed(vectors: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """id, label, vector and two hashes that name the class; they are null for vectors that link with nothing."""
    x = F.col(vector)
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    usable = F.coalesce(F.col(id_col).isNotNull() & F.col(label).isNotNull() & fine, F.lit(False))
    h = [F.when(usable, F.xxhash64(F.lit(k), F.col(label), x)) for k in (1, 2)]
    return vectors.select(F.col(id_col), F.col(label).alias("label"), x.alias("vector"), h[0].alias("h1"), h[1].alias("h2"))


def classes(rows: DataFrame, id_col: str) -> DataFrame:
    """rep (smallest id), size, label, vector of each distinct usable vector of a label; 128 bits of hash tell them apart."""
    return rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min(id_col).cast("long").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("label").alias("label"), F.first("vector").alias("vector"))


BUCKET = ["t", "key", "label", "dim"]


def in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` of buckets with two or more, dealt out by pairs (i, j) of blocks of a bucket; ``own`` is a row's block."""
    sizes = rows.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*BUCKET, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    rows = rows.join(sizes, BUCKET)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("own", "with")).withColumn("j", F.greatest("own", "with")).drop("with", "blocks")
    return rows.repartition(*BUCKET, "i", "j").sortWithinPartitions(*BUCKET, "i", "j")


def by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Of sorted rows, each (bucket, i, j) with its rows."""
    held: list[pa.RecordBatch] = []
    at: tuple | None = None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in (*BUCKET, "i", "j")), strict=True))
        start = 0
        for k in range(1, len(keys) + 1):
            if k == len(keys) or keys[k] != keys[start]:
                if at is not None and keys[start] != at:
                    yield at, pa.Table.from_batches(held)
                    held = []
                at = keys[start]
                held.append(batch.slice(start, k - start))
                start = k
    if held:
        yield at, pa.Table.from_batches(held)


def _codes(part: pa.Table) -> np.ndarray:
    raw = part.column("code").to_pylist()
    return np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)


def _sides(key: tuple, part: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    own = part.column("own").to_numpy()
    left = np.flatnonzero(own == key[4])
    return left, left if key[4] == key[5] else np.flatnonzero(own == key[5]), key[4] == key[5]


def links(found: DataFrame, n: int, cosine: float) -> DataFrame:
    """(rep, links, other): rows with links hold numbers of linked vectors, rows with other edges of a spanning forest."""
    bits, tables = plan(n, cosine)
    wide_bits = code_bits(bits, tables)
    limit = differing(cosine, wide_bits)
    label = found.schema["label"].dataType.simpleString()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 2048):
            sizes = np.diff(batch.column("vector").offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                rows = batch.filter(pa.array(sizes == dim))
                x = rows.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, dim)
                codes = np.packbits(x.astype(np.float64) @ planes(dim, wide_bits) > 0, axis=1, bitorder="little")
                keys = keys_of(codes, bits, tables)
                lists = pa.ListArray.from_arrays(np.arange(rows.num_rows + 1, dtype=np.int32) * tables, pa.array(keys.reshape(-1)))
                raw = pa.array([v.tobytes() for v in x.astype("<f8" if x.dtype == np.float64 else "<f4")], pa.binary())
                code = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column("rep"), rows.column("size"), rows.column("label"), pa.array(np.full(rows.num_rows, dim, np.int32)), raw, code, lists], names=["rep", "size", "label", "dim", "raw", "code", "keys"])

    wide = found.select("rep", "size", "label", "vector").mapInArrow(coded, f"rep long, size long, label {label}, dim int, raw binary, code binary, keys array<long>")
    wide = common.staged(wide, "codes")

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part in by_unit(batches):
            codes = _codes(part).view(np.uint8)
            words = np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8)))).view(np.uint64)
            left, right, same = _sides(key, part)
            near = np.zeros(len(words), bool)
            for p in range(0, len(left), 1024):
                for q in range(p if same else 0, len(right), 1024):
                    a, b = left[p : p + 1024], right[q : q + 1024]
                    far = np.zeros((len(a), len(b)), np.int16)
                    for k in range(words.shape[1]):
                        far += np.bitwise_count(words[a, k][:, None] ^ words[b, k][None, :])
                    hit = far <= limit
                    if same and p == q:
                        np.fill_diagonal(hit, False)
                    near[a[hit.any(axis=1)]] = True
                    near[b[hit.any(axis=0)]] = True
            if near.any():
                yield from part.select([*BUCKET, "rep"]).filter(pa.array(near)).combine_chunks().to_batches()

    keyed = wide.select("rep", "code", "label", "dim", F.posexplode("keys").alias("t", "key"))
    some = in_blocks(keyed, CODE_BLOCK).mapInArrow(partners, f"t int, key long, label {label}, dim int, rep long").distinct()
    some = common.staged(some, "partners")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part in by_unit(batches):
            t, dim = key[0], key[3]
            raw = part.column("raw").to_pylist()
            x = np.frombuffer(b"".join(raw), "<f4" if len(raw[0]) == 4 * dim else "<f8").reshape(-1, dim).astype(np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            keys = keys_of(_codes(part), bits, tables)
            rep, size = (part.column(c).to_numpy() for c in ("rep", "size"))
            left, right, same = _sides(key, part)
            # both sides of a block pair are at hand; blocks are bounded on average, and cut again if one is far larger
            count, forest = np.zeros(len(x), np.int64), Forest(len(x))
            for p in range(0, len(left), 2048):
                for q in range(p if same else 0, len(right), 2048):
                    a, b = left[p : p + 2048], right[q : q + 2048]
                    i, j = block_links(x[a], x[b], keys[a], keys[b], t, same and p == q, cosine)
                    count += np.bincount(a[i], size[b[j]], len(x)).astype(np.int64) + np.bincount(b[j], size[a[i]], len(x)).astype(np.int64)
                    spanning(forest, a[i], b[j])
            linked = np.flatnonzero(count)
            u, v = np.array(forest.links, np.int64).reshape(-1, 2).T
            if len(linked):
                other = np.concatenate([np.zeros(len(linked), np.int64), rep[v]])
                none = np.arange(len(other)) < len(linked)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([rep[linked], rep[u]])), pa.array(np.concatenate([count[linked], np.zeros(len(u), np.int64)])), pa.array(other, mask=none)], names=["rep", "links", "other"])

    rows = some.join(wide.select("rep", "size", "raw", "code"), "rep")
    return in_blocks(rows, BLOCK).mapInArrow(compare, "rep long, links long, other long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """id, n_links, component_id, kept of each row.

    Rows link if labels are equal and not null and the cosine is at least ``cosine``. Vectors that are null, empty,
    zero, or hold null or non-finite components, rows without label and rows without id link with nothing: no links,
    their own id as component. Vectors of different lengths don't link. Rows that share an id count as one vertex.
    ``kept`` is true where the id is its component's, and false for a null id. Other columns are not carried on.
    """
    base = hashed(vectors, id_col, vector, label)
    found = common.staged(classes(base, id_col), "vectors")
    got = common.staged(links(found, found.count(), cosine), "links")
    n = got.where("other is null").groupBy("rep").agg(F.sum("links").alias("n"))
    roots = graph.connected_components(got.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")), "embeddings")
    of = found.select("h1", "h2", "rep", "size").join(n, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    of = of.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("root", "rep").alias("root"))
    out = base.select(F.col(id_col).alias("id"), "h1", "h2").join(of, ["h1", "h2"], "left")
    component = F.coalesce("root", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
