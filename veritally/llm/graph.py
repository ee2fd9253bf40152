"""Connected components of a distributed graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.llm import common


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first()
    return tuple(row)


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node that ``edges`` (a, b: long) name; root is the smallest node of the component.

    Each round hangs a node's larger neighbours, then its smaller ones, on its smallest neighbour, until the edges are
    the stars of the components. Minima are aggregated before rows move, and only joins meet a frequent node, so no
    task gathers a component. Each round is written to the shared folder, and the one before deleted. Loops and repeated edges are allowed; null ends
    are dropped; without edges the result is empty.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = common.staged(e, name)
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # a node without smaller neighbours hands its own id on; all others hand on their smallest neighbour
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = common.staged(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), name)
        new = _mark(after)
        common.discard(e)  # executors that are lost later read the new round
        e = after
        if new == mark:
            break
        mark = new
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
