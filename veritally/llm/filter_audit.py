"""Filter interaction audit: which filters fail each document, and what each does at each place in each order of them.

Whether a text stands under a smaller id is found by sorting: documents are dealt out by range of their text's fingerprint and
id, sorted by fingerprint, text and id, and each row is compared with its predecessor. The ranges' bounds, which pass through
the driver, hold no texts; the id in them deals one text's many copies out too. A run of equal texts may have begun in an
earlier range, but only the first fingerprint of a range can: its rows keep the text's digest, every range reports the least
id of each text that has its first or last fingerprint, and those few reports complete the comparison. Each document is by
then a part and a mask of failures; masks are counted by part, and all orders are sums of these counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.llm import common

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MIN_WORDS = 200
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
SIGNS = b"#$%&*|"
MASKS = "doc_id long, part string, mask int, digest binary"
REPORT = -1  #: the mask of a row that reports a text's least id


def failures(text: bytes) -> int:
    """The mask of the filters A to D that a text, as UTF-8, fails."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.decode("utf-8", "replace"))
    found = (len(words) < MIN_WORDS, 2 * len(set(words)) < len(words), 100 * capitals > 3 * points, len(text.translate(None, SIGNS)) < len(text))
    return sum(1 << i for i, fails in enumerate(found) if fails)


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Masks of one range's sorted rows; rows of its first fingerprint with digests, and its reports."""
    first = last = text = None  # fingerprints, and the text of the run
    mask, least, digest = 0, None, b""
    reports: dict[bytes, int | None] = {}  # of the first fingerprint
    latest: dict[bytes, int | None] = {}  # of the last one

    def row(ids: list, parts: list, masks: list, digests: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.string()), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "mask", "digest"])

    for batch in common.slices(batches, 256):
        ids, masks, digests = batch["doc_id"].to_pylist(), [], []
        for i, (fp, value) in enumerate(zip(batch["fp"].to_pylist(), batch["text"], strict=True)):
            now = value.as_py()
            if first is None:
                first = fp
            if fp != last or now != text:
                if fp != last:
                    last, latest = fp, {}
                text, mask, least = now, failures(now), ids[i]
                digest = hashlib.sha256(now).digest()
                latest[digest] = least
                if fp == first:
                    reports[digest] = least
            again = ids[i] is not None and least is not None and ids[i] > least
            masks.append(mask | COPY if again else mask)
            digests.append(digest if fp == first else None)
        yield row(ids, batch["part"].to_pylist(), masks, digests)
    ends = {k: v for k, v in (reports | latest).items() if v is not None}
    if ends:
        yield row(list(ends.values()), [None] * len(ends), [REPORT] * len(ends), list(ends))


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every document: its part is its lang, the empty text for none, and bit i is set where it fails filter i of FILTERS."""
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("fp", F.xxhash64("text"))
    order = F.col("doc_id").asc_nulls_last()
    ranges = rows.repartitionByRange("fp", order).sortWithinPartitions("fp", "text", order)
    found = common.staged(ranges.mapInArrow(_masked, MASKS), "masks", compact=True)
    starts = found.where(F.col("mask") == REPORT).groupBy("digest").agg(F.min("doc_id").alias("least"))
    plain = found.where((F.col("mask") != REPORT) & F.col("digest").isNull()).select("doc_id", "part", "mask")
    held = found.where((F.col("mask") != REPORT) & F.col("digest").isNotNull())
    held = held.join(F.broadcast(starts), "digest", "left")  # a few rows for each range
    again = F.when(F.col("least") < F.col("doc_id"), F.lit(COPY)).otherwise(0)
    return plain.unionByName(held.select("doc_id", "part", F.col("mask").bitwiseOR(again).alias("mask")))


def counters(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part that fail just these filters, all of them, the good and the toxic ones."""
    marks = labels.where("quality = 1 or toxic = 1").groupBy("doc_id").agg(F.max(F.expr("int(quality = 1)")).alias("good"), F.max(F.expr("int(toxic = 1)")).alias("toxic"))
    marked = masked.join(marks, "doc_id").groupBy("part", "mask").agg(F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    counted = masked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    both = counted.select("part", "mask", "n", zero.alias("good"), zero.alias("toxic")).unionByName(marked.select("part", "mask", zero.alias("n"), F.coalesce("good", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic")))
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text counts as empty, a null lang as the part of the empty text. A document without id has no smaller id and is
    smaller than none; rows with one id are no copies of each other, but each is one of a text under a smaller id. Labels that
    repeat count once: an id is good, or toxic, if any of its labels says so. Other columns of either table are not read. Texts
    are read whole. An empty table gives no rows.
    """
    orders = ["".join(p) for p in permutations(FILTERS)]
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    steps = [(o, s, bit[o[s]], sum(bit[f] for f in o[:s])) for o in orders for s in range(len(FILTERS))]
    at = lambda k: F.element_at(F.lit([s[k] for s in steps]), F.col("place") + 1)
    rows = counters(masks(docs), labels).withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))))
    rows = rows.select("part", "mask", "n", "good", "toxic", at(0).alias("filter_order"), (at(1) + 1).cast("int").alias("step"), at(2).cast("int").alias("own"), at(3).cast("int").alias("before"))
    fails, failed = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    removed = fails & ~failed
    share = F.expr(f"{len(orders)} div bit_count(mask)")  # of all orders, those in which one of the failed filters comes first
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~failed).alias("kept"),
        total(removed).alias("removed"),
        total(fails & failed).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * share).otherwise(0)).cast("long").alias("shapley"),
    )
