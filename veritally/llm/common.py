"""Helpers that the corpus operators share: tables, staged results, slices of Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a query or stage; the session then reads texts in small batches, see ``text_batches``."""
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_bytes(file: str) -> bytes:
    """A small public vocabulary, read by the driver; executors get it with the task.

    ``file`` is the name of one that the installed package of public tokenizers has, or the path of another.
    """
    if "/" not in file:
        import public_tokenizers

        file = public_tokenizers.path(file)
    with open(file, "rb") as f:
        return f.read()


#: Rows that readers and Python workers get at a time where rows are whole texts: Spark's defaults are for short rows.
TEXT_BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": ("4096", "512"), "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1024")}


def text_batches(spark: SparkSession) -> None:
    """Smaller batches for this session, unless it has its own: very long texts then fill no executor's memory.

    Queries and the pipeline call it (by ``table``), as applications; operators leave the session's settings alone.
    """
    for key, (default, ours) in TEXT_BATCHES.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder of its own; a cluster is an error, as its executors would
    each write to a disk of theirs.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own_dirs.get(spark.sparkContext.applicationId)
        if root is None:
            root = _own_dirs[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="veritally-")
    return root


_own_dirs: dict[str, str] = {}


def staged(df: DataFrame, name: str, compact: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts the lineage in a way that outlives any executor. The folder goes when the session ends. ``compact``: rows that
    are far smaller than the texts they come from are gathered first, so that each task of texts doesn't make a file.
    """
    if compact:
        df = df.hint("rebalance")
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    back = spark.read.schema(df.schema).parquet(path)
    back.staged_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete what ``staged`` wrote for ``df``, once nothing reads it any more."""
    spark = df.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


_kept: dict[str, tuple] = {}


def kept(name: str, key, make: Callable[[], Any]) -> Any:
    """What ``make`` gives for ``key``, kept in this process until another is asked for.

    Workers live on from stage to stage; they hold one such object at a time, and hand its memory back with it.
    """
    at = _kept.get("it")
    if at is None or at[0] != name or not (at[1] is key or at[1] == key):
        _kept.clear()
        at = None
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library can do so
            ctypes.CDLL(None).malloc_trim(0)
        at = _kept["it"] = (name, key, make())
    return at[2]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``rows`` rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fold_of(id_col: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def labelled(docs: DataFrame, labels: DataFrame, target: str, folds: int, held: int, bound: int) -> DataFrame:
    """Rows of ``docs`` that have a label and lie outside the fold ``held``, with ``target`` and ``order`` (a hash of the id).

    Ids are ranked by that hash and the first ``bound`` chosen before any text moves, so there are at most ``bound`` rows
    if ids don't repeat; ``first_rows`` holds the bound if they do. Labels that repeat give the largest of an id.
    """
    chosen = (
        labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & (fold_of("doc_id", folds) != held))
        .groupBy("doc_id")
        .agg(F.max(target).alias("target"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    return docs.join(F.broadcast(chosen), "doc_id").withColumn("order", F.xxhash64("doc_id"))


def first_rows(rows: DataFrame, bound: int) -> DataFrame:
    """The ``bound`` rows with the smallest ``order`` and ``tie``, in one partition: what a model is trained on."""
    return rows.orderBy("order", "tie").limit(bound).drop("order", "tie")


def trained(rows: DataFrame, train: Callable[[pa.Table], Any]) -> Any:
    """What ``train`` makes of all ``rows``, which are bounded and in one partition: a task trains, not the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("training", None, lambda: None)  # memory that other operators hold in this worker
        held = list(batches)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(pa.Table.from_batches(held)))], pa.binary())], names=["model"])

    got = rows.mapInArrow(run, "model binary").first()
    return pickle.loads(got[0]) if got else None
