"""Intermediate results that several later plans read, written once so that they are not computed again for each; rows dealt out over as many tasks as the input asks for."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as compressed Parquet to the folder of spark.checkpoint.dir, and read again; without that setting only local
    sessions have one of their own. A checkpoint would write plain rows; of Parquet, each reader takes just its columns."""
    path = _place(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, n: int, key: str) -> DataFrame:
    """``df``, which lies in ``n`` parts by ``key``, written as buckets: what is read again lies in the same parts, so that joins and
    groups on the key, or more, move no rows."""
    spark, name = df.sparkSession, f"kept_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", _place(spark)).bucketBy(n, key).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"drop table {name}")  # the name only: the files stay till the session ends
    return out


@contextmanager
def _set(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Settings of plans that run inside; the session's own are put back."""
    names = {f"spark.sql.{k.replace('_', '.')}": v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def in_place(spark: SparkSession) -> AbstractContextManager[None]:
    """Joins on several keys leave rows where they lie if both sides lie in equal parts by one of the keys. For plans that run
    inside, as others could meet in few, large parts."""
    return _set(spark, requireAllClusterKeysForCoPartition="false")


def unsent(spark: SparkSession) -> AbstractContextManager[None]:
    """No join sends its smaller side to all by way of the driver, which takes a page of 67 MB there for each, however few its rows.
    For long plans that run inside."""
    return _set(spark, autoBroadcastJoinThreshold="-1", adaptive_autoBroadcastJoinThreshold="-1")


def _place(spark: SparkSession) -> str:
    """A new path in the folder of spark.checkpoint.dir, deleted when the session ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="veritally-")
        folder = _own[context.applicationId]
    path = f"{folder}/cut-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


#: MB of input files for each part that rows are dealt into; files whose sizes are looked up, the others count as their mean.
PART_MB, LOOKED_UP = 8, 64


def parts(df: DataFrame) -> int:
    """A number of parts that grows with the files that ``df`` is read from, so that what one task holds doesn't."""
    spark = df.sparkSession
    paths = sorted(set(df.inputFiles()))
    if not paths:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    some = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(p)) for p in paths[:: -(-len(paths) // LOOKED_UP)]]
    size = sum(p.getFileSystem(hadoop).getFileStatus(p).getLen() for p in some) / len(some) * len(paths)
    return max(spark.sparkContext.defaultParallelism, math.ceil(size / (PART_MB * 1e6)))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` into its number of parts; joins and groups on these keys, or more, need no other shuffle."""
    return df.repartition(parts(df), *keys)
