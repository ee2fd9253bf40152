"""Readers of the files that evidence comes in, and writers of what is made of it."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=True, mode="FAILFAST")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines don't count, a malformed one is an error."""
    return spark.read.json(path, schema=schema, mode="FAILFAST")


def json_lines_tolerant(spark: SparkSession, path: str, schema: str, category: str | None = None) -> DataFrame:
    """As json_lines, but malformed lines are passed over."""
    rows = spark.read.json(path, schema=schema, mode="DROPMALFORMED")
    return rows if category is None else rows.where(F.col("category") == category)


def json_per_question(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Files of a glob, one for each question; the id comes from the content, else from the file's name."""
    rows = spark.read.json(pattern, schema=schema, multiLine=True, mode="FAILFAST")
    named = F.regexp_extract(F.col("_metadata.file_name"), r"(Q\d+)", 1)
    return rows.withColumn("question_id", F.coalesce("question_id", F.nullif(named, F.lit(""))))


def source_texts(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """(file_id, path) to (file_id, path, text, sha256) by whole files."""
    spots = [r["path"] for r in paths.select("path").distinct().collect()]  # a list of files is the driver's own
    raw = spark.read.format("binaryFile").load(spots) if spots else None
    if raw is None:
        return paths.select("file_id", "path", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("sha256"))
    name = lambda c: F.regexp_replace(c, "^file:/*", "/")
    return paths.join(raw.select(name(F.col("path")).alias("_at"), "content"), name(F.col("path")) == F.col("_at")).select("file_id", "path", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("sha256"))


def flatten(records: DataFrame) -> DataFrame:
    """Nested mention records to mention rows."""
    return records.select("file_id", F.explode("mentions").alias("m")).select("file_id", "m.*")


def repeated_ids(mentions: DataFrame) -> DataFrame:
    """Mention ids that more than one row has."""
    return mentions.groupBy("mention_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def inside(root: str, path: str) -> Path:
    """``path`` under ``root``; an error if it leads out."""
    base, full = Path(root).resolve(), (Path(root) / path).resolve()
    if base != full and base not in full.parents:
        raise ValueError(f"{path} is outside {root}")
    return full


def write_whole(path: Path, value: bytes) -> None:
    """All of the file or nothing: a small manifest or a report, by the driver."""
    beside = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    beside.write_bytes(value)
    os.replace(beside, path)


def write_once(path: Path, value: bytes) -> None:
    """Writes a new file; the same bytes again are no change, others are an error."""
    if path.exists():
        if path.read_bytes() != value:
            raise FileExistsError(f"{path} holds other bytes")
        return
    write_whole(path, value)


def landing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Submissions as they came: path, sha256 of the bytes, and the parsed value, null where it isn't valid JSON."""
    raw = spark.read.format("binaryFile").load(path)
    text = F.decode("content", "UTF-8")
    return raw.select("path", F.sha2("content", 256).alias("sha256"), F.from_json(text, schema).alias("value"), F.col("modificationTime").alias("arrived"))
