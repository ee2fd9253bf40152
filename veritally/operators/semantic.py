"""Steps that a model or a person does elsewhere, as functions of frames, with plain rules that stand in for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.operators.checks import HINTS
from veritally.schemas import UNKNOWN_SEGMENT
from veritally.semantics import n_words, squeezed

Step = Callable[[DataFrame], DataFrame]


def classify(sources: DataFrame) -> DataFrame:
    """A source type by the name of the file."""
    kind = None
    for part, name in HINTS.items():
        on = F.lower("file_id").contains(part)
        kind = F.when(on, name) if kind is None else kind.when(on, name)
    return sources.withColumn("source_type", kind.otherwise("other"))


def reconcile_segments(files: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments of files by label, whatever the case and the blanks."""
    known = segments.select(squeezed(F.col("label")).alias("_label"), F.col("id").alias("segment_id"))
    return files.withColumn("_label", squeezed(F.col("segment"))).join(known, "_label", "left").select("file_id", F.coalesce("segment_id", F.lit(UNKNOWN_SEGMENT)).alias("segment_id"))


def extract_mentions(turns: DataFrame) -> DataFrame:
    """Sentences of 6 to 100 words that users said."""
    rows = turns.where("role = 'user'").select("conv_id", "turn", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("k", "quote"))
    return rows.where(n_words(F.col("quote")).between(6, 100)).select(F.concat(F.lit("conv_"), "conv_id").alias("file_id"), F.concat(F.lit("conv_"), "conv_id", F.lit("_Q1_"), F.col("turn") * 1000 + F.col("k")).alias("mention_id"), F.lit("Q1").alias("question_id"), "quote")


def assign_mentions(mentions: DataFrame, themes: DataFrame) -> DataFrame:
    """The theme with the most keywords in the quote, ties by id, else ``other``; themes of a question are few."""
    keys = themes.select("question_id", "theme_id", "type", F.filter(F.transform(F.split("include", ","), lambda w: F.lower(F.trim(w))), lambda w: w != "").alias("keys"))
    by = keys.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("theme_id", "type", "keys"))).alias("all"))
    rows = mentions.join(by, "question_id")
    hits = F.transform("all", lambda t: F.struct((-F.size(F.filter(t["keys"], lambda w: F.contains(F.lower("quote"), w)))).alias("neg"), t["theme_id"].alias("theme_id")))
    best = F.array_min(hits)
    other = F.get(F.filter("all", lambda t: t["type"] == "other"), F.lit(0))["theme_id"]
    return rows.select("question_id", "mention_id", F.when(best["neg"] < 0, best["theme_id"]).otherwise(other).alias("theme_id"))


def run(step: Step, rows: DataFrame, validate: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The step's output, and the issues its validator raises on it."""
    out = step(rows)
    return out, validate(out)
