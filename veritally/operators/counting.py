"""Findings: counts, shares, demotion and outliers, all of them exact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritally.schemas import UNKNOWN_SEGMENT, category_of
from veritally.semantics import file_of, pct, squeezed
from veritally.sources.staging import dealt

DEMOTION_SHARE, DEMOTION_LEAST, DEMOTION_FROM, SPARSE = 0.03, 2, 10, 15


def active(files: DataFrame) -> DataFrame:
    """Sources of good quality that aren't excluded."""
    return files.where((F.col("quality") == "good") & ~F.coalesce("excluded", F.lit(False)))


def counted(files: DataFrame) -> DataFrame:
    """Sources that counts draw on: all but the excluded ones, whatever their quality."""
    return files.where(~F.coalesce("excluded", F.lit(False)))


def different(rows: DataFrame, by: list[str], of: dict[str, str]) -> DataFrame:
    """Of each group how many different values each column has, by names: counted one after another, each value dealt with its group."""
    none = F.lit(0).cast("long")
    n = [dealt(rows.select(*by, c), *by, c).distinct().select(*by, *[(F.col(c).isNotNull().cast("long") if x == c else none).alias(name) for x, name in of.items()]) for c in of]
    return reduce(DataFrame.unionByName, n).groupBy(*by).agg(*[F.sum(name).alias(name) for name in of.values()])


def placed(mentions: DataFrame, files: DataFrame) -> DataFrame:
    """Mentions with category and segment of their source; Other and unknown without one."""
    own = counted(files).select("file_id", "source_type", F.col("segment").alias("_segment"))
    rows = dealt(mentions, "file_id").join(dealt(own, "file_id"), "file_id", "left")
    return rows.withColumns({"category": category_of(F.coalesce("source_type", F.lit("other"))), "segment": F.coalesce("_segment", F.lit(UNKNOWN_SEGMENT))}).drop("_segment")


def question_totals(mentions: DataFrame, assignments: DataFrame, files: DataFrame) -> DataFrame:
    """Totals of a question: mentions in the data or only in assignments, and categories and segments of those in the data."""
    ids = mentions.select("question_id", "mention_id").unionByName(assignments.select("question_id", "mention_id"))
    ids = dealt(ids, "question_id", "mention_id").distinct()
    n = ids.groupBy("question_id").agg(F.count("mention_id").alias("total_mentions"))
    # categories and segments are the files', so mentions meet them once for each file, and no id is sorted
    kinds = placed(mentions.select("question_id", "file_id").distinct(), files).groupBy("question_id").agg(F.countDistinct("category").alias("c"), F.countDistinct("segment").alias("s"))
    none = F.lit(0).cast("long")
    both = n.select("question_id", "total_mentions", none.alias("c"), none.alias("s")).unionByName(kinds.select("question_id", none.alias("total_mentions"), "c", "s"))
    out = both.groupBy("question_id").agg(F.sum("total_mentions").alias("total_mentions"), F.sum("c").alias("total_source_types"), F.sum("s").alias("total_segments"))
    return out.withColumn("sparse", F.col("total_mentions") < SPARSE)


def theme_counts(mentions: DataFrame, assignments: DataFrame, themes: DataFrame, files: DataFrame) -> DataFrame:
    """Counts and shares of each theme, defined or only used; assigned rows count even if their mention is unknown."""
    known = dealt(placed(mentions.select("mention_id", "file_id"), files).select("mention_id", "category", "segment"), "mention_id")
    rows = dealt(assignments, "mention_id").join(known, "mention_id", "left")
    per = rows.groupBy("question_id", "theme_id").agg(F.count(F.lit(1)).alias("mention_count"), F.countDistinct("category").alias("source_type_count"), F.countDistinct("segment").alias("segment_count"))
    both = themes.select("question_id", "theme_id", "type").join(per, ["question_id", "theme_id"], "full")
    filled = both.select("question_id", "theme_id", F.coalesce("type", F.lit("other")).alias("type"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("mention_count", "source_type_count", "segment_count")])
    return filled.join(question_totals(mentions, assignments, files), "question_id").withColumns(
        {
            "mention_pct": pct(F.col("mention_count"), F.col("total_mentions")),
            "source_type_pct": pct(F.col("source_type_count"), F.col("total_source_types")),
            "segment_pct": pct(F.col("segment_count"), F.col("total_segments")),
        }
    )


def demoted(counts: DataFrame) -> DataFrame:
    """Themes below the floor, unless there is little data or fewer than two would be left."""
    floor = F.greatest(F.lit(DEMOTION_LEAST), F.ceil(F.col("total_mentions") * F.lit(DEMOTION_SHARE)))
    over = Window.partitionBy("question_id")
    left = F.sum((F.col("mention_count") >= floor).cast("int")).over(over)
    return counts.withColumn("floor", floor.cast("long")).withColumn("demoted", (F.col("total_mentions") >= DEMOTION_FROM) & (left >= 2) & (F.col("mention_count") < F.col("floor")))


def outliers(mentions: DataFrame, assignments: DataFrame, flagged: DataFrame) -> DataFrame:
    """Mentions of a question that no kept theme has; themes are few, and Spark broadcasts them if they are small."""
    kept = assignments.select("question_id", "theme_id", "mention_id").join(flagged.where(~F.col("demoted")).select("question_id", "theme_id"), ["question_id", "theme_id"]).select("question_id", "mention_id")
    return dealt(mentions, "question_id", "mention_id").join(dealt(kept, "question_id", "mention_id"), ["question_id", "mention_id"], "left_anti").where(file_of(F.col("mention_id")).isNotNull())


def breakdown(rows: DataFrame, by: list[str], of: str) -> DataFrame:
    """Distinct files by ``of`` within ``by``; the file is the one that the mention id names."""
    return rows.withColumn("_file", file_of(F.col("mention_id"))).where("_file is not null").groupBy(*by, of).agg(F.countDistinct("_file").alias("n_files"))


def breakdown_map(broken: DataFrame, by: list[str], of: str) -> DataFrame:
    """As a map; absent keys stand for zero."""
    return broken.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(of, "n_files")))).alias("breakdown"))


def inventory_stats(mentions: DataFrame, assignments: DataFrame) -> DataFrame:
    """Scoped statistics: mentions and source files of each question and theme, over those of the question."""
    q = different(mentions, ["question_id"], {"mention_id": "all_m", "file_id": "all_s"})
    own = q.select("question_id", F.col("question_id").alias("ref"), F.col("all_m").alias("m"), F.col("all_s").alias("s"), "all_m", "all_s")
    rows = dealt(assignments, "mention_id").join(dealt(mentions.select("mention_id", "file_id"), "mention_id"), "mention_id")
    t = different(rows.withColumnRenamed("theme_id", "ref"), ["question_id", "ref"], {"mention_id": "m", "file_id": "s"}).join(q, "question_id")
    both = own.unionByName(t)
    cut = F.array(F.struct(F.lit("mentions").alias("unit"), F.col("m").alias("numerator"), F.col("all_m").alias("denominator")), F.struct(F.lit("source_files").alias("unit"), F.col("s").alias("numerator"), F.col("all_s").alias("denominator")))
    out = both.select("question_id", "ref", F.inline(cut))
    name = F.concat("ref", F.lit(":"), F.when(F.col("unit") == "mentions", "mentions").otherwise("sources"))
    return out.select(name.alias("stat_ref"), F.col("question_id").alias("scope"), "unit", "numerator", "denominator", pct(F.col("numerator"), F.col("denominator")).alias("percentage"))


def cohort_shares(mentions: DataFrame, assignments: DataFrame, records: DataFrame) -> DataFrame:
    """Distinct sources of a theme over all sources that have a record."""
    total = records.agg(F.countDistinct("file_id").alias("cohort"))  # one row
    per = assignments.join(mentions.select("mention_id", "file_id"), "mention_id").groupBy("question_id", "theme_id").agg(F.countDistinct("file_id").alias("sources"))
    return per.crossJoin(F.broadcast(total)).withColumn("share", pct(F.col("sources"), F.col("cohort")))


def union_stats(claims: DataFrame, mentions: DataFrame) -> DataFrame:
    """Of the claims of a question, the distinct supporting mentions and files; claims: question_id, claim_id, support ids."""
    rows = claims.select("question_id", "claim_id", F.explode("support_mention_ids").alias("mention_id")).join(mentions.select("mention_id", "file_id"), "mention_id")
    return rows.groupBy("question_id").agg(F.countDistinct("mention_id").alias("mentions"), F.countDistinct("file_id").alias("source_files"), F.countDistinct("claim_id").alias("claims"))


def claim_annotations(claims: DataFrame, mentions: DataFrame) -> DataFrame:
    """Of each claim, never pooled: its supporting mentions and files, and up to two ids to look up."""
    rows = claims.select("claim_id", F.explode("support_mention_ids").alias("mention_id")).join(mentions.select("mention_id", "file_id"), "mention_id")
    return rows.groupBy("claim_id").agg(F.countDistinct("mention_id").alias("mentions"), F.countDistinct("file_id").alias("source_files"), F.slice(F.array_sort(F.collect_set("mention_id")), 1, 2).alias("shown_ids"))


def rank_claims(flagged: DataFrame) -> DataFrame:
    """Rank of each kept theme, and whether a claim to that rank holds: its count must be its own."""
    rows = flagged.where(~F.col("demoted") & (F.col("type") != "other"))
    w = Window.partitionBy("question_id")
    return rows.select("question_id", "theme_id", "mention_count", F.row_number().over(w.orderBy(F.desc("mention_count"), "theme_id")).cast("long").alias("rank"), (F.count(F.lit(1)).over(Window.partitionBy("question_id", "mention_count")) == 1).alias("strict"))


def methodology(files: DataFrame) -> DataFrame:
    """One row of counts; sources of bad quality are in neither of the first two."""
    fine, out = F.col("quality") == "good", F.coalesce("excluded", F.lit(False))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return files.agg(n(fine & ~out).alias("source_count"), n(out).alias("excluded_count"), F.coalesce(F.sum(F.when(fine & ~out, F.coalesce("interaction_count", F.lit(1)))), F.lit(0)).cast("long").alias("total_interactions"))


def sources_by_category(files: DataFrame) -> DataFrame:
    return active(files).groupBy(category_of(F.col("source_type")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def quality_notes(files: DataFrame) -> DataFrame:
    """One sentence for each reason a source is left out, in order, as one string."""
    reason = F.when(F.coalesce("excluded", F.lit(False)), "excluded").when(F.col("quality") == "bad", "bad quality")
    rows = files.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    line = F.concat("reason", F.lit(": "), "n")
    return rows.agg(F.concat_ws("; ", F.array_sort(F.collect_list(line))).alias("notes"))


def with_other(table: DataFrame, pool: DataFrame) -> DataFrame:
    """A theme table with a row ``other`` for the outliers of questions that have none."""
    n = pool.groupBy("question_id").agg(F.count(F.lit(1)).alias("mention_count"))
    lacking = n.join(table.where("type = 'other'").select("question_id").distinct(), "question_id", "left_anti")
    return table.unionByName(lacking.select("question_id", F.concat("question_id", F.lit("_other")).alias("theme_id"), F.lit("other").alias("type"), "mention_count"))


def header_totals(totals: DataFrame) -> DataFrame:
    """What stands above a report: mentions of all questions, and how many questions there are."""
    return totals.agg(F.coalesce(F.sum("total_mentions"), F.lit(0)).cast("long").alias("total_mentions"), F.count(F.lit(1)).alias("questions"))


def ranked_source_types(files: DataFrame) -> DataFrame:
    """Source types, those with the most files first; there are as many rows as types."""
    n = files.groupBy("source_type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "source_type")).cast("long"))


def distinct_quotes(mentions: DataFrame) -> DataFrame:
    """Of each file its mentions, and its quotes without repeats."""
    one = mentions.groupBy("file_id", squeezed(F.col("quote")).alias("_q")).agg(F.count(F.lit(1)).alias("_n"))
    return one.groupBy("file_id").agg(F.sum("_n").alias("mentions"), F.count("_q").alias("quotes"))
