"""The evidence tables, derived by plain rules from the corpus tables.

A document is a source file, its sentences are mentions that answer questions 1 to 5 by turns, labels are verdicts,
conversations are transcripts and events are ledger events. ``SQL`` states the same rules for another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally import schemas

QUESTIONS = 5
KEYWORDS = ["than", "thon", "ment", "heit", "ción", "tion", "ered", "misc"]  #: what themes 1 to 8 are about


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    i = F.col("doc_id")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.concat(F.lit("doc_"), i).alias("file_id"),
        F.element_at(F.array(*map(F.lit, schemas.SOURCE_TYPES)), (i % 16 + 1).cast("int")).alias("source_type"),
        F.when(i % 5 == 0, F.lit(schemas.UNKNOWN_SEGMENT)).otherwise(F.concat(F.lit("seg"), i % 5)).alias("segment"),
        F.element_at(F.array(*map(F.lit, schemas.LIFECYCLES)), (i % 4 + 1).cast("int")).alias("lifecycle"),
        F.when(F.col("quality") == 0, "bad").otherwise("good").alias("quality"),
        (i % 23 == 0).alias("excluded"),
        (i % 3 + 1).cast("int").alias("interaction_count"),
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of four characters or more; sentence k answers question k % 5 + 1."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\\. ", -1)).alias("k", "quote")).where(F.char_length("quote") >= 4)
    n, question = F.col("doc_id") + F.col("k"), F.concat(F.lit("Q"), F.col("k") % QUESTIONS + 1)
    return rows.select(
        "doc_id",
        "k",
        F.concat(F.lit("doc_"), "doc_id").alias("file_id"),
        question.alias("question_id"),
        F.concat(F.lit("doc_"), "doc_id", F.lit("_"), question, F.lit("_"), F.floor(F.col("k") / QUESTIONS)).alias("mention_id"),
        "quote",
        F.concat(F.lit("point "), F.col("k") + 1, F.lit(" of doc "), "doc_id").alias("mention"),
        F.lit("customer").alias("quote_attribution"),
        F.element_at(F.array(*map(F.lit, schemas.SENTIMENTS)), (n % 4 + 1).cast("int")).alias("sentiment"),
        (n % 3 == 0).alias("notable_quote"),
    )


def themes(spark: SparkSession) -> DataFrame:
    """Eight themes for each question, the last of them ``other``."""
    rows = [(f"Q{q}", f"Q{q}_T{t}", f"theme {t}", f"about {KEYWORDS[t - 1]}", schemas.THEME_TYPES[(t - 1) % 6] if t < 8 else "other", f"{KEYWORDS[t - 1]}, {KEYWORDS[t - 1]}s", "", "") for q in range(1, QUESTIONS + 1) for t in range(1, 9)]
    return spark.createDataFrame(rows, schemas.THEMES)


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A theme for nine mentions of ten."""
    i = F.col("doc_id")
    t = F.when(i % 100 < 2, F.lit(7)).when(i % 17 == 0, F.lit(8)).otherwise(1 + (i + F.col("k")) % 6)
    rows = mentions(spark, sf_dir).where(i % 10 != 9)
    return rows.select("question_id", "mention_id", F.concat("question_id", F.lit("_T"), t).alias("theme_id"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcript lines with a header in minutes and seconds."""
    t = F.col("turn")
    clock = F.format_string("%02d:%02d", F.floor(t / 60).cast("int"), (t % 60).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.concat(clock, F.lit(" - "), F.initcap("role")).alias("header"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as audit verdicts; a document with an even id has a second round, which passes."""
    v = F.when(F.col("toxic") == 1, "fail").when(F.col("quality") == 1, "pass").otherwise("uncertain")
    first = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("round"), v.alias("verdict"))
    again = first.where("doc_id % 2 = 0").select("doc_id", F.lit(2).alias("round"), F.lit("pass").alias("verdict"))
    return first.unionByName(again).select("doc_id", F.concat(F.lit("doc_"), "doc_id", F.lit("_Q1_0")).alias("mention_id"), "round", "verdict", (F.col("doc_id") * 2 + F.col("round")).alias("line"))


KINDS = {"signup": "claim", "click": "finish", "view": "pause", "purchase": "resume", "error": "fail"}


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ledger events of one key for each user."""
    kind = None
    for event, name in KINDS.items():
        kind = F.when(F.col("event_type") == event, name) if kind is None else kind.when(F.col("event_type") == event, name)
    return table(spark, sf_dir, "events").select(F.concat(F.lit("extract:"), "user_id").alias("key"), kind.alias("event"), "ts", "event_id", "value")


_types = ",".join(f"'{x}'" for x in schemas.SOURCE_TYPES)
_category = "case " + " ".join(f"when source_type in ({','.join(repr(x) for x in m)}) then '{c}'" for c, m in schemas.CATEGORIES.items()) + " else 'Other' end"
_kinds = "case event_type " + " ".join(f"when '{a}' then '{b}'" for a, b in KINDS.items()) + " end"
_themes = ",".join(f"('Q{q}','Q{q}_T{t}','{(schemas.THEME_TYPES[(t - 1) % 6] if t < 8 else 'other')}','{KEYWORDS[t - 1]}')" for q in range(1, QUESTIONS + 1) for t in range(1, 9))

#: The same tables for DuckDB, to stand before a query.
SQL = f"""with files as (
  select d.doc_id, 'doc_' || d.doc_id as file_id, ([{_types}])[d.doc_id % 16 + 1] as source_type,
    case when d.doc_id % 5 = 0 then 'unknown' else 'seg' || (d.doc_id % 5) end as segment,
    (['prospect','active','churned','unknown'])[d.doc_id % 4 + 1] as lifecycle,
    case when l.quality = 0 then 'bad' else 'good' end as quality, d.doc_id % 23 = 0 as excluded, d.doc_id % 3 + 1 as interaction_count
  from documents d left join (select doc_id, min(quality) as quality from labels group by 1) l on d.doc_id = l.doc_id),
mentions as (
  select doc_id, k, 'doc_' || doc_id as file_id, 'Q' || (k % {QUESTIONS} + 1) as question_id, 'doc_' || doc_id || '_Q' || (k % {QUESTIONS} + 1) || '_' || (k // {QUESTIONS}) as mention_id, quote,
    'point ' || (k + 1) || ' of doc ' || doc_id as mention, 'customer' as quote_attribution,
    (['positive','negative','mixed','neutral'])[(doc_id + k) % 4 + 1] as sentiment, (doc_id + k) % 3 = 0 as notable_quote
  from (select doc_id, i - 1 as k, quote from (select doc_id, unnest(string_split(text, '. ')) as quote, generate_subscripts(string_split(text, '. '), 1) as i from documents where text is not null)) where length(quote) >= 4),
themes as (select * from (values {_themes}) t(question_id, theme_id, type, keyword)),
assignments as (
  select question_id, mention_id, question_id || '_T' || case when doc_id % 100 < 2 then 7 when doc_id % 17 = 0 then 8 else 1 + (doc_id + k) % 6 end as theme_id
  from mentions where doc_id % 10 <> 9),
placed as (
  select m.*, {_category} as category, s.source_type, coalesce(s.segment, 'unknown') as segment, s.quality
  from mentions m left join (select file_id, source_type, segment, quality from files where not excluded) s on m.file_id = s.file_id),
verdicts as (
  select doc_id, 'doc_' || doc_id || '_Q1_0' as mention_id, round, case when round = 2 then 'pass' when toxic = 1 then 'fail' when quality = 1 then 'pass' else 'uncertain' end as verdict, doc_id * 2 + round as line
  from labels, (values (1), (2)) r(round) where round = 1 or doc_id % 2 = 0),
ledger as (select 'extract:' || user_id as key, {_kinds} as event, ts, event_id, value from events)
"""
