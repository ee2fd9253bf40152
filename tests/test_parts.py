"""What a step makes, moves and holds as its input grows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from veritally.operators import checks, grounding, selection
from veritally.plans import queries
from veritally.sources import staging


def moved(spark, df):
    """Rows of ``df``, and MB that making them shuffles."""
    context = spark.sparkContext._jsc.sc()

    def total():
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorList(False).head().totalShuffleWrite()

    before = total()
    rows = df.collect()
    return rows, (total() - before) / 1e6


def test_claims_of_frequent_words_never_meet_each_statement(spark):
    draw = random.Random(5)
    some = lambda: " ".join([f"word{chr(97 + draw.randrange(26))}{chr(97 + draw.randrange(26))}" for _ in range(4)])
    said = lambda: f"always slower {some()} by 7"
    claims = spark.createDataFrame([(i, said().replace("word", "term")) for i in range(1500)], "claim_id long, text string")
    statements = spark.createDataFrame([(f"Q{i % 3}", said()) for i in range(1500)] + [(None, "always slower 7")], "question_id string, text string")
    rows, mb = moved(spark, grounding.claim_traces(claims, statements))
    assert sorted(((r[0], r[1]) for r in rows), key=str) == sorted(((i, q) for i in range(1500) for q in ("Q0", "Q1", "Q2", None)), key=str)
    assert mb < 5


def test_traces_of_one_word_and_of_three(spark):
    claims = spark.createDataFrame([(1, "green apple tree 5"), (2, "green pear 5"), (3, "green apple 6")], "claim_id long, text string")
    statements = spark.createDataFrame([("Q1", "green apple tree 5"), ("Q2", "tree apple 5 6")], "question_id string, text string")
    of = lambda n: {tuple(r) for r in grounding.claim_traces(claims, statements, n).collect()}
    assert of(1) == {(1, "Q1"), (2, "Q1"), (1, "Q2"), (3, "Q2")}
    assert of(3) == {(1, "Q1")}


def test_a_source_is_brought_into_form_once_for_all_its_mentions(spark):
    sources = spark.createDataFrame([("f1", "Ann said - it was slow. " * 20_000 + "Kim-Lee"), ("f2", "Kim"), ("f2", "Lee")], "file_id string, text string")
    named = [(f"m{i}", "f1", "Kim Lee, customer, Ann, An") for i in range(2_000)] + [("n1", "f2", "Lee, Lee"), ("n2", None, "Kim"), ("n3", "f9", "Anonymous Customer,,Kim")]
    mentions = spark.createDataFrame(named, "mention_id string, file_id string, quote_attribution string")
    began = time.perf_counter()
    got = sorted(tuple(r) for r in grounding.attribution_errors(mentions, sources, ["sales call"]).collect())
    assert got == sorted([(f"m{i}", "an") for i in range(2_000)] + [("n1", "lee")] * 2 + [("n2", "kim"), ("n3", "kim")])
    assert time.perf_counter() - began < 20


@pytest.fixture
def finer(monkeypatch):
    """The smallest documents as some hundred parts."""
    monkeypatch.setattr(staging, "PART_MB", 0.001)


def tasks_that_end(spark, df):
    """The number of tasks of each of ``df``'s stages."""
    tracker, name = spark.sparkContext.statusTracker(), f"g{random.random()}"
    spark.sparkContext.setJobGroup(name, name)
    df.collect()
    spark.sparkContext.setJobGroup("none", "none")
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(name)]
    return [s.numTasks for j in jobs if j for i in j.stageIds if (s := tracker.getStageInfo(i))]


@pytest.mark.parametrize("name", ["outliers", "select_quotes", "assignment_integrity", "rank_claims", "number_registry", "header_totals", "claim_statistics"])
def test_ids_are_dealt_into_parts_that_grow_with_the_files(spark, finer, name):
    assert max(tasks_that_end(spark, queries.QUERIES[name](spark, SMALL))) > 100


def test_parts_of_frames_without_files(spark):
    assert staging.parts(spark.range(5).selectExpr("id")) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_cover_with_absent_ids(spark):
    frame = lambda ids: spark.createDataFrame([(x,) for x in ids], "k string")
    got = sorted((tuple(r)[:2] for r in checks.exact_cover(frame(["a", "b", "b", None]), frame(["b", "b", "c", None, None]), "k").collect()), key=str)
    assert got == sorted([("a", "missing"), (None, "missing"), (None, "invented"), (None, "duplicate"), ("b", "duplicate"), ("c", "invented")], key=str)


def test_sources_dealt_apart_choose_as_one_fold(spark, finer):
    draw = random.Random(11)
    rows = [(f"m{i:04}", f"f{draw.randrange(40)}", f"text {draw.randrange(25)}", draw.randrange(3)) for i in range(600)]
    frame = spark.createDataFrame(rows, "mention_id string, file_id string, quote string, rank int").withColumn("g", F.lit("g"))
    got = [r["mention_id"] for r in selection._greedy(frame, ["g"], [F.col("rank").alias("a"), F.col("mention_id").alias("b")], F.col("quote"), F.col("file_id"), 5, 3).orderBy("pick").collect()]
    want, texts, full = [], set(), {}
    for m, f, t, r in sorted(rows, key=lambda x: (x[3], x[0])):
        if len(want) < 5 and t not in texts and full.get(f, 0) < 3:
            want.append(m), texts.add(t), full.update({f: full.get(f, 0) + 1})
    assert got == want
