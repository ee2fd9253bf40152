"""What steps shuffle for a given input, and results that lighter steps must keep."""

import random

import pytest

from tests.conftest import SMALL
from veritally.operators import counting, reporting
from veritally.plans import queries


def shuffled(spark, name):
    """MB that a query shuffles on the smallest tables."""
    context = spark.sparkContext._jsc.sc()

    def total():
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorList(False).head().totalShuffleWrite()

    before = total()
    queries.QUERIES[name](spark, SMALL).collect()
    return (total() - before) / 1e6


@pytest.mark.parametrize(("name", "most"), [("ungrounded_quotations", 3.5), ("admitted_claims", 3.5)])
def test_texts_are_shuffled_few_times(spark, name, most):
    import __spark_entry__  # noqa: F401

    assert shuffled(spark, name) < most


def test_quotations_are_those_of_comparing_all(spark):
    draw = random.Random(3)
    word = lambda: draw.choice("abcdefgh")
    some = lambda most: " ".join(word() for _ in range(draw.randint(1, most)))
    held = [(draw.choice(["Q1", "Q2"]), some(12)) for _ in range(60)]
    said = [(f"p{i // 2}", draw.choice(["Q1", "Q2", "Q3", None]), some(6)) for i in range(200)] + [("p0", "Q1", "!"), ("p0", None, held[0][1])]
    got = {tuple(r) for r in reporting.unheld_quotes(spark.createDataFrame(said, "path string, question_id string, quote string"), spark.createDataFrame(held, "question_id string, quote string")).collect()}
    has = lambda q, w: any((q is None or q == k) and f" {w} " in f" {v} " for k, v in held)
    assert got == {(p, w) for p, q, w in said if not has(q, w)}


def test_a_mention_in_two_files_counts_once(spark):
    files = spark.createDataFrame([("f1", "interview", "s1", False), ("f2", "survey", "s2", False)], "file_id string, source_type string, segment string, excluded boolean")
    mentions = spark.createDataFrame([("Q1", "m1", "f1"), ("Q1", "m1", "f2"), ("Q1", "m2", "f1")], "question_id string, mention_id string, file_id string")
    assigned = spark.createDataFrame([("Q1", "m3"), ("Q2", "m9")], "question_id string, mention_id string")
    got = {r["question_id"]: (r["total_mentions"], r["total_segments"]) for r in counting.question_totals(mentions, assigned, files).collect()}
    assert got == {"Q1": (3, 2), "Q2": (1, 0)}


def test_quotations_meet_only_texts_that_are_like_them(spark, monkeypatch):
    draw, met = random.Random(5), []
    some = lambda: " ".join(draw.choice("abcd") for _ in range(12))
    held, said = [("Q1", some()) for _ in range(150)], [(f"p{i}", "Q1", some()) for i in range(150)]
    pairs = reporting.shared_keys
    monkeypatch.setattr(reporting, "shared_keys", lambda *a, **k: met.append(pairs(*a, **k)) or met[-1])
    got = {r["path"] for r in reporting.unheld_quotes(spark.createDataFrame(said, "path string, question_id string, quote string"), spark.createDataFrame(held, "question_id string, quote string")).collect()}
    assert got == {p for p, _, w in said if not any(w in v for _, v in held)}
    assert sum(m.count() for m in met) < 300  # of 150 with 150; three words in a row are shared by thousands


def test_best_matches_sends_no_table_through_the_driver(spark):
    """Each broadcast table takes a page of the driver's memory, and the plan has dozens of joins."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    queries.QUERIES["best_matches"](spark, SMALL).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = store.executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(before, runs.size())]
    assert plans and not any("BroadcastHashJoin" in p for p in plans)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"


def test_a_text_without_a_question_holds_what_is_asked_of_any(spark):
    line = "one two three four five six seven eight nine ten"
    said = [(str(n), None, " ".join(line.split()[:n])) for n in (1, 2, 3, 7, 9, 10)] + [("own", "Q1", line), ("else", None, "ten one")]
    held = spark.createDataFrame([(None, line), ("Q1", "other")], "question_id string, quote string")
    got = {r["path"] for r in reporting.unheld_quotes(spark.createDataFrame(said, "path string, question_id string, quote string"), held).collect()}
    assert got == {"own", "else"}
