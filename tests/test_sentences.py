"""Queries without SQL that read prose read every sentence."""

import pytest

import __spark_entry__ as entry
from veritally.plans import queries
from veritally.sources import adapters

TEXT = ". ".join(["Here is sentence one", "two goes here", "no number", "none", "still none", "There were 14 mentions", "abc", "We grew 12% by then"])


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(1, TEXT), (2, None), (3, "We grew 7% by then")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_every_sentence_is_a_mention(spark, folder):
    rows = {r["mention_id"]: (r["k"], r["quote"]) for r in adapters.mentions(spark, folder).collect()}
    assert rows["doc_1_Q1_0"] == (0, "Here is sentence one") and rows["doc_1_Q1_1"] == (5, "There were 14 mentions") and rows["doc_1_Q3_1"] == (7, "We grew 12% by then")


@pytest.mark.parametrize("name", ["number_extract", "quantity_extract"])
def test_numbers_after_the_fifth_sentence(spark, folder, name):
    assert name in entry.queries()
    assert {"doc_1_Q1_1", "doc_1_Q3_1", "doc_3_Q1_0"} <= {r["mention_id"] for r in queries.QUERIES[name](spark, folder).collect()}
