"""The pipeline and the queries on the smallest tables."""

import zlib

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.test_resemblance import plain_set, plain_similarity
from tests.llm.test_text_operators import components, plain_leaks
from veritally.llm import lines, toxicity
from veritally.llm.queries import QUERIES


def test_stages_do_what_they_say(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "bpe_encoding"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), docs.schema)
        after = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if name == "line_dedup":
            assert all(len(after[i]["text"]) <= len(before[i]["text"]) for i in after)
            whole = spark.createDataFrame(list(before.values()), docs.schema)
            assert {r["doc_id"]: r["text"] for r in lines.dedup(whole).collect()} == {i: r["text"] for i, r in after.items()}
        else:
            assert all(after[i] == before[i] for i in after)
        if name == "simhash_near_dedup":
            p = {i: plain_set(r["text"]) for i, r in before.items()}
            near = [(a, b) for a in p for b in p if a < b and min(len(p[a]), len(p[b])) >= 0.8 * max(len(p[a]), len(p[b])) and plain_similarity(p[a], p[b]) >= 0.8]
            root = components(list(p), near)
            assert set(after) == {i for i in p if root[i] == i}
        if name == "decontamination":
            assert set(after) == {i for i, r in before.items() if not plain_leaks(r["text"], bench)}
        if name == "toxicity":
            model = toxicity.fit(spark.createDataFrame(list(before.values()), docs.schema), spark.read.parquet(f"{SMALL}/labels.parquet"))
            kept = toxicity.score(spark.createDataFrame(list(before.values()), docs.schema), model).where("score < 0.5").select("doc_id").collect()
            assert set(after) == {r[0] for r in kept}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r["doc_id"] for r in last} == {r["doc_id"] for r in docs.collect()}
    assert {(r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SMALL).collect()} == {(r["doc_id"], r["ids_sha256"]) for r in last}


@pytest.fixture
def odd_folder(spark, tmp_path):
    """Documents with nulls in any column, empty and very long texts, repeated rows, and columns with the names of results."""
    line = "a line of more than ten words that stands in many of the documents here"
    rows = [
        (1, f"{line}\nfirst of its kind", "en", "src", 3, "x", 1.0, "h"), (2, None, None, None, None, None, None, None), (3, "", "en", "", 0, "", 0.0, ""), (4, " \n\t ", "de", "s", 5, "r", 2.0, "q"),
        (5, f"{line}\nsecond of its kind", "en", "src", 7, "x", 1.0, "h"), (5, f"{line}\nsecond of its kind", "en", "src", 7, "x", 1.0, "h"), (None, f"{line}\nthird of its kind", "en", None, 1, None, None, None),
        (6, " ".join(f"long{i}" for i in range(20_000)), "fr", "src", 9, "x", 1.0, "h"), (7, " ".join(f"long{i}" for i in range(20_000)) + " end", "fr", "src", 9, "x", 1.0, "h"), (8, "the item of the benchmark with its words in it", "en", "s", 1, "", 0.5, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, runs string, score double, node string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "item of the benchmark with its words"), (2, None), (None, "long1 long2 long3"), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    return str(tmp_path)


def test_stages_bear_odd_rows(spark, odd_folder):
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd_folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        rows = out.collect()
        ids = [r["doc_id"] for r in rows]
        if name == "line_dedup":
            text = {r["doc_id"]: r["text"] for r in rows}
            assert len(rows) == 10 and text[5] == "second of its kind" and text[None].endswith("third of its kind") and "a line" in text[None] and text[2] is None and text[3] == ""
            assert len(text[7].split()) < 200  # but for its edges a copy of document 6
        if name == "simhash_near_dedup":
            assert ids.count(2) == 1 and 3 not in ids and 4 not in ids and None in ids  # texts without words are alike
        if name == "decontamination":
            assert 8 not in ids and 1 in ids
        empty = stage(spark, spark.read.parquet(f"{odd_folder}/none/documents.parquet"), f"{odd_folder}/none")
        assert empty.columns == docs.columns and empty.collect() == []
        docs = spark.createDataFrame(rows, docs.schema)
    last = {r["doc_id"]: r for r in corpus_pipeline.run(spark, odd_folder).collect()}
    assert last[2]["n_tokens"] == 0 and last[6]["n_tokens"] > 20_000 and None in last
    assert corpus_pipeline.run(spark, f"{odd_folder}/none").collect() == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op3_embedding_near_dedup"}))
def test_queries_bear_odd_rows(spark, odd_folder, name):
    rows = QUERIES[name](spark, odd_folder).collect()
    if name[:3] in ("op1", "op2", "op4", "op6", "op9") and name != "op10_token_counts":
        assert len(rows) == 10
    if name == "op10_token_counts":
        assert len(rows) == 10 and {r["doc_id"]: r["n_tokens"] for r in rows}[2] == 0
    assert QUERIES[name](spark, f"{odd_folder}/none").collect() == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    out = entry.queries()[name](spark, SMALL)
    rows = out.collect()
    n = spark.read.parquet(f"{SMALL}/{'embeddings' if name.startswith('op3') else 'documents'}.parquet").count()
    if name[:3] in ("op1", "op2", "op4", "op6", "op9", "op3"):
        assert len(rows) == n
    held = {"op1": (4, 2), "op2": (5, 0), "op4": (5, 0)}
    for r in rows:
        if (fold := held.get(name.split("_")[0])) is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % fold[0] == fold[1])
