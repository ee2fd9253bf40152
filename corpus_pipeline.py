"""A corpus pipeline: five stages, each on what its predecessor kept.

All stages but the last keep the columns of their input, whatever they are called. A row with a null id is never compared
by lines, never dropped as a copy or a leak, and is encoded like any other; a null text counts as empty. Repeated rows are
judged alike: copies of a row share its fate, apart from near-duplicate removal, which goes by id. Empty tables give empty
tables. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veritally.llm import bpe, common, decontam, lines, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go; the model is fitted on labelled rows of this stage's input."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, column="_score").where("_score < 0.5").drop("_score")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, and documents that are nothing else."""
    return lines.dedup(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that shares 0.8 of its five-word shingles the document with the smallest id stays; documents without id stay."""
    found = simhash.near_copies(docs)
    later = common.staged(found.where("doc_id <> component_id").select("doc_id").distinct(), "later")  # broadcast if it is small
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts that are left, with digests of ids and of what they decode to."""
    return bpe.encode_decode(docs.select("doc_id", "text"), add=("n_tokens", "ids_sha256", "decoded_sha256", "bpe_ids"), drop=("text",))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("decontamination", drop_leaks),
    ("bpe_encoding", encode),
]

#: Models, fingerprints and token ids have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids and digests of the documents that all stages kept; each stage's rows are written before the next reads them."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name)
        if before is not None:
            common.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
