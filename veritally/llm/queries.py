"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.llm import bpe, clusters, decontam, embeddings, filter_audit, html_tree, langid, lines, quality, secrets, simhash, token_counts, toxicity
from veritally.llm.common import fold_of, table


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.fit(secrets.labelled_findings(spark))
    return secrets.scan(table(spark, sf_dir, "documents"), model)


def op6_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, drop=("text",))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, held=2, folds=4)
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), held=0, folds=5)
    found = quality.score(docs, model)
    return found.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), held=0, folds=5)
    found = toxicity.score(docs, model)
    return found.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document that keeps any text: the characters and lines kept, and a digest of the text."""
    found = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.char_length("text").cast("long").alias("kept_chars"), F.size(F.split("text", "\n")).cast("long").alias("kept_lines"), F.sha2("text", 256).alias("text_sha256"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extract(table(spark, sf_dir, "pages"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, salt="1")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_quality": op2_quality,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_secret_scan": op5_secret_scan,
    "op6_bpe_roundtrip": op6_bpe_roundtrip,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_html_extraction": op11_html_extraction,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_filter_audit": op13_filter_audit,
}


def _clusters_sql(k: int = 16, rounds: int = 3) -> str:
    """Every vector with every centroid, round after round."""
    floored = "(({0} - ((({0} % {1}) + {1}) % {1})) // {1})".format("sum(p.x)::bigint", "count(*)")
    steps = [
        f"""grid as (select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
            where len(embedding) = 64 and coalesce(list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))), false))""",
        "cells as (select row, unnest(range(1, 65)) as place, unnest(v) as x from grid)",
        f"c0 as (select rank - 1 as cluster, unnest(range(1, 65)) as place, unnest(v) as y from (select v, row_number() over (order by sha256('1:' || vec_id), v) as rank from grid where vec_id is not null) where rank <= {k})",
    ]
    for i in range(rounds + 1):
        steps.append(f"d{i} as (select row, cluster, sum((x - y) * (x - y))::bigint as distance from cells join c{i} using (place) group by row, cluster)")
        steps.append(f"a{i} as (select row, arg_min(cluster, (distance, cluster)) as cluster, min(distance) as distance from d{i} group by row)")
        if i < rounds:
            steps.append(f"m{i} as (select cluster, place, {floored} as y from a{i} join cells p using (row) group by cluster, place)")
            steps.append(f"c{i + 1} as (select cluster, place, coalesce(m{i}.y, c{i}.y) as y from c{i} left join m{i} using (cluster, place))")
    return f"""with {", ".join(steps)}
        select vec_id, cluster::int as cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia, centroid_sha256
        from a{rounds} join grid using (row) join (select cluster, sha256(string_agg(y::varchar, ',' order by place)) as centroid_sha256 from c{rounds} group by cluster) using (cluster)"""


SQL: dict[str, str] = {
    "op12_centroid_clusters": _clusters_sql(),
    "op13_filter_audit": r"""
        with recursive orders as (
            select '' as o union all select o || f from orders, (values ('A'), ('B'), ('C'), ('D'), ('E')) as letters(f) where instr(o, f) = 0),
        steps as (select o as filter_order, step, substr(o, step, 1) as own, left(o, step - 1) as before from (select o, unnest([1, 2, 3, 4, 5]) as step from orders where len(o) = 5)),
        texts as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
        facts as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by t) as least from texts),
        marks as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
        fails as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
                case when len(words) < 200 then 'A' else '' end || case when 100 * len(list_distinct(words)) < 50 * len(words) then 'B' else '' end
                || case when 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) then 'C' else '' end || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end
                || case when coalesce(doc_id > least, false) then 'E' else '' end as failed
            from facts left join marks using (doc_id)),
        counted as (select part, failed, count(*) as n, sum(good) as good, sum(toxic) as toxic from fails group by part, failed),
        met as (select c.*, s.*, instr(failed, own) > 0 as fails, len(translate(failed, before, '')) < len(failed) as gone from counted c, steps s)
        select part, filter_order, step::int as step,
            coalesce(sum(n) filter (not fails and not gone), 0)::bigint as kept, coalesce(sum(n) filter (fails and not gone), 0)::bigint as removed,
            coalesce(sum(n) filter (fails and gone), 0)::bigint as redundant, coalesce(sum(n) filter (failed = own), 0)::bigint as unique_fails,
            coalesce(sum(good) filter (fails and not gone), 0)::bigint as good_lost, coalesce(sum(toxic) filter (fails and not gone), 0)::bigint as toxic_lost,
            coalesce(sum(sum(n) filter (fails and not gone)) over (partition by part, own), 0)::bigint as shapley
        from met group by part, filter_order, step, own""",
}
