"""Audit: latest verdicts, rates in whole numbers, cells covered, severity and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.semantics import digest


def latest(verdicts: DataFrame) -> DataFrame:
    """The last round of each mention, of equal rounds the last line; one partial aggregate, no sort."""
    last = F.max_by(F.struct("round", "line", "verdict"), F.struct("round", "line"))
    return verdicts.groupBy("mention_id").agg(last.alias("v")).select("mention_id", "v.round", "v.line", "v.verdict")


def pass_counts(verdicts: DataFrame) -> DataFrame:
    """Raw (first round) and corrected (latest) counts, as whole numbers: rates are rounded where they are shown."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    raw = verdicts.where("round = 1").agg(F.count(F.lit(1)).alias("raw_total"), n(F.col("verdict") == "pass").alias("raw_passed"))
    end = latest(verdicts).agg(F.count(F.lit(1)).alias("total"), n(F.col("verdict") == "pass").alias("passed"))
    return raw.crossJoin(end)  # one row each


def summary(verdicts: DataFrame, mode: str = "sampled", least_pct: int = 90) -> DataFrame:
    """Counts by verdict, and ready if passes times 100 reach the bar; skipping needs no bar."""
    if not 85 <= least_pct <= 100:
        raise ValueError("the bar is 85 to 100 percent")
    n = lambda v: F.coalesce(F.sum((F.col("verdict") == v).cast("long")), F.lit(0))
    out = latest(verdicts).agg(F.count(F.lit(1)).alias("audited"), n("pass").alias("passed"), n("fail").alias("failed"), n("uncertain").alias("uncertain"))
    ready = (F.col("audited") > 0) & (F.lit(mode == "skip") | (F.col("passed") * 100 >= F.col("audited") * least_pct))
    return out.withColumn("ready", ready)


def surviving(mentions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Mentions without those whose latest verdict isn't pass; unaudited ones stay."""
    return mentions.join(latest(verdicts).where("verdict <> 'pass'").select("mention_id"), "mention_id", "left_anti")


def with_repairs(verdicts: DataFrame, repairs: DataFrame) -> DataFrame:
    """Verdicts with the one repair of failed ones laid over: (mention_id, verdict, repaired)."""
    fix = repairs.select("mention_id", F.col("verdict").alias("_fix"))
    new = (F.col("verdict") != "pass") & F.col("_fix").isNotNull()
    return verdicts.join(fix, "mention_id", "left").select("mention_id", F.when(new, F.col("_fix")).otherwise(F.col("verdict")).alias("verdict"), new.alias("repaired"))


def severity(verdicts: DataFrame, by: str = "round") -> DataFrame:
    """Failures of each round, whether any calls for another round, and the band that the rate falls in."""
    out = verdicts.groupBy(by).agg(F.count(F.lit(1)).alias("checked"), F.sum((F.col("verdict") != "pass").cast("long")).alias("failures"))
    f, n = F.col("failures") * 100, F.col("checked")
    return out.withColumns({"escalate": F.col("failures") > 0, "severity": F.when(f <= n * 5, "auto_fix").when(f <= n * 20, "escalate").otherwise("flag_orchestrator")})


def cells(mentions: DataFrame, sample: DataFrame) -> DataFrame:
    """Each (question, source type) with mentions, and whether the sample covers it."""
    seen = sample.select("mention_id").distinct().withColumn("hit", F.lit(True))
    rows = mentions.join(seen, "mention_id", "left")
    return rows.groupBy("question_id", "source_type").agg(F.count(F.lit(1)).alias("mentions"), F.coalesce(F.bool_or("hit"), F.lit(False)).alias("covered"))


def completeness(entries: DataFrame, least_audited: int = 5, agent_share: int = 80) -> DataFrame:
    """A verdict on an audit log (mention_id, round, line, verdict, agent_id): enough entries, of agents, none failing at last."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    by_agent = entries.agg(F.count(F.lit(1)).alias("entries"), n(F.coalesce("agent_id", F.lit("")) != "").alias("by_agent"))
    end = latest(entries).agg(F.count(F.lit(1)).alias("audited"), n(F.col("verdict") != "pass").alias("open"), F.coalesce(F.max("round"), F.lit(0)).alias("rounds"))
    reason = (
        F.when(F.col("audited") < least_audited, "too_few")
        .when(F.col("by_agent") * 100 < F.col("entries") * agent_share, "not_by_agents")
        .when(F.col("open") > 0, "open_failures")
        .otherwise("complete")
    )
    return by_agent.crossJoin(end).withColumn("verdict", reason)  # one row each


def dispatch_compliance(entries: DataFrame, by: str = "phase", least: int = 80) -> DataFrame:
    """Share of entries of each phase that were dispatched, as a whole-number comparison."""
    out = entries.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("dispatched").cast("long")).alias("dispatched"))
    return out.withColumn("compliant", F.col("dispatched") * 100 >= F.col("n") * least)


def fingerprints(mentions: DataFrame) -> DataFrame:
    """What a verdict is bound to: a digest of file, id, mention and quote."""
    return mentions.select("mention_id", digest(F.col("file_id"), F.col("mention_id"), F.col("mention"), F.col("quote")).alias("fingerprint"))


def stale(verdicts: DataFrame, mentions: DataFrame) -> DataFrame:
    """Verdicts whose fingerprint isn't the mention's any more."""
    now = fingerprints(mentions).withColumnRenamed("fingerprint", "_now")
    return verdicts.join(now, "mention_id", "left").where(~F.col("fingerprint").eqNullSafe(F.col("_now"))).drop("_now")


def repair_cohort(verdicts: DataFrame) -> DataFrame:
    """(mention_id, verdict) of mentions that failed or were uncertain in the first round: each may be repaired once."""
    return latest(verdicts.where("round = 1")).where("verdict <> 'pass'").select("mention_id", "verdict")


def finalized(verdicts: DataFrame, repairs: DataFrame, least_pct: int = 90) -> DataFrame:
    """One row: audited, repaired and passed, and whether the gate opens; repairs of mentions outside the cohort don't count."""
    first = latest(verdicts.where("round = 1")).select("mention_id", "verdict")
    done = with_repairs(first, repairs.join(repair_cohort(verdicts).select("mention_id"), "mention_id", "left_semi"))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    out = done.agg(F.count(F.lit(1)).alias("audited"), n(F.col("repaired")).alias("repaired"), n(F.col("verdict") == "pass").alias("passed"))
    return out.withColumn("ready", (F.col("audited") > 0) & (F.col("passed") * 100 >= F.col("audited") * least_pct))
