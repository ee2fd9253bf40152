"""The run ledger as keyed events: claims, completions and retries, replayed in order of time."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritally.semantics import digest

CAPS = {"audit-repair:": 1, "extract:": 2, "audit-initial:": 2}  #: attempts by kind of key; others have three
IN_FLIGHT, IN_FLIGHT_DIRECT = 4, 16


def cap_of(key):
    out = None
    for prefix, n in CAPS.items():
        out = F.when(F.startswith(key, F.lit(prefix)), n) if out is None else out.when(F.startswith(key, F.lit(prefix)), n)
    return out.otherwise(3)


def replay(events: DataFrame) -> DataFrame:
    """Of each key: attempts, refusals and where it ended.

    A claim starts an attempt unless one runs, the key is complete, or its attempts are used up; a finish completes a
    running attempt, a fail ends it. The state of a key is a fold over its events in order. Of claims in a row only the
    first can change a state, and of finishes and fails in a row as well, so what is folded is where these two alternate.
    """
    rows = events.where(F.col("event").isin("claim", "finish", "fail"))
    w = Window.partitionBy("key").orderBy("ts", "event_id")
    turn = rows.withColumn("prev", F.lag("event").over(w))
    marked = turn.withColumn("same", F.coalesce((F.col("prev") == "claim") == (F.col("event") == "claim"), F.lit(False)))
    # once a key is complete or spent nothing changes: that is within its first 2 * cap + 1 alternations
    steps = marked.where(~F.col("same")).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= 2 * 3 + 2)
    folded = steps.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("nth", "event"))).alias("e"))
    start = F.struct(F.lit(0).alias("attempts"), F.lit("new").alias("status"))

    def step(s, x):
        can = ~s["status"].isin("running", "complete") & (s["attempts"] < cap_of(F.col("key")))
        state = lambda n, status: F.struct(n.alias("attempts"), F.lit(status).alias("status"))
        return F.when((x["event"] == "claim") & can, state(s["attempts"] + 1, "running")).when((x["event"] == "finish") & (s["status"] == "running"), state(s["attempts"], "complete")).when((x["event"] == "fail") & (s["status"] == "running"), state(s["attempts"], "failed")).otherwise(s)

    end = folded.select("key", F.aggregate("e", start, step).alias("s"))
    counts = rows.groupBy("key").agg(F.sum((F.col("event") == "claim").cast("long")).alias("claims"))
    out = counts.join(end, "key").select("key", F.col("s.attempts").cast("long").alias("attempts"), F.col("s.status").alias("status"), "claims")
    return out.withColumn("refused", F.col("claims") - F.col("attempts"))


def metrics(events: DataFrame) -> DataFrame:
    """Attempts, retries, and tokens if every attempt was measured."""
    claims = events.where("event = 'claim'").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("measured"), F.sum("value").alias("tokens"))
    all_measured = F.sum("measured") == F.sum("n")
    return claims.agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("attempts"), F.sum(F.col("n") - 1).alias("retries"), F.when(all_measured, F.sum("tokens")).alias("tokens"))


def active_seconds(events: DataFrame) -> DataFrame:
    """Seconds of each key between its events, without those after a pause."""
    w = Window.partitionBy("key").orderBy("ts", "event_id")
    rows = events.select("key", "event", "ts", F.lead("ts").over(w).alias("next"))
    span = F.unix_micros(F.col("next").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return rows.groupBy("key").agg(F.coalesce(F.sum(F.when(F.col("event") != "pause", span)), F.lit(0)).alias("active_micros"), F.coalesce(F.sum(span), F.lit(0)).alias("elapsed_micros"))


def over_budget(active: DataFrame, sources: int) -> DataFrame:
    """A warning, never a stop: 15 minutes and one for each source."""
    return active.withColumn("over", F.col("active_micros") > (15 + sources) * 60_000_000)


def in_flight(events: DataFrame, cap: int = IN_FLIGHT) -> DataFrame:
    """How many keys run after each event, and whether a new one would be let in (``open``).

    The count is global, so it is a running sum over time: sums within hours first, and those of earlier hours added.
    """
    step = F.when(F.col("event") == "claim", 1).when(F.col("event").isin("finish", "fail"), -1).otherwise(0)
    rows = events.where(F.col("event").isin("claim", "finish", "fail")).select("key", "event", "ts", "event_id", step.alias("d"), F.date_trunc("hour", "ts").alias("hour"))
    hours = rows.groupBy("hour").agg(F.sum("d").alias("h"))
    hours = hours.select("hour", F.coalesce(F.sum("h").over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.sum("d").over(Window.partitionBy("hour").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("own", own).join(hours, "hour").select("key", "event", "ts", "event_id", (F.col("own") + F.col("before")).alias("running")).withColumn("open", F.col("running") < cap)


class Run:
    """The state of one run while its events are replayed: each key's attempts, what runs, what is complete, and whether it is paused."""

    def __init__(self, cap: int, attempts: int):
        self.cap, self.most = cap, attempts
        self.tries: dict[str, int] = {}
        self.running: set[str] = set()
        self.complete: set[str] = set()
        self.status = "active"

    def step(self, event: str, key: str) -> str | None:
        """What an event does; for a claim, whether it runs, gives what is complete, or why it is refused."""
        if event == "claim":
            if self.status != "active":
                return self.status
            if key in self.complete:
                return "reuse"
            if key not in self.tries and len(self.running) >= self.cap:
                return "full"
            if self.tries.get(key, 0) >= self.most:
                return "spent"
            self.tries[key] = self.tries.get(key, 0) + 1
            self.running.add(key)
            return "run"
        if event in ("finish", "fail"):
            if event == "finish" and key in self.running:
                self.complete.add(key)
            self.running.discard(key)
        elif event == "close" or self.status != "closed":
            self.status = {"pause": "paused", "resume": "active", "close": "closed"}.get(event, self.status)
        return None


def enforced(events: DataFrame, cap: int = IN_FLIGHT, attempts: int = 2) -> DataFrame:
    """(run_id, event_id, key, action) of each claim under the run's rules; events: run_id, key, event, ts, event_id.

    At most ``cap`` keys run at a time, and a new key beyond them is refused (``full``); a key has ``attempts``, those that are
    still running included (``spent``); a complete one is given again (``reuse``); a paused or closed run admits none. A claim's
    answer depends on all before it in its run, so a run's events are one sorted stream, read without gathering them; its state
    has an entry for each key. Runs are dealt over tasks. Ties in time go by event_id; null keys and events are not replayed.
    """
    rows = events.where(F.col("run_id").isNotNull() & F.col("key").isNotNull() & F.col("event").isin("claim", "finish", "fail", "pause", "resume", "close"))
    kind = rows.schema["run_id"].dataType.simpleString()
    order = rows.select("run_id", "ts", "event_id", "key", "event").repartition("run_id").sortWithinPartitions("run_id", "ts", "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, Run(cap, attempts)
        for batch in batches:
            said = []
            for r, event, key in zip(batch["run_id"].to_pylist(), batch["event"].to_pylist(), batch["key"].to_pylist(), strict=True):
                if r != at:
                    at, state = r, Run(cap, attempts)
                said.append(state.step(event, key))
            out = pa.RecordBatch.from_arrays([batch["run_id"], batch["event_id"], batch["key"], pa.array(said, pa.string())], names=["run_id", "event_id", "key", "action"])
            yield out.filter(out["action"].is_valid())

    return order.mapInArrow(run, f"run_id {kind}, event_id long, key string, action string")


def accepted(submissions: DataFrame, attempts: int = 3) -> DataFrame:
    """Submissions (key, sha256, arrived): the same bytes again are none; of the others the first ``attempts`` count."""
    first = submissions.groupBy("key", "sha256").agg(F.min("arrived").alias("arrived"))
    w = Window.partitionBy("key").orderBy("arrived", "sha256")
    n = first.withColumn("attempt", F.row_number().over(w).cast("long"))
    return n.withColumn("accepted", F.col("attempt") <= attempts)


def effective(parts: DataFrame) -> DataFrame:
    """The latest valid part of each question."""
    return parts.where("valid").groupBy("question_id").agg(F.max_by(F.struct("part_id", "sha256"), F.struct("arrived", "part_id")).alias("p")).select("question_id", "p.*")


def progress(steps: DataFrame) -> DataFrame:
    """Counts of keys by status."""
    return steps.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def manifest_identity(request: dict, sources: DataFrame, package: str) -> str:
    """Digest of a run's request, its sources' hashes and the package: the same inputs are the same run.

    The sources' digests are combined without order, so no list of them is gathered.
    """
    row = sources.select(F.xxhash64("file_id", "sha256").alias("h")).agg(F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)")), F.count(F.lit(1))).first()
    body = json.dumps({"request": request, "sources": [str(x) for x in row], "package": package}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return sources.sparkSession.range(1).select(F.sha2(F.lit(body), 256)).first()[0]


def changed_inputs(manifest: DataFrame, now: DataFrame) -> DataFrame:
    """Paths whose bytes aren't those of the manifest any more, or that are gone."""
    return manifest.join(now.select("path", F.col("sha256").alias("_now")), "path", "left").where(~F.col("sha256").eqNullSafe(F.col("_now"))).select("path", "sha256", "_now")


DEVIATION_CATEGORIES = ["retry", "skip", "fallback", "override", "demotion", "validation", "dispatch", "other"]
RESOLUTIONS = ["fixed", "accepted", "dropped", "escalated", "pending"]


def deviations(rows: DataFrame) -> DataFrame:
    """Log entries with a canonical digest; categories and resolutions outside the enumerations are errors."""
    for c, known in (("category", DEVIATION_CATEGORIES), ("resolution", RESOLUTIONS)):
        rows = rows.withColumn(c, F.when(F.col(c).isin(known), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"not a {c}: "), F.coalesce(c, F.lit("null"))))))
    return rows.withColumn("digest", digest(F.col("phase"), F.col("step"), F.col("category"), F.col("description"), F.col("resolution")))
