"""Greedy choices of quotes, and deterministic samples.

The greedy choices are folds over ordered candidates. Before a fold, windows take away only what no fold could choose,
so that its list is short whatever the group's size:
 * a text comes up again within one source: whatever befell its first occurrence befalls it;
 * a source has ``take`` better texts: each was chosen, had been seen, or the source was full;
 * a text has two better occurrences in different sources: no more than one source is ever full before the end;
 * a group has 4 * take better rows left: they hold 2 * take texts, and no more than ``take`` of them can fail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritally.functions import text as fx
from veritally.semantics import file_of, n_words, normalized, squeezed, stable
from veritally.sources.staging import dealt, parts


def _greedy(rows: DataFrame, group: list[str], keys: list[Column], seen: Column, source: Column, take: int, cap: int) -> DataFrame:
    """Of each group, in order of ``keys``, the first ``take`` rows with texts not chosen before and sources not full.

    ``cap`` rows a source, or any number if the group has one source. Adds ``pick``, from 1 on. Texts are told apart by 16 bytes.
    """
    rows = rows.withColumns({"_seen": F.unhex(F.md5(seen)), "_source": source, "_keys": F.struct(*keys)}).where("_source is not null")
    # what a part of the sources makes superfluous is so in all: each part of a group is cut down by itself first
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("_source"), F.lit(parts(rows))))
    rows = dealt(rows, *group, "_part")
    spread = rows.groupBy(*group, "_part").agg(F.min("_source").alias("_a"), F.max("_source").alias("_z")).groupBy(*group).agg((F.min("_a") < F.max("_z")).alias("_diverse"))
    best = rows
    part = ["_part"]
    for by, most in (([*part, "_source", "_seen"], 1), ([*part, "_source"], take), ([*part, "_seen"], 2), (part, 4 * take), (["_seen"], 2), ([], 4 * take)):
        w = Window.partitionBy(*group, *by).orderBy("_keys")
        best = best.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most)
    payload = [c for c in rows.columns if c not in {*group, "_keys", "_part"}]
    listed = best.drop("_rn").groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_keys", *payload))).alias("_all")).join(spread, group)
    full = F.when(F.col("_diverse"), F.lit(cap)).otherwise(F.lit(take))

    def step(chosen: Column, x: Column) -> Column:
        skip = (F.size(chosen) >= take) | F.exists(chosen, lambda y: y["_seen"] == x["_seen"]) | (F.size(F.filter(chosen, lambda y: y["_source"] == x["_source"])) >= full)
        return F.when(skip, chosen).otherwise(F.concat(chosen, F.array(x)))

    picked = listed.withColumn("_picked", F.aggregate("_all", F.slice("_all", 1, 0), step))
    out = picked.select(*group, F.posexplode("_picked").alias("_at", "_x"))
    return out.select(*group, (F.col("_at") + 1).cast("long").alias("pick"), *[F.col(f"_x.{c}").alias(c) for c in payload if not c.startswith("_")])


def select_quotes(mentions: DataFrame, assignments: DataFrame, themes: DataFrame, take: int = 5) -> DataFrame:
    """Up to five sample quotes of each theme, notable ones first, no text twice, at most three of a source."""
    words = themes.select("theme_id", fx.theme_keywords(F.col("include"), F.col("description")).alias("_keywords"))
    rows = dealt(assignments, "mention_id").join(dealt(mentions.drop("question_id"), "mention_id"), "mention_id").join(words, "theme_id", "left")
    q = F.col("quote")
    rows = rows.where((F.coalesce(q, F.lit("")) != "") & (n_words(q) <= 100))
    keys = [
        fx.is_disqualified(q).alias("k1"),
        fx.is_low_signal(q).alias("k2"),
        (~F.coalesce("notable_quote", F.lit(False))).alias("k3"),
        (fx.is_csv_row(q).cast("int") * 2 + fx.has_markdown(q).cast("int")).alias("k4"),
        fx.off_length(q).alias("k5"),
        F.coalesce(fx.off_topic(q, F.col("_keywords")), F.lit(False)).alias("k6"),
        F.col("mention_id").alias("k7"),
    ]
    return _greedy(rows, ["question_id", "theme_id"], keys, squeezed(q), file_of(F.col("mention_id")), take, -(-take // 2)).drop("_keywords")


def quote_candidates(mentions: DataFrame, assignments: DataFrame, nominations: DataFrame | None = None) -> DataFrame:
    """Up to three candidates of each theme, its nominee first; quotes of 5 to 100 words, at most two of a source."""
    rows = dealt(assignments, "mention_id").join(dealt(mentions.drop("question_id"), "mention_id"), "mention_id")
    rows = rows.withColumn("_nominee", F.lit(None).cast("string")) if nominations is None else rows.join(nominations.select("theme_id", F.col("mention_id").alias("_nominee")), "theme_id", "left")
    q = F.col("quote")
    rows = rows.where(n_words(q).between(5, 100))
    keys = [
        (~F.coalesce(F.col("mention_id") == F.col("_nominee"), F.lit(False))).alias("k1"),
        fx.is_low_signal(q).alias("k2"),
        fx.is_csv_row(q).alias("k3"),
        (~F.coalesce("notable_quote", F.lit(False))).alias("k4"),
        fx.off_length(q).alias("k5"),
        F.col("mention_id").alias("k6"),
    ]
    return _greedy(rows, ["question_id", "theme_id"], keys, normalized(q), F.col("file_id"), 3, 2)


def spread_layers(mentions: DataFrame, by: list[str], source: str = "file_id") -> DataFrame:
    """``layer``: the place of a mention among those of its source, notable ones first, ties by a stable hash."""
    w = Window.partitionBy(*by, source).orderBy(~F.coalesce("notable_quote", F.lit(False)), stable(F.col("mention_id")), "mention_id")
    return mentions.withColumn("layer", F.row_number().over(w).cast("long"))


def spread_sample(mentions: DataFrame, by: list[str], limit: int) -> DataFrame:
    """The first ``limit`` of each group when sources take turns; ``place`` from 1 on."""
    w = Window.partitionBy(*by).orderBy("layer", ~F.coalesce("notable_quote", F.lit(False)), stable(F.col("mention_id")), "mention_id")
    return spread_layers(mentions, by).withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= limit)


def executive_observations(mentions: DataFrame, assignments: DataFrame, most: int = 6) -> DataFrame:
    """Up to six mentions of each theme, of as many sources."""
    rows = assignments.join(mentions.drop("question_id"), "mention_id")
    w = Window.partitionBy("theme_id").orderBy(~F.coalesce("notable_quote", F.lit(False)), stable(F.col("mention_id")), "mention_id")
    first = spread_layers(rows, ["theme_id"]).where("layer = 1")
    return first.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= most)


def theme_sample(mentions: DataFrame, assignments: DataFrame, size: Column, cap: int = 240_000, least: int = 40) -> DataFrame:
    """Mentions of each theme in spread order while their sizes add up to ``cap`` at most.

    ``least`` is a size that no mention is under; a smaller one is an error, as the cut before the sums relies on it.
    """
    rows = assignments.join(mentions.drop("question_id"), "mention_id").withColumn("size", size.cast("long"))
    rows = rows.withColumn("size", F.when(F.col("size") >= least, F.col("size")).otherwise(F.raise_error(F.lit(f"a size under {least}")).cast("long")))
    near = spread_sample(rows, ["theme_id"], cap // least + 1)
    w = Window.partitionBy("theme_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return near.withColumn("total", F.sum("size").over(w)).where(F.col("total") <= cap)


def bounded_view(mentions: DataFrame, assignments: DataFrame, size: Column, cap: int = 240_000) -> DataFrame:
    """For each question, the largest number of mentions a theme whose sizes fit in ``cap``: shown, chosen, total size."""
    steps = [40, 30, 20, 15, 10, 8, 6, 4, 3, 2, 1]
    rows = assignments.join(mentions.drop("question_id"), "mention_id").withColumn("size", size.cast("long"))
    rows = spread_sample(rows, ["question_id", "theme_id"], max(steps))
    sums = rows.groupBy("question_id").agg(*[F.sum(F.when(F.col("place") <= n, F.col("size"))).alias(f"s{n}") for n in steps])
    fits = F.array(*[F.struct(F.lit(n).cast("long").alias("per_theme"), F.col(f"s{n}").alias("total")) for n in steps])
    best = F.get(F.filter(fits, lambda x: x["total"] <= cap), F.lit(0))
    return sums.select("question_id", best["per_theme"].alias("per_theme"), best["total"].alias("total"))


def chunks(rows: DataFrame, by: str, order: str, size: int = 300, prefix: int = 8) -> DataFrame:
    """``chunk`` from 0 on: ``size`` rows at a time in order within a group.

    Places are counted within the stretches of ids that begin alike, and the stretches' sizes are added up, so that a
    large group isn't one task.
    """
    rows = rows.withColumn("_head", F.substring(order, 1, prefix))
    heads = rows.groupBy(by, "_head").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(by).orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(by, "_head", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(by, "_head").orderBy(order))
    numbered = rows.withColumn("_own", own).join(heads, [by, "_head"])
    return numbered.withColumn("chunk", F.floor((F.col("_before") + F.col("_own") - 1) / size)).drop("_head", "_own", "_before")


def strata_quotas(rows: DataFrame, stratum: str, fraction: float) -> DataFrame:
    """(stratum, size, quota): shares of ceil(n * fraction), one at least; the largest give and take what is over or short.

    Strata are few (a fixed set of source types), so their quotas are settled in one ordered array.
    """
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("size"))
    every = sizes.agg(F.sum("size").alias("total"), F.collect_list(F.struct((-F.col("size")).alias("neg"), F.col(stratum).alias("name"), "size")).alias("all"))
    budget = F.least(F.ceil(F.col("total") * F.lit(fraction)), F.col("total"))
    every = every.withColumn("budget", budget)
    first = F.transform(F.array_sort("all"), lambda x: F.struct(x["name"].alias("name"), x["size"].alias("size"), F.least(x["size"], F.greatest(F.lit(1), F.floor(x["size"] / F.col("total") * F.col("budget")))).cast("long").alias("quota")))
    every = every.withColumn("q", first)
    total = lambda q: F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a + x["quota"])
    top = lambda q: F.array_position(F.transform(q, lambda x: x["quota"]), F.array_max(F.transform(q, lambda x: x["quota"])))
    changed = lambda q, at, by: F.transform(q, lambda x, i: F.when(i + 1 == at, F.struct(x["name"].alias("name"), x["size"].alias("size"), (x["quota"] + by).alias("quota"))).otherwise(x))
    # at most one step for each stratum either way: floors and minima of one are off by less than one each
    trims = F.sequence(F.lit(1), F.size("q"))
    every = every.withColumn("q", F.aggregate(trims, F.col("q"), lambda q, _: F.when(total(q) > F.col("budget"), changed(q, top(q), F.lit(-1).cast("long"))).otherwise(q)))
    room = lambda q, i: (total(q) < F.col("budget")) & (F.get(q, i)["quota"] < F.get(q, i)["size"])
    rounds = F.flatten(F.array_repeat(F.sequence(F.lit(0), F.size("q") - 1), 2))
    every = every.withColumn("q", F.aggregate(rounds, F.col("q"), lambda q, i: F.when(room(q, i), changed(q, i + 1, F.lit(1).cast("long"))).otherwise(q)))
    return every.select(F.inline("q")).select(F.col("name").alias(stratum), "size", "quota")


def stratified_sample(rows: DataFrame, stratum: str, id_col: str, fraction: float, seed: str = "seed") -> DataFrame:
    """The quota of each stratum, drawn by a seeded hash of the id."""
    w = Window.partitionBy(stratum).orderBy(F.sha2(F.concat(F.lit(seed), F.col(id_col)), 256), id_col)
    most = strata_quotas(rows, stratum, fraction)
    return rows.withColumn("_rn", F.row_number().over(w)).join(F.broadcast(most.select(stratum, "quota")), stratum).where("_rn <= quota").drop("_rn", "quota")


#: Goes into the hashes that break ties. Fixed value: the same sample is drawn for it.
SAMPLE_SALT = "bootcamp-v2"


def fixed_audit_sample(mentions: DataFrame, limit: int = 20, sources: int = 6, salt: str = SAMPLE_SALT) -> DataFrame:
    """(mention_id, place): a small sample clustered in few sources, for cell coverage and then balance.

    Sources are taken one at a time, each with the most cells (question, source type) not yet covered, ties by a stable
    hash. Of sources with the same cells no more than ``sources`` can be chosen, those with the smallest hashes, so the
    choice is one fold over few rows for each distinct set of cells; sets are as few as questions and types allow. The
    mentions of the chosen sources are then balanced in one list, which is cut to what could be chosen: of a cell in a
    source no more than ``limit``. ``salt`` goes into the hashes that break ties, so that a sample can be drawn again.
    """
    tie = lambda kind, c: F.sha2(F.concat(F.lit('{"id":"'), c, F.lit(f'","{kind}_sample":"{salt}"}}')), 256)
    rows = mentions.withColumn("cell", F.concat_ws("|", "question_id", "source_type"))
    cells = rows.groupBy("file_id").agg(F.array_sort(F.collect_set("cell")).alias("cells")).withColumn("tie", tie("source", F.col("file_id")))
    first = F.row_number().over(Window.partitionBy("cells").orderBy("tie", "file_id"))
    few = cells.withColumn("_rn", first).where(F.col("_rn") <= sources).agg(F.collect_list(F.struct("tie", "file_id", "cells")).alias("all"))
    start = F.struct(F.array().cast("array<string>").alias("chosen"), F.array().cast("array<string>").alias("covered"))

    def choose(state: Column, _: Column) -> Column:
        left = F.filter(F.col("all"), lambda x: ~F.array_contains(state["chosen"], x["file_id"]))
        best = F.array_min(F.transform(left, lambda x: F.struct((-F.size(F.array_except(x["cells"], state["covered"]))).alias("new"), x["tie"].alias("tie"), x["file_id"].alias("file_id"), x["cells"].alias("cells"))))
        more = F.struct(F.concat(state["chosen"], F.array(best["file_id"])).alias("chosen"), F.array_union(state["covered"], best["cells"]).alias("covered"))
        return F.when(F.size(left) == 0, state).otherwise(more)

    chosen = few.select(F.explode(F.aggregate(F.sequence(F.lit(1), F.lit(min(sources, limit))), start, choose)["chosen"]).alias("file_id"))
    pool = rows.join(chosen, "file_id", "left_semi").withColumn("tie", tie("mention", F.col("mention_id")))
    w = Window.partitionBy("file_id", "cell").orderBy("tie", "mention_id")
    pool = pool.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit)
    item = F.struct("tie", "mention_id", "file_id", "cell")
    listed = pool.agg(F.array_sort(F.collect_list(item)).alias("pool"))
    times = lambda got, f, x: F.size(F.filter(got, lambda y: y[f] == x[f]))

    def step(got: Column, _: Column) -> Column:
        free = F.filter(F.col("pool"), lambda x: ~F.exists(got, lambda y: y["mention_id"] == x["mention_id"]))
        rank = F.transform(free, lambda x: F.struct((times(got, "cell", x) > 0).alias("a"), (times(got, "file_id", x) > 0).alias("b"), times(got, "cell", x).alias("c"), times(got, "file_id", x).alias("d"), x["tie"].alias("e"), x.alias("x")))
        return F.when(F.size(free) == 0, got).otherwise(F.concat(got, F.array(F.array_min(rank)["x"])))

    done = listed.select(F.aggregate(F.sequence(F.lit(1), F.lit(limit)), F.slice("pool", 1, 0), step).alias("got"))
    return done.select(F.posexplode("got").alias("at", "x")).select("x.mention_id", "x.file_id", "x.cell", (F.col("at") + 1).cast("long").alias("place"))


def next_batch(files: DataFrame, reserved: DataFrame, most: int = 4) -> DataFrame:
    """The first sources that no step has reserved yet."""
    return files.join(reserved.select("file_id"), "file_id", "left_anti").orderBy("file_id").limit(most)


def pull_quotes(selected: DataFrame, counts: DataFrame) -> DataFrame:
    """One quote for each question: of its largest theme that isn't ``other``, a notable one if there is any."""
    w = Window.partitionBy("question_id").orderBy(F.col("type") == "other", F.desc("mention_count"), "theme_id", ~F.col("notable_quote"), "pick")
    return selected.join(counts.select("theme_id", "type", "mention_count"), "theme_id").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
