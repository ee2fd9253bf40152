"""What a report says, checked against the evidence it stands on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritally.functions import figures, prose
from veritally.functions import text as fx
from veritally.operators.checks import issue, raised
from veritally.operators.grounding import best_matches
from veritally.operators.similarity import rarest, shared_keys
from veritally.semantics import digest, normalized, pct, squeezed, straightened
from veritally.sources.staging import cut, dealt


def cleaned_items(items: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Items with ``fields`` cleaned of units that state counts, shares or breadth, and what was taken out: one pass, two outputs.

    Columns: key, fields (cleaned), ``dropped`` (an array of field and unit), ``usable``: all fields have text left, and joined
    they state nothing of that kind either. ``kept_items`` and ``dropped_units`` read the two outputs from the same rows.
    """
    cleaned = items.select(*key, *[fx.clean_prose(F.coalesce(c, F.lit(""))).alias(f"_{c}") for c in fields])
    dropped = F.concat(*map(_units, fields))
    whole = fx.clean_prose(F.concat_ws(" ", *[F.col(f"_{c}.kept") for c in fields]))
    filled = reduce(Column.__and__, [F.trim(F.col(f"_{c}.kept")) != "" for c in fields])
    return cleaned.select(*key, *[F.col(f"_{c}.kept").alias(c) for c in fields], dropped.alias("dropped"), (filled & (F.size(whole["dropped"]) == 0)).alias("usable"))


def kept_items(cleaned: DataFrame) -> DataFrame:
    return cleaned.where("usable").drop("dropped", "usable")


def dropped_units(cleaned: DataFrame, key: list[str]) -> DataFrame:
    """(key, field, unit) of every unit taken out, and of an item that isn't usable the field ``item`` with no unit."""
    item = F.array(F.struct(F.lit("item").alias("field"), F.lit(None).cast("string").alias("unit")))
    none = F.array().cast("array<struct<field:string,unit:string>>")
    return cleaned.select(*key, F.explode(F.concat("dropped", F.when(F.col("usable"), none).otherwise(item))).alias("d")).select(*key, "d.*")


def _units(field: str) -> Column:
    return F.transform(F.col(f"_{field}.dropped"), lambda u: F.struct(F.lit(field).alias("field"), u.alias("unit")))


def plan_files(classified: DataFrame, exclusions: DataFrame, segments: DataFrame, most_summary: int = 1000) -> DataFrame:
    """Files of a plan: classified sources with their exclusions and segments, summaries cut at a word."""
    out = classified.drop("segment").join(exclusions.select("file_id", "exclusion_reason", F.lit(True).alias("excluded")), "file_id", "left")
    out = out.join(segments.select("file_id", F.col("segment_id").alias("segment")), "file_id", "left")
    return out.withColumns({"segment": F.coalesce("segment", F.lit("unknown")), "excluded": F.coalesce("excluded", F.lit(False)), "summary": fx.truncated(F.col("summary"), most_summary)})


def narrative_fields(sections: DataFrame, findings: DataFrame) -> DataFrame:
    """(path, text, question_id) of all prose: sections (question_id, headline, synthesis, takeaways) and findings (id, title, text)."""
    field = lambda name, text: F.struct(name.alias("path"), text.alias("text"))
    at = lambda part: F.concat(F.lit("questions."), "question_id", F.lit(f".{part}"))
    listed = F.transform("takeaways", lambda x, i: F.struct(F.concat(F.lit("questions."), F.col("question_id"), F.lit(".takeaways["), i, F.lit("]")).alias("path"), x.alias("text")))
    own = sections.select("question_id", F.explode(F.concat(F.array(field(at("headline"), F.col("headline")), field(at("synthesis"), F.col("synthesis"))), F.coalesce(listed, F.array().cast("array<struct<path:string,text:string>>")))).alias("f"))
    top = findings.select(F.lit(None).cast("string").alias("question_id"), F.explode(F.array(*[field(F.concat(F.lit("findings."), "id", F.lit(f".{c}")), F.col(c)) for c in ("title", "text")])).alias("f"))
    return own.unionByName(top).select("f.path", "f.text", "question_id").where("text is not null")


def ungrounded_quotations(fields: DataFrame, mentions: DataFrame, width: int = 3) -> DataFrame:
    """(path, quote): quotations in prose that no retained quote of the question (of any, without a question) holds between word bounds."""
    said = fields.select("path", "question_id", F.explode(prose.column("quotations")("text")).alias("q")).select("path", "question_id", F.col("q.quote").alias("quote"))
    return unheld_quotes(said, mentions, width)


#: Runs that a long quotation is looked up by at most, those with the smallest hashes; short runs that are broadcast.
TRIED, FEW = 3, 500_000


def _tokens(text: Column) -> Column:
    """The words of the normalized text, with single spaces."""
    return F.trim(F.regexp_replace(F.lower(straightened(F.regexp_replace(text, r"\\([^\\])", "$1"))), r"[^\p{L}\p{N}_]+", " "))


def _runs(words: str, least: int, most: int) -> Column:
    """From each word of a spaced text on, as many as ``most`` words, where there are ``least``: one pass of a pattern."""
    return F.regexp_extract_all(words, F.lit(rf"(?:^|(?<= ))(?=([^ ]+(?: [^ ]+){{{least - 1},{most - 1}}}))"), F.lit(1))


def _headed(runs: DataFrame, width: int) -> DataFrame:
    """Runs with their first ``width`` words and question as 12 bytes (key, check), and the words behind them (tail)."""
    head = F.substring_index("run", " ", width)
    return runs.withColumns({"key": F.xxhash64("question_id", head), "check": F.hash("question_id", head), "tail": F.substring(F.col("run"), F.char_length(head) + 2, F.char_length("run"))}).drop("run")


def unheld_quotes(said: DataFrame, mentions: DataFrame, width: int = 3) -> DataFrame:
    """(path, quote) of those (path, question_id, quote) whose words no quote of the question has in a row.

    Words are read once, and what is asked and what is held under a question are brought together as different texts: equal ones
    are settled. From each word of a held text on, a run of ``reach`` words is one row, its head a hash. A quotation of up to
    ``reach`` words is such a run, or its beginning; of a longer one, of a few runs the one that the fewest texts have is its
    key, and texts meet only behind it. Of fewer than ``width`` words, standing in a text is having them.
    """
    reach, heads = 2 * width + 1, ["key", "check"]
    q = said.groupBy("path", "quote").agg(F.collect_set(F.struct("question_id")).alias("of"))
    q = cut(q.withColumns({"asked": F.monotonically_increasing_id(), "w": _tokens(F.col("quote"))}))  # written, so the numbers stay
    e = mentions.select("question_id", _tokens(F.col("quote")).alias("v"), F.lit(True).alias("held"))
    asks = q.select("asked", "w", F.explode("of.question_id").alias("of")).where("w <> ''")
    anywhere = asks.where("of is null").crossJoin(F.broadcast(mentions.select("question_id").distinct()))  # questions are few
    asks = asks.where("of is not null").withColumn("question_id", F.col("of")).unionByName(anywhere)
    texts = e.where("v <> ''").unionByName(asks.select("question_id", F.col("w").alias("v"), F.lit(False).alias("held")))
    texts = texts.groupBy("question_id", "v").agg(F.bool_or("held").alias("held"), F.bool_or(~F.col("held")).alias("asked"))
    texts = cut(texts.withColumns({"id": F.monotonically_increasing_id(), "n": F.size(F.split("v", " "))}))
    own = _key(F.col("question_id"), F.col("v"))
    held, wanted = texts.where("held"), texts.where("asked and not held").select(own.alias("id"), "question_id", "v", "n")
    # one run of a quotation that isn't long, some of a long one
    few = F.slice(F.array_sort(F.transform(F.array_distinct(_runs("v", reach, reach)), lambda r: F.struct(F.xxhash64(r).alias("h"), r.alias("run")))), 1, TRIED)
    short = wanted.where(F.col("n").between(width, reach)).select("id", "n", "question_id", F.col("v").alias("run"))
    long = wanted.where(F.col("n") > reach).select("id", "n", "question_id", F.explode(few["run"]).alias("run"))
    keyed = cut(_headed(short.unionByName(long), width).withColumn("more", F.least("n", F.lit(reach)) - width))
    have = _headed(held.where(F.col("n") >= width).select(F.col("id").alias("held"), "question_id", F.explode(_runs("v", width, reach)).alias("run")), width).drop("question_id")
    have = have.join(keyed.groupBy(*heads).agg(F.collect_set("more").alias("mores")), heads)
    # a run has as many words behind its head as are asked for there, or it isn't what is asked for
    begun = have.select(*heads, "held", "tail", F.explode("mores").alias("more")).withColumn("tail", F.expr("substring_index(tail, ' ', more)"))
    have = cut(begun.join(keyed.select(*heads, "tail").distinct(), [*heads, "tail"], "left_semi").select(F.struct(*heads, "tail").alias("key"), "held", "more"))
    one = keyed.select("id", "n", F.struct(*heads, "tail").alias("key"))
    whole = one.where(F.col("n") <= reach).join(have.select("key").distinct(), "key", "left_semi").select("id")
    have = have.where(F.col("more") == reach - width).select("key", "held")
    often = have.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    pairs = shared_keys(rarest(one.where(F.col("n") > reach).select("id", "key"), "id", often, F.lit(1)).join(often.select("key"), "key"), have, "id", "held").distinct()
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    both = pairs.join(held.select(F.col("id").alias("held"), "v"), "held").join(wanted.select("id", F.col("v").alias("w")), "id")
    inside = both.where(F.contains(padded(F.col("v")), padded(F.col("w")))).select("id")
    found = whole.unionByName(inside)
    if width > 1:
        brief = cut(wanted.where(F.col("n") < width).select("id", F.xxhash64("question_id", "v").alias("key"), "question_id", F.col("v").alias("run")))
        starts = F.array(*[F.substring_index("run", " ", i) for i in range(1, width)])
        stand = held.select("question_id", F.explode(_runs("v", 1, width - 1)).alias("run")).select("question_id", F.explode(starts).alias("run")).withColumn("key", F.xxhash64("question_id", "run"))
        keys = brief.select("key").distinct()
        stand = stand.join(F.broadcast(keys) if brief.count() <= FEW else keys, "key", "left_semi").select("question_id", "run").distinct()
        found = found.unionByName(brief.join(stand, brief["question_id"].eqNullSafe(stand["question_id"]) & (brief["run"] == stand["run"]), "left_semi").select("id"))
    hit = found.unionByName(texts.where("asked and held").select(own.alias("id"))).distinct()
    hits = cut(asks.select("asked", "of", _key(F.col("question_id"), F.col("w")).alias("id")).join(hit, "id", "left_semi").select("asked", "of").distinct().groupBy("asked").agg(F.count(F.lit(1)).alias("hits")))
    return q.join(hits, "asked", "left").where(F.coalesce("hits", F.lit(0)) < F.size("of")).select("path", "quote")


def _key(question: Column, text: Column) -> Column:
    """16 bytes for a text under a question, or under none."""
    return F.unhex(F.md5(F.concat(F.coalesce(question, F.lit("\n")), F.lit("\n"), text).cast("binary")))


def attribution_issues(fields: DataFrame, registry: DataFrame) -> DataFrame:
    """Quotations with a name behind them whose quote is in the registry under another name, or not in it at all.

    registry: entry_id, text, attribution.
    """
    pairs = fields.select("path", F.explode(prose.column("attributed")("text")).alias("a")).select(digest(F.col("path"), F.col("a.quote"), F.col("a.attribution")).alias("quote_id"), "path", F.col("a.quote").alias("text"), F.col("a.attribution").alias("name"))
    found = best_matches(pairs, registry).join(registry.select("entry_id", "attribution"), "entry_id")
    both = pairs.join(found.select("quote_id", "attribution"), "quote_id", "left")
    key = fx.attribution_key
    apart = ~(F.contains(key(F.col("attribution")), key(F.col("name"))) | F.contains(key(F.col("name")), key(F.col("attribution"))))
    return raised(both, "path", [issue(F.col("attribution").isNull(), "attribution", "warning", "quote isn't in the registry"), issue(apart, "attribution", "error", "said by another")])


def number_registry(counts: DataFrame, stats: DataFrame, quotes: DataFrame, method: DataFrame) -> DataFrame:
    """(scope, value): numbers that prose may state: counts and shares of a question, statistics, figures in its quotes; the scope ``global`` has all of them, and the totals."""
    text = lambda c: F.col(c).cast("string")
    own = counts.select(F.col("question_id").alias("scope"), F.explode(F.array(*map(text, ("mention_count", "mention_pct", "source_type_count", "source_type_pct", "segment_count", "segment_pct", "total_mentions", "total_source_types", "total_segments")))).alias("value"))
    more = stats.select("scope", F.explode(F.array(*map(text, ("numerator", "denominator", "percentage")))).alias("value"))
    said = quotes.select(F.col("question_id").alias("scope"), F.explode(F.regexp_extract_all("quote", F.lit(r"\d{2,}"), F.lit(0))).alias("value"))
    whole = method.select(F.lit("global").alias("scope"), F.explode(F.array(*[text(c) for c in method.columns])).alias("value"))
    of = reduce(DataFrame.unionByName, [own, more, said])
    return reduce(DataFrame.unionByName, [of, of.select(F.lit("global").alias("scope"), "value"), whole]).distinct()


def stated_numbers(fields: DataFrame) -> DataFrame:
    """(path, scope, value, type) of data-like numbers in prose."""
    rows = fields.select("path", F.coalesce("question_id", F.lit("global")).alias("scope"), "text")
    return figures.numbers(rows, ["path", "scope"], "text").select("path", "scope", "value", "type")


def number_view(numbers: DataFrame, texts: DataFrame, sentences: DataFrame) -> DataFrame:
    """``numbers`` (file_id, start, …) of report text outside what is an exact copy of source text.

    texts: file_id, place, text, from, to, of the report's sentences; sentences: file_id, text, of the sources. A sentence that
    another file has word for word is a copy, and the numbers in it are the source's.
    """
    owners = sentences.groupBy("text").agg(F.min("file_id").alias("_first"), F.max("file_id").alias("_last"))
    copied = texts.join(owners, "text").where((F.col("_first") != F.col("file_id")) | (F.col("_last") != F.col("file_id")))
    return figures.outside(numbers, copied.select("file_id", "from", "to"), ["file_id"])


def quantity_issues(claims: DataFrame, stats: DataFrame) -> DataFrame:
    """Quantities that claims (claim_id, question_id, text) state, against statistics of their scope and unit.

    A count must be a numerator, a ratio a numerator over its denominator, a percentage their share; people and accounts
    have no count, as identities aren't known, and types of sources can't be had from files.
    """
    found = claims.select("claim_id", "question_id", F.explode(prose.column("quantities")("text")).alias("x")).select("claim_id", "question_id", "x.*").withColumn("_i", F.monotonically_increasing_id())
    s = stats.select(F.col("scope").alias("question_id"), F.col("unit").alias("_unit"), "numerator", "denominator", "percentage" if "percentage" in stats.columns else pct(F.col("numerator"), F.col("denominator")).alias("percentage")).withColumnRenamed("percentage", "_pct")
    both = found.join(s, (found["question_id"] == s["question_id"]) & (F.coalesce(found["unit"], s["_unit"]) == s["_unit"]), "left").select(found["claim_id"], found["kind"], found["unit"], found["number"], found["denominator"].alias("of"), found["percentage"].alias("attached"), found["_i"], (F.array_size(F.array_except(found["question_scopes"], F.array(found["question_id"]))) > 0).alias("elsewhere"), "numerator", s["denominator"].alias("whole"), "_pct")
    n, of, p = F.col("number"), F.col("of"), F.col("_pct")
    fits = F.when(F.col("kind") == "count", n == F.col("numerator")).when(F.col("kind") == "ratio", (n == F.col("numerator")) & (of == F.col("whole")) & (F.col("attached").isNull() | (F.col("attached") == p))).otherwise((n == p) & (of.isNull() | (of == F.col("whole"))))
    one = both.groupBy("claim_id", "_i", "kind", "unit", "number", "elsewhere").agg(F.coalesce(F.bool_or(fits), F.lit(False)).alias("fits"))
    unit = F.col("unit")
    return raised(
        one,
        "claim_id",
        [
            issue(unit == "unverified_identity", "identity", "error", "counts of people or accounts need verified identities"),
            issue(unit == "source_types", "source_types", "error", "types of sources can't be counted from files"),
            issue(F.col("elsewhere") & ~F.coalesce(unit.isin("unverified_identity", "source_types"), F.lit(False)), "scope", "error", "names a question that its statistic isn't of"),
            issue(F.isnan("number"), "malformed", "error", "not a number"),
            issue(~F.col("fits") & ~F.isnan("number") & ~F.coalesce(unit.isin("unverified_identity", "source_types"), F.lit(False)), "unsupported", "error", "no statistic says so"),
        ],
    )


def source_observations(claims: DataFrame, mentions: DataFrame) -> DataFrame:
    """Observations (claim_id, mention_id and fields of a mention) that aren't an exact copy of their mention."""
    names = ["file_id", "question_id", "mention", "quote", "quote_attribution", "sentiment"]
    m = mentions.select("mention_id", *[F.col(c).alias(f"_{c}") for c in names])
    both = claims.join(m, "mention_id", "left")
    off = reduce(Column.__or__, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names])
    return raised(both, "claim_id", [issue(off, "source_observation", "error", "isn't the mention as it is")])


def bindings(quotes: DataFrame, claims: DataFrame) -> DataFrame:
    """(mention_id, claim_id): displayed quotes and the claims that cite them."""
    cites = claims.select("claim_id", F.explode("support_mention_ids").alias("mention_id"))
    return quotes.select("mention_id").distinct().join(cites, "mention_id").distinct()


def claim_sources(claims: DataFrame, mentions: DataFrame) -> DataFrame:
    """(claim_id, source_file_ids) in order."""
    rows = claims.select("claim_id", F.explode("support_mention_ids").alias("mention_id")).join(mentions.select("mention_id", "file_id"), "mention_id")
    return rows.groupBy("claim_id").agg(F.array_sort(F.collect_set("file_id")).alias("source_file_ids"))


def claim_statistics(claims: DataFrame, mentions: DataFrame, cohort: DataFrame) -> DataFrame:
    """Support counts of each claim over its question, under a reference made from what it cites."""
    cited = claims.select("claim_id", "question_id", F.explode("support_mention_ids").alias("mention_id"))
    rows = dealt(cited, "mention_id").join(dealt(mentions.select("mention_id", "file_id"), "mention_id"), "mention_id")
    by, n = ["claim_id", "question_id"], lambda on: F.col(on).isNotNull().cast("long")
    one = lambda c: dealt(rows.select(*by, c), *by, c).distinct()
    own = one("mention_id").select(*by, "mention_id", n("mention_id").alias("m"), F.lit(0).cast("long").alias("s"))
    of = one("file_id").select(*by, F.lit(None).cast("string").alias("mention_id"), F.lit(0).cast("long").alias("m"), n("file_id").alias("s"))
    per = own.unionByName(of).groupBy(*by).agg(F.sum("m").alias("mentions"), F.sum("s").alias("source_files"), F.array_sort(F.collect_set("mention_id")).alias("ids"))
    whole = cohort.select("question_id", "total_mentions")
    return per.join(whole, "question_id").select("claim_id", "question_id", "mentions", "source_files", "total_mentions", pct(F.col("mentions"), F.col("total_mentions")).alias("percentage"), digest(F.col("claim_id"), F.array_join("ids", ",")).alias("stat_ref"))


def excerpts(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """Excerpts (mention_id, file_id, text, attribution) that don't stand exactly once in their source, or whose speaker isn't the turn's."""
    rows = quotes.join(sources.select("file_id", F.col("text").alias("_source")), "file_id", "left")
    rows = rows.withColumn("c", prose.context_column()("_source", "text"))
    other = F.col("c.speaker").isNotNull() & (squeezed(F.col("c.speaker")) != fx.attribution_key(F.col("attribution")))
    return raised(rows, "mention_id", [issue(~F.col("c.literal_verified"), "excerpt", "error", "doesn't stand once in its source"), issue(F.col("c.literal_verified") & other, "speaker", "error", "the turn has another speaker")])


def span_selections(chosen: DataFrame, spans: DataFrame) -> DataFrame:
    """Selections (selection_id, place, file_id, seq) of spans (file_id, turn, seq, start, end): offsets, and whether they follow one another in one turn."""
    rows = chosen.join(spans.select("file_id", "seq", "turn", "start", "end"), ["file_id", "seq"], "left")
    w = Window.partitionBy("selection_id").orderBy("place")
    rows = rows.withColumn("_ok", F.coalesce((F.lag("place").over(w).isNull() | ((F.col("seq") == F.lag("seq").over(w) + 1) & (F.col("turn") == F.lag("turn").over(w)))) & F.col("start").isNotNull(), F.lit(False)))
    return rows.groupBy("selection_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.bool_and("_ok").alias("consecutive"))


def unknown_keys(keys: DataFrame, files: DataFrame, questions: DataFrame) -> DataFrame:
    """Work keys (key) whose kind or subject isn't in the plan."""
    kind, subject = F.get(F.split("key", ":", 2), F.lit(0)), F.get(F.split("key", ":", 2), F.lit(1))
    rows = keys.select("key", kind.alias("kind"), subject.alias("subject"))
    known = files.select(F.col("file_id").alias("subject"), F.explode(F.array(*map(F.lit, ("extract", "audit-initial", "audit-repair")))).alias("kind")).unionByName(questions.select(F.col("question_id").alias("subject"), F.explode(F.array(*map(F.lit, ("analysis", "section")))).alias("kind")))
    alone = F.col("kind").isin("audit", "executive", "opportunities") & F.col("subject").isNull()
    return rows.where(~alone).join(known, ["kind", "subject"], "left_anti").select("key")


def over_capacity(estimates: DataFrame, window: int) -> DataFrame:
    """Partitions (partition_id, part, tokens) whose parts together don't fit."""
    return estimates.groupBy("partition_id").agg(F.sum("tokens").alias("tokens")).where(F.col("tokens") > window)


def admitted(components: DataFrame, issues: DataFrame) -> DataFrame:
    """Components without editorial issues; one with a hard error fails the whole packet: ``packet_ok`` says so for each."""
    bad = issues.groupBy(F.col("entity_key").alias("component_id")).agg(F.bool_or(F.col("severity") == "error").alias("_hard"), F.lit(True).alias("_any"))
    rows = components.join(bad, "component_id", "left")
    hard = rows.groupBy("packet_id").agg((~F.bool_or(F.coalesce("_hard", F.lit(False)))).alias("packet_ok"))
    return rows.where("_any is null").drop("_hard", "_any").join(hard, "packet_id")


def clause_issues(claims: DataFrame) -> DataFrame:
    """Claims (claim_id, text, clauses) with a bound clause that doesn't occur exactly once in the text, or with two that overlap."""
    at = lambda c: F.instr(F.col("text"), c)
    spots = F.transform("clauses", lambda c: F.struct(at(c).alias("a"), (at(c) + F.char_length(c)).alias("b"), F.instr(F.substring(F.col("text"), at(c) + 1, F.char_length("text")), c).alias("again")))
    rows = claims.select("claim_id", F.array_sort(spots).alias("s"))
    missing, repeated = F.exists("s", lambda x: x["a"] == 0), F.exists("s", lambda x: (x["a"] > 0) & (x["again"] > 0))
    overlap = F.exists(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i > 0) & (F.get(F.col("s"), i)["a"] < F.get(F.col("s"), i - 1)["b"]))
    return raised(
        rows.where(F.size("s") > 0),
        "claim_id",
        [
            issue(missing, "clause_missing", "error", "a bound clause isn't in the text"),
            issue(repeated, "clause_repeated", "error", "a bound clause occurs more than once"),
            issue(~missing & ~repeated & overlap, "clauses_overlap", "error", "bound clauses overlap"),
        ],
    )


def opportunity_numbers(rows: DataFrame) -> DataFrame:
    """Numbers (opportunity_id, value) that an opportunity's text states and its quote doesn't."""
    said = F.array_except(fx.numerals(F.col("text")), fx.numerals(F.coalesce("quote", F.lit(""))))
    return rows.select("opportunity_id", F.explode(said).alias("value"))


def opportunity_issues(candidates: DataFrame, mentions: DataFrame, assignments: DataFrame, stored: DataFrame, now: DataFrame) -> DataFrame:
    """Opportunities (opportunity_id, question_id, theme_id, mention_id, text) against the evidence as it is when they are rendered.

    Evidence must be a retained mention of the question that is assigned to the theme; the theme must be shown, and its
    published count (stored: theme_id, mention_count) the one that is counted now (now: theme_id, mention_count, demoted).
    """
    held = mentions.select("mention_id", "question_id").distinct().withColumn("_held", F.lit(True))
    given = assignments.select("mention_id", "theme_id").distinct().withColumn("_given", F.lit(True))
    counted = now.select("theme_id", F.col("mention_count").alias("_now"), "demoted").join(stored.select("theme_id", F.col("mention_count").alias("_stored")), "theme_id", "left")
    rows = candidates.join(held, ["mention_id", "question_id"], "left").join(given, ["mention_id", "theme_id"], "left").join(counted, "theme_id", "left")
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    return raised(
        rows,
        "opportunity_id",
        [
            issue(blank, "field", "error", "a field is empty"),
            issue(F.col("_held").isNull(), "evidence", "error", "its evidence isn't a retained mention of the question"),
            issue(F.col("_given").isNull(), "theme", "error", "its evidence isn't assigned to the theme"),
            issue(F.coalesce("demoted", F.lit(False)), "demoted", "error", "its theme isn't shown"),
            issue(F.col("_now").isNotNull() & ~F.col("_now").eqNullSafe(F.col("_stored")), "stale", "error", "the published count of its theme is stale"),
        ],
    )


def inline_quote_issues(claims: DataFrame, checked: DataFrame) -> DataFrame:
    """Claims (claim_id, text, scope, source_quote) that quote what wasn't checked (checked: quote), or leave a quotation open.

    The text of a claim that copies a source case (its ``source_quote`` isn't null) may quote parts of that quote, and
    nothing else; parts begin and end with a word.
    """
    fields = claims.select("claim_id", "source_quote", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c), F.lit("")).alias("body")) for c in ("text", "scope")])).alias("f")).select("claim_id", "source_quote", "f.*")
    read = fields.withColumn("open", F.size(prose.column("unmatched_marks")("body")) > 0).withColumn("spans", prose.column("quotations")("body"))
    said = read.select("claim_id", "source_quote", "field", F.explode(F.concat(F.transform("spans", lambda s: s["quote"]), fx.block_quotes(F.col("body")))).alias("quote")).withColumn("quote", normalized(F.col("quote")))
    own = F.col("source_quote").isNotNull() & (F.col("field") == "text")
    inside = (F.col("quote") != "") & F.regexp_like(normalized(F.col("source_quote")), F.concat(F.lit(r"(?U)(?<!\w)\Q"), "quote", F.lit(r"\E(?!\w)")))
    known = checked.select(normalized(F.col("quote")).alias("quote")).distinct()
    foul = said.where(own & ~inside).select("claim_id").unionByName(said.where(~own).join(known, "quote", "left_anti").select("claim_id"))
    left_open = read.where("open").select("claim_id").distinct()
    none = F.lit(True)
    return raised(left_open, "claim_id", [issue(none, "open_quotation", "editorial", "a quotation isn't closed")]).unionByName(
        raised(foul.distinct(), "claim_id", [issue(none, "inline_quote", "editorial", "quotes what wasn't checked")])
    )
