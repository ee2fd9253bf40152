"""Validators: rows in, issue rows out (entity_key, check_name, severity, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritally import schemas
from veritally.functions import text as fx
from veritally.operators.grounding import grounded
from veritally.semantics import n_words, squeezed
from veritally.sources.staging import dealt

REUSE_CAP = 5
SINGLE, MULTI = (6, 12), (25, 35)  #: mentions a question from one source: more than these warn, or fail


def issue(when: Column, check: str, severity: str, message: Column | str) -> Column:
    said = message if isinstance(message, Column) else F.lit(message)
    return F.when(when, F.struct(F.lit(check).alias("check_name"), F.lit(severity).alias("severity"), said.alias("message")))


def raised(rows: DataFrame, key: Column | str, issues: list[Column]) -> DataFrame:
    """The issues of each row, in one pass."""
    key = F.col(key) if isinstance(key, str) else key
    flat = F.filter(F.array(*issues), lambda x: x.isNotNull())
    return rows.select(key.cast("string").alias("entity_key"), F.explode(flat).alias("_i")).select("entity_key", "_i.*")


def together(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _say(key: str, check: str, severity: str, message: str) -> list[Column]:
    return [F.col(key).cast("string").alias("entity_key"), F.lit(check).alias("check_name"), F.lit(severity).alias("severity"), F.lit(message).alias("message")]


def repeated(rows: DataFrame, key: str, check: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*_say(key, check, "error", "appears more than once"))


def foreign(rows: DataFrame, key: str, known: DataFrame, known_key: str, check: str, by: str | None = None) -> DataFrame:
    """Rows whose ``by`` (else key) isn't known."""
    by = by or key
    ids = known.select(F.col(known_key).alias(by)).distinct()
    return rows.where(F.col(by).isNotNull()).join(ids, by, "left_anti").select(*_say(key, check, "error", "refers to nothing"))


def exact_cover(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """Ids that are missing, invented or repeated: both sides are counted by id in one pass. An absent id equals no other."""
    side = lambda d, wanted, had: d.select(key, F.lit(wanted).alias("_wanted"), F.lit(had).alias("_had"))
    n = dealt(side(expected, 1, 0).unionByName(side(got, 0, 1)), key).groupBy(key).agg(F.sum("_wanted").alias("_wanted"), F.sum("_had").alias("_had"))
    none, wanted, had = F.col(key).isNull(), F.col("_wanted") > 0, F.col("_had") > 0
    return raised(
        n,
        key,
        [
            issue(wanted & (none | ~had), "missing", "error", "expected, not returned"),
            issue(had & (none | ~wanted), "invented", "error", "returned, not expected"),
            issue(F.col("_had") > 1, "duplicate", "error", "appears more than once"),
        ],
    )


def plan(files: DataFrame, questions: DataFrame, segments: DataFrame) -> DataFrame:
    """Enumerations, the exclusion rule, unique ids and the reference of files to segments."""
    own = raised(
        files,
        "file_id",
        [
            issue(~F.col("source_type").isin(schemas.SOURCE_TYPES), "source_type", "error", "not a source type"),
            issue(~F.col("lifecycle").isin(schemas.LIFECYCLES), "lifecycle", "error", "not a lifecycle"),
            issue(~F.col("quality").isin(schemas.QUALITIES), "quality", "error", "not a quality"),
            issue(F.coalesce("excluded", F.lit(False)) & (F.coalesce("exclusion_reason", F.lit("")) == ""), "exclusion_reason", "error", "excluded without a reason"),
            issue(F.coalesce("interaction_count", F.lit(1)) < 1, "interaction_count", "error", "under one"),
        ],
    )
    asked = raised(questions, "question_id", [issue(~F.col("question_id").rlike(schemas.QUESTION_ID), "question_id", "error", "not a question id")])
    used = files.where(F.col("segment") != schemas.UNKNOWN_SEGMENT)
    return together(own, asked, repeated(files, "file_id", "file_unique"), repeated(questions, "question_id", "question_unique"), repeated(segments, "id", "segment_unique"), foreign(used, "file_id", segments, "id", "segment", "segment"))


#: Parts of file names and the source types that they suggest. Fixed values.
HINTS = {"nps": "nps_survey", "csat": "csat_survey", "survey": "general_survey", "churn": "churn_interview", "renewal": "renewal_call", "ticket": "support_ticket", "review": "review", "call": "sales_call"}
COUNTED = r"(?i)\b(\d+)\s+(?:responses|reviews|tickets|deals|requests|respondents|entries)\b"


def classification(rows: DataFrame, expected: DataFrame, most_summary: int = 150) -> DataFrame:
    """Exact ids; advice where the name suggests another type, or a summary counts what interaction_count doesn't say."""
    hint = None
    for part, kind in HINTS.items():
        on = F.lower("file_id").contains(part)
        hint = F.when(on, kind) if hint is None else hint.when(on, kind)
    own = raised(
        rows,
        "file_id",
        [
            issue(hint.isNotNull() & (hint != F.col("source_type")), "name_hint", "warning", F.concat(F.lit("the name suggests "), hint)),
            issue((F.try_to_number(F.nullif(F.regexp_extract("summary", COUNTED, 1), F.lit("")), F.lit("999999999")) >= 5) & F.col("interaction_count").isNull(), "count_hint", "warning", "the summary counts interactions"),
            issue(F.char_length("summary") > most_summary, "summary", "warning", "summary is cut"),
        ],
    )
    return together(own, exact_cover(expected, rows, "file_id"))


def fixed_classification(rows: DataFrame, most_summary: int = 150) -> DataFrame:
    return rows.withColumn("summary", fx.truncated(F.col("summary"), most_summary))


def mentions(rows: DataFrame, questions: DataFrame, files: DataFrame) -> DataFrame:
    """All checks of mentions: ids, references, quotes, reuse and caps."""
    q, n = F.col("quote"), n_words(F.col("quote"))
    some = F.coalesce(q, F.lit("")) != ""
    own = raised(
        rows,
        "mention_id",
        [
            issue(~F.col("mention_id").rlike(schemas.MENTION_ID), "mention_id", "error", "not a mention id"),
            issue(~F.startswith("mention_id", F.concat("file_id", F.lit("_"), "question_id", F.lit("_"))), "id_prefix", "error", "not of its file and question"),
            issue(~F.col("sentiment").isin(schemas.SENTIMENTS), "sentiment", "error", "not a sentiment"),
            issue(some & (q == F.col("mention")), "quote_is_mention", "error", "quote and mention are the same"),
            issue(some & fx.is_csv_row(q), "csv_quote", "warning", "looks like a row of data"),
            issue(some & fx.has_markdown(q), "markdown_quote", "warning", "holds markup"),
            issue(some & fx.is_low_signal(q), "low_signal", "warning", "about the call or the speaker"),
            issue(F.trim(F.coalesce("quote_attribution", F.lit(""))) == "", "attribution", "warning", "nobody to attribute to"),
            issue(some & (n > 100), "quote_long", "error", "over 100 words"),
            issue(some & (n < 6), "quote_short", "warning", "under 6 words"),
            issue(some & q.rlike(r"\d{2}:\d{2}:\d{2}"), "timestamp", "warning", "holds transcript marks"),
            issue(some & F.col("notable_quote") & (n < 8), "notable_short", "warning", "notable with under 8 words"),
        ],
    )
    same = squeezed(F.col("mention"))
    first = rows.groupBy("file_id", same.alias("_m")).agg(F.min("mention_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and _m <> ''")
    alike = rows.withColumn("_m", same).join(first, ["file_id", "_m"]).where("mention_id <> _first").select(*_say("mention_id", "mention_unique", "error", "the same text as another"))
    return together(own, repeated(rows, "mention_id", "id_unique"), alike, foreign(rows, "mention_id", questions, "question_id", "question", "question_id"), quote_reuse(rows), mention_caps(rows, files))


def quote_reuse(rows: DataFrame, cap: int = REUSE_CAP) -> DataFrame:
    """Each use of a quote within a source after the fifth."""
    w = Window.partitionBy("file_id", "_q").orderBy("mention_id")
    used = rows.where("quote is not null and quote <> ''").withColumn("_q", squeezed(F.col("quote"))).withColumn("_n", F.row_number().over(w))
    return used.where(F.col("_n") > cap).select(*_say("mention_id", "quote_reuse", "warning", "quote used too often"))


def mention_caps(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Counts of mentions by source and question beyond what a single or a multiple interaction should give."""
    n = rows.groupBy("file_id", "question_id").agg(F.count(F.lit(1)).alias("n")).join(files.select("file_id", "interaction_count"), "file_id", "left")
    many = F.coalesce("interaction_count", F.lit(1)) > 1
    bar = lambda i: F.when(many, F.lit(MULTI[i])).otherwise(F.lit(SINGLE[i]))
    key = F.concat_ws("|", "file_id", "question_id")
    return raised(n, key, [issue(F.col("n") > bar(1), "mention_cap", "error", "far too many mentions"), issue((F.col("n") > bar(0)) & (F.col("n") <= bar(1)), "mention_cap", "warning", "many mentions")])


def records(rows: DataFrame, files: DataFrame, sources: DataFrame, owners: DataFrame) -> DataFrame:
    """A record for each active source, ids unique over all of them, quotes grounded."""
    loose = grounded(rows.where("quote is not null and quote <> ''"), sources).where(~F.col("grounded")).select(*_say("mention_id", "grounding", "error", "quote isn't in its source"))
    return together(exact_cover(files, owners, "file_id"), repeated(rows, "mention_id", "id_unique"), loose)


def themes(rows: DataFrame) -> DataFrame:
    """Ids that are unique and of their question, types, labels without numbers."""
    own = raised(
        rows,
        "theme_id",
        [
            issue(~F.col("theme_id").rlike(schemas.THEME_ID), "theme_id", "error", "not a theme id"),
            issue(~F.startswith("theme_id", F.concat("question_id", F.lit("_"))), "owner", "error", "of another question"),
            issue(~F.col("type").isin(schemas.THEME_TYPES), "type", "error", "not a theme type"),
            issue(fx.number_in_label(F.col("label")) | fx.number_in_label(F.col("description")), "numbers", "error", "states a number"),
            issue(F.char_length("label") > 80, "label", "error", "label over 80 characters"),
            issue(F.char_length("description") > 200, "description", "error", "description over 200 characters"),
        ],
    )
    return together(own, repeated(rows, "theme_id", "theme_unique"))


def numbered_themes(rows: DataFrame) -> DataFrame:
    """Themes with malformed ids get the numbers after the highest, in order of their ids."""
    fine = F.col("theme_id").rlike(schemas.THEME_ID)
    number = F.when(fine, F.regexp_extract("theme_id", r"_T(\d+)$", 1).cast("int")).otherwise(0)
    w = Window.partitionBy("question_id")
    place = F.row_number().over(Window.partitionBy("question_id", fine).orderBy("theme_id", "label"))
    new = F.concat("question_id", F.lit("_T"), F.max(number).over(w) + place)
    return rows.withColumn("theme_id", F.when(fine, F.col("theme_id")).otherwise(new))


def theme_budget(themes_: DataFrame, mentions_: DataFrame) -> DataFrame:
    """Questions with more themes than a quarter of their mentions, or more than one ``other``."""
    n = mentions_.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_mentions"))
    t = themes_.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_themes"), F.sum((F.col("type") == "other").cast("int")).alias("n_other"))
    both = t.join(n, "question_id", "left").withColumn("n_mentions", F.coalesce("n_mentions", F.lit(0)))
    return raised(both, "question_id", [issue(F.col("n_themes") * 4 > F.col("n_mentions"), "theme_budget", "warning", "too many themes"), issue(F.col("n_other") > 1, "other", "warning", "more than one other")])


def assignments(expected: DataFrame, rows: DataFrame, themes_: DataFrame) -> DataFrame:
    """Each mention once, each theme known."""
    return together(exact_cover(expected, rows, "mention_id"), foreign(rows, "mention_id", themes_, "theme_id", "theme", "theme_id"))


def distribution(rows: DataFrame, themes_: DataFrame) -> DataFrame:
    """Themes with over 40 percent of a question's assignments, ``other`` with over 25."""
    n = rows.groupBy("question_id", "theme_id").agg(F.count(F.lit(1)).alias("n"))
    n = n.join(themes_.select("theme_id", "type"), "theme_id", "left").withColumn("total", F.sum("n").over(Window.partitionBy("question_id")))
    other = F.coalesce("type", F.lit("other")) == "other"
    bar = F.when(other, 25).otherwise(40)
    return raised(n, "theme_id", [issue(F.col("n") * 100 > F.col("total") * bar, "distribution", "warning", "too large a share")])


def report(questions: DataFrame, sections: DataFrame) -> DataFrame:
    """Coverage of questions, and lengths: synthesis of 80 to 220 words in up to 3 paragraphs, headline up to 120 characters."""
    n = n_words(F.col("synthesis"))
    own = raised(
        sections,
        "question_id",
        [
            issue(F.col("synthesis").isNotNull() & ~n.between(80, 220), "synthesis_words", "warning", "outside 80 to 220 words"),
            issue(F.size(F.filter(F.split("synthesis", r"\n\s*\n"), lambda x: F.trim(x) != "")) > 3, "paragraphs", "warning", "over 3 paragraphs"),
            issue(F.char_length("headline") > 120, "headline", "warning", "over 120 characters"),
            issue(F.contains("synthesis", F.lit("\\n")), "newlines", "warning", "escaped line breaks"),
            issue(fx.number_in_label(F.col("headline")), "headline_number", "error", "states a number"),
        ],
    )
    return together(own, exact_cover(questions, sections, "question_id"))


def adjectives(rows: DataFrame, key: str = "id", text: str = "text", reach: int = 80) -> DataFrame:
    """Words that stand for a band of shares, near a percentage outside the band."""
    number = F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)\s*%"), F.lit(1))
    gap = F.split(text, r"\d+(?:\.\d+)?\s*%", -1)
    pairs = rows.select(F.col(key).alias("_k"), F.posexplode(F.arrays_zip(number.alias("p"), gap.alias("a"), F.slice(gap, 2, F.size(gap)).alias("b"))).alias("_at", "_x")).where("_x.p is not null")
    window = F.lower(F.concat(F.right(F.col("_x.a"), F.lit(reach)), F.lit(" "), F.left(F.col("_x.b"), F.lit(reach))))
    pct = F.bround(F.col("_x.p").cast("double"))
    issues = [issue(window.rlike(rf"(?<!\w){word}(?!\w)") & ~((pct >= low) & (pct < high)), f"adjective_{word}", "warning", F.concat(F.lit(f"{word} near "), pct.cast("int"), F.lit("%"))) for low, high, names in schemas.BANDS for word in names.split()]
    return raised(pairs, "_k", issues)


def ordinal_claims(claims: DataFrame, ranked: DataFrame) -> DataFrame:
    """Claims (claim_id, question_id, theme_id, text) to be the most common of a theme that isn't strictly first."""
    first = ranked.where("rank = 1 and strict").select("question_id", F.col("theme_id").alias("_first"))
    rows = claims.join(first, "question_id", "left")
    return raised(rows, "claim_id", [issue(F.lower("text").rlike(fx.RANKED) & ~F.coalesce(F.col("theme_id") == F.col("_first"), F.lit(False)), "ordinal", "error", "isn't the first")])


def quantities(prose: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Prose that should state no counts, ratios or majorities."""
    t = F.lower(text)
    return raised(prose, key, [issue(t.rlike(r"\d+\s*(?:%|percent)|\d+\s+(?:of|out of)\s+\d+"), "ratio", "error", "states a share"), issue(t.rlike(fx.BREADTH), "breadth", "error", "states breadth")])


def quality_scores(claims: DataFrame) -> DataFrame:
    """Claims whose four scores aren't 0 to 3, or have one under 2 and so are left out."""
    parts = ["relevance", "support", "added_value", "clarity"]
    off = reduce(Column.__or__, [~F.coalesce(F.col(f"quality.{p}").between(0, 3), F.lit(False)) for p in parts])
    low = reduce(Column.__or__, [F.col(f"quality.{p}") < 2 for p in parts])
    return raised(claims, "claim_id", [issue(off, "scores", "error", "not 0 to 3"), issue(~off & low, "scores", "editorial", "under 2")])


def closure(bad_quotes: DataFrame, claims: DataFrame, selections: DataFrame) -> DataFrame:
    """What falls with bad quotes: claims that cite them, and selections of those claims; one step, no recursion."""
    cites = claims.select("claim_id", F.explode("support_mention_ids").alias("mention_id")).join(bad_quotes.select("mention_id"), "mention_id").select("claim_id").distinct()
    chosen = selections.select("selection_id", F.explode("claim_ids").alias("claim_id")).join(cites, "claim_id").select("selection_id").distinct()
    return together(cites.select(*_say("claim_id", "cites_dropped_quote", "editorial", "cites a dropped quote")), chosen.select(*_say("selection_id", "selects_dropped_claim", "editorial", "selects a dropped claim")))


def changed(stored: DataFrame, now: DataFrame) -> DataFrame:
    """Rows of a stored result that a new computation doesn't give, and the other way round."""
    return together(stored.exceptAll(now).withColumn("side", F.lit("stored")), now.exceptAll(stored).withColumn("side", F.lit("now")))


def html(pages: DataFrame, key: str = "page_id", text: str = "html") -> DataFrame:
    """Required ids, charts, links to ids, accessibility, leftovers of markup, the end of the document, styles."""
    h = F.coalesce(text, F.lit(""))
    rows = pages.select(key, h.alias("_h"))
    h = F.col("_h")
    links = F.regexp_extract_all(h, F.lit('href="#([^"]+)"'), F.lit(1))
    ids = F.regexp_extract_all(h, F.lit("\\bid=[\"']([^\"']+)[\"']"), F.lit(1))
    has = lambda s: F.contains(h, F.lit(s))
    questions = h.rlike('id="Q\\d+"')
    return raised(
        rows,
        key,
        [
            issue(~has('id="executive-summary"'), "section_summary", "error", "no summary"),
            issue(~has('id="methodology"'), "section_methodology", "error", "no methodology"),
            issue(~questions, "section_questions", "warning", "no questions"),
            issue(questions & ~has("chart-container"), "charts", "warning", "no charts"),
            issue(F.size(F.array_except(links, ids)) > 0, "nav_links", "error", F.concat(F.lit("links to nothing: "), F.size(F.array_except(links, ids)))),
            issue(~has("skip-link"), "skip_link", "error", "no skip link"),
            issue(~has("aria-label="), "aria_label", "warning", "no labels"),
            issue(~has("outline:") | ~has(":focus"), "focus", "warning", "no focus outline"),
            issue(h.rlike(r"(?m)^### |^---\s*$|\[\[|\*\*[^*]+\*\*"), "markdown", "error", "markup left over"),
            issue(~F.endswith(F.regexp_replace(h, r"\s+$", ""), F.lit("</html>")), "closes", "error", "doesn't end"),
            issue(has("box-shadow") | has("linear-gradient") | has("radial-gradient"), "style", "warning", "shadows or gradients"),
            issue(~has("--primary"), "colors", "warning", "no primary color"),
        ],
    )


def markdown(rows: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """A title, headings, tables that are whole, no tags, no empty sections."""
    t = F.coalesce(text, F.lit(""))
    return raised(
        rows,
        key,
        [
            issue(~t.rlike(r"\A\s*# \S"), "title", "error", "no title"),
            issue(~t.rlike(r"(?m)^## "), "headings", "error", "no headings"),
            issue(t.rlike(r"(?m)^\|.*[^|\s]\s*$"), "tables", "error", "a table row isn't closed"),
            issue(t.rlike(r"(?i)</?(?:div|span|table|p|br)\b"), "tags", "error", "holds tags"),
            issue(t.rlike(r"(?m)^(#{2,}) .*\n\s*\n?^\1 "), "empty_section", "warning", "an empty section"),
        ],
    )


def context_words(rows: DataFrame) -> DataFrame:
    """Compressed context: 60 to 100 words an answer, 2 or 3 quotes, quotes as they were."""
    n = n_words(F.col("summary"))
    return raised(rows, "question_id", [issue(~n.between(60, 100), "words", "warning", "outside 60 to 100 words"), issue(~F.size("quotes").between(2, 3), "quotes", "error", "not 2 or 3 quotes"), issue(F.size(F.array_except("quotes", "known_quotes")) > 0, "verbatim", "error", "a quote was changed")])


def disjoint(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Ids that two sets share which must be apart."""
    return rows.select(key).distinct().join(others.select(key).distinct(), key).select(*_say(key, "shared", "error", "stands on both sides"))


MODES = ["sampled", "skip"]
SAMPLE = {"mentions": 20, "sources": 6}  #: the largest audit sample


def requests(rows: DataFrame) -> DataFrame:
    """Audit requests (request_id, mode, mentions, sources) of an unknown mode, or with a sample out of its limits."""
    off = reduce(Column.__or__, [~F.coalesce(F.col(c).between(1, most), F.lit(False)) for c, most in SAMPLE.items()])
    return raised(rows, "request_id", [issue(~F.coalesce(F.col("mode").isin(MODES), F.lit(False)), "mode", "error", "not a mode"), issue(off, "sample", "error", "out of the limits of a sample")])


def reconciliation(assigned: DataFrame, segments: DataFrame, files: DataFrame) -> DataFrame:
    """Segments (id) that are unique, assignments (file_id, segment_id) that cover all files once and name known segments."""
    named = assigned.where(F.col("segment_id") != schemas.UNKNOWN_SEGMENT)
    return together(exact_cover(files, assigned, "file_id"), repeated(segments, "id", "segment_unique"), foreign(named, "file_id", segments, "id", "segment", "segment_id"))


def analysis(themes_: DataFrame, rows: DataFrame, expected: DataFrame, nominations: DataFrame) -> DataFrame:
    """An analysis of questions: its themes, each mention assigned once, nominees that their theme has, no themes without evidence.

    nominations: theme_id, mention_id.
    """
    own = rows.select("theme_id", "mention_id").distinct().withColumn("_own", F.lit(True))
    foul = nominations.join(own, ["theme_id", "mention_id"], "left").where("_own is null")
    bare = themes_.join(expected.select("question_id").distinct(), "question_id", "left_anti")
    return together(
        themes(themes_),
        assignments(expected, rows, themes_),
        foul.select(*_say("theme_id", "nominee", "error", "the nominee isn't assigned to its theme")),
        bare.select(*_say("theme_id", "no_evidence", "error", "a theme of a question without mentions")),
    )
