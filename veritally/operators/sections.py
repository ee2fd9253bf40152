"""The text of reports as columns: cells, tables and sections of a question are written where its counts are.

A question has some dozens of themes and a theme at most five sample quotes, so that a section is one bounded string; the
driver only joins sections. Null or empty parts leave no trace: no heading, no blank line.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritally.semantics import pct

LARGE_OTHER = 15  #: percent of mentions over which ``other`` shows all of its quotes
BREAK, GAP = "\n", "\n\n"


def cell(text: Column) -> Column:
    """Text inside a table cell: on one line, signs that mark up escaped."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]", " "), r"([\\|*_`\[\]#>])", r"\\$1")


def _if(text: Column, *around: Column | str) -> Column:
    """The text with what stands around it (``None`` marks its place), null if it is null or empty."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(text != "", F.concat(*[text if x is None else lit(x) for x in around]))


def _joined(parts: list[Column], by: str) -> Column:
    return F.concat_ws(by, *parts)  # leaves nulls out


def _ordered(place: list[Column | str], text: Column, by: str) -> Column:
    """An aggregate: texts joined in the order of their places."""
    rows = F.array_sort(F.collect_list(F.struct(*place, text.alias("_text"))))
    return F.array_join(F.transform(rows, lambda x: x["_text"]), by)


def shown_quotes(picked: DataFrame, flagged: DataFrame, most: int = 3) -> DataFrame:
    """Sample quotes that a theme shows, notable ones first: ``most`` of them, all for an ``other`` with over 15 percent."""
    rows = picked.join(flagged.where(~F.col("demoted")).select("theme_id", "type", "mention_pct"), "theme_id")
    w = Window.partitionBy("theme_id").orderBy(~F.coalesce("notable_quote", F.lit(False)), "pick")
    whole = (F.col("type") == "other") & (F.col("mention_pct") > LARGE_OTHER)
    return rows.withColumn("place", F.row_number().over(w).cast("long")).where((F.col("place") <= most) | whole)


def quote_cells(shown: DataFrame) -> DataFrame:
    """(theme_id, quotes): what a theme's cell of quotes says, who said it and where."""
    said = F.concat(F.lit('"'), cell(F.col("quote")), F.lit('"'), F.coalesce(_if(cell(F.col("quote_attribution")), " — ", None), F.lit("")), F.coalesce(_if(cell(F.col("file_id")), " (", None, ")"), F.lit("")))
    return shown.where("quote <> ''").groupBy("theme_id").agg(_ordered(["place"], said, " • ").alias("quotes"))


def _table(rows: DataFrame, head: list[tuple[str, Column, Column]]) -> DataFrame:
    """(question_id, table) from rows (question_id, type, mention_count, theme_id); head: titles, cells, and whether to show them."""
    line = lambda cells: F.concat(F.lit("| "), _joined(cells, " | "), F.lit(" |"))
    rows = rows.withColumns({"_line": line([F.when(on, text) for _, text, on in head]), "_head": line([F.when(on, F.lit(title)) for title, _, on in head]), "_rule": line([F.when(on, F.lit("---")) for _, _, on in head])})
    order = [(F.col("type") == "other").alias("a"), (-F.col("mention_count")).alias("b"), F.col("theme_id").alias("c")]
    out = rows.groupBy("question_id").agg(F.first("_head").alias("_head"), F.first("_rule").alias("_rule"), _ordered(order, F.col("_line"), BREAK).alias("_body"))
    return out.select("question_id", F.concat_ws(BREAK, "_head", "_rule", "_body").alias("table"))


def theme_tables(flagged: DataFrame, labels: DataFrame, cells: DataFrame, segments: DataFrame) -> DataFrame:
    """(question_id, table): kept themes, ``other`` last, the most mentioned first; sources and segments where there is more than one.

    labels: theme_id, label, description. cells: of ``quote_cells``. segments: theme_id, segment, a row for each pair.
    """
    names = segments.groupBy("theme_id").agg(F.array_join(F.array_sort(F.collect_set("segment")), ", ").alias("_segments"))
    rows = flagged.where(~F.col("demoted")).join(labels.select("theme_id", "label", "description"), "theme_id", "left").join(cells, "theme_id", "left").join(names, "theme_id", "left")
    always, text = F.lit(True), lambda c: F.col(c).cast("string")
    return _table(
        rows,
        [
            ("Theme", cell(F.coalesce("label", "theme_id")), always),
            ("Description", cell(F.col("description")), always),
            ("Mentions", text("mention_count"), always),
            ("%", F.concat(text("mention_pct"), F.lit("%")), always),
            ("Sources", F.concat(text("source_type_count"), F.lit("/"), text("total_source_types")), F.col("total_source_types") > 1),
            ("Segments", cell(F.col("_segments")), F.col("total_segments") > 1),
            ("Key Quotes", F.coalesce("quotes", F.lit(" ")), always),
        ],
    )


def compact_tables(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """(question_id, table) as a context document has it: counts and sources only."""
    rows = flagged.where(~F.col("demoted")).join(labels.select("theme_id", "label"), "theme_id", "left")
    always, text = F.lit(True), lambda c: F.col(c).cast("string")
    columns = [
        ("Theme", cell(F.coalesce("label", "theme_id")), always),
        ("Mentions", text("mention_count"), always),
        ("%", F.concat(text("mention_pct"), F.lit("%")), always),
        ("Sources", F.concat(text("source_type_count"), F.lit("/"), text("total_source_types")), always),
    ]
    return _table(rows, columns)


def _quoted(quote: Column, by: Column) -> Column:
    return _if(quote, '> "', None, '"', F.coalesce(_if(by, "\n> — ", None), F.lit("")))


def _listed(items: Column) -> Column:
    return F.array_join(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), x)), BREAK)


def question_sections(totals: DataFrame, tables: DataFrame, leads: DataFrame, written: DataFrame) -> DataFrame:
    """(question_id, section) of a full report: size, a note on thin evidence, lead quote, theme table, synthesis, takeaways.

    leads: question_id, quote, quote_attribution, at most one each. written: question_id, question, synthesis, takeaways.
    """
    rows = written.join(totals, "question_id", "left").join(tables, "question_id", "left").join(leads.select("question_id", "quote", "quote_attribution"), "question_id", "left")
    n = F.col("total_mentions").cast("string")
    size = F.concat(F.lit("n = "), n, F.lit(" mentions"), F.when(F.col("total_source_types") > 1, F.concat(F.lit(" from "), F.col("total_source_types"), F.lit(" sources"))).otherwise(""))
    thin = F.when(F.col("sparse"), F.concat(F.lit("> **Note:** Based on "), n, F.lit(" mentions. Treat as directional signals, not patterns.")))
    parts = [
        F.concat(F.lit("## "), "question_id", F.lit(": "), F.coalesce("question", F.lit(""))),
        size,
        thin,
        _quoted(F.col("quote"), F.col("quote_attribution")),
        F.col("table"),
        _if(F.col("synthesis"), "### Synthesis\n\n", None),
        _if(_listed(F.col("takeaways")), "### Takeaways\n\n", None),
    ]
    return rows.select("question_id", _joined(parts, GAP).alias("section"))


def context_sections(tables: DataFrame, quotes: DataFrame, written: DataFrame) -> DataFrame:
    """(question_id, section) of a context document: the summary, the compact table, then quotes (question_id, place, quote, quote_attribution)."""
    said = quotes.groupBy("question_id").agg(_ordered(["place"], _quoted(F.col("quote"), F.col("quote_attribution")), GAP).alias("_quotes"))
    rows = written.join(tables, "question_id", "left").join(said, "question_id", "left")
    parts = [F.concat(F.lit("## "), "question_id", F.lit(": "), F.coalesce("question", F.lit(""))), F.when(F.col("synthesis") != "", F.col("synthesis")), F.col("table"), _if(F.col("_quotes"), None)]
    return rows.select("question_id", _joined(parts, GAP).alias("section"))


def header(method: DataFrame, totals: DataFrame, types: DataFrame, title: str, day: date | None = None) -> DataFrame:
    """One row ``header``: title, date, files by type with the most frequent first, questions and mentions.

    method: of ``counting.methodology``. totals: of ``counting.header_totals``. types: of ``counting.ranked_source_types``.
    """
    kinds = types.agg(_ordered(["place"], F.concat(F.col("n").cast("string"), F.lit(" "), F.lower("source_type")), ", ").alias("_types"))
    row = method.crossJoin(totals).crossJoin(kinds)  # one row each
    files = F.concat(F.lit("**Sources:** "), F.col("source_count").cast("string"), F.lit(" files"), F.coalesce(_if(F.col("_types"), " (", None, ")"), F.lit("")))
    lines = [F.lit(f"# {title}\n"), F.lit(f"**Date:** {(day or date.today()).isoformat()}"), files, F.concat(F.lit("**Questions:** "), F.col("questions").cast("string")), F.concat(F.lit("**Mentions retained:** "), F.col("total_mentions").cast("string"))]
    return row.select(_joined(lines, BREAK).alias("header"))


def front_matter(method: DataFrame, totals: DataFrame, audit: DataFrame, company: str = "", day: date | None = None) -> DataFrame:
    """One row ``front``: the YAML block of a context document; without audited mentions the pass rate is null.

    audit: ``passed`` and ``total``.
    """
    row = method.crossJoin(totals.select("total_mentions", "questions")).crossJoin(audit.select("passed", "total"))  # one row each
    say = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"))
    rate = F.when(F.col("total") > 0, pct(F.col("passed"), F.col("total")).cast("string")).otherwise("null")
    named = company.replace('"', '\\"')
    lines = [F.lit("---"), *([F.lit(f'company: "{named}"')] if company else []), F.lit(f"date: {(day or date.today()).isoformat()}"), say("source_count", F.col("source_count")), say("mention_count", F.col("total_mentions")), say("question_count", F.col("questions")), say("audit_pass_rate", rate), F.lit("---")]
    return row.select(_joined(lines, BREAK).alias("front"))


def evidence_notes(claims: DataFrame, mentions: DataFrame) -> DataFrame:
    """(claim_id, note): of each claim (claim_id, question_id, claim_text, scope, support ids) its own files among those of its question."""
    rows = claims.select("claim_id", F.explode("support_mention_ids").alias("mention_id")).join(mentions.select("mention_id", "file_id"), "mention_id")
    own = rows.groupBy("claim_id").agg(F.countDistinct("file_id").alias("_own"))
    whole = mentions.groupBy("question_id").agg(F.countDistinct("file_id").alias("_whole"))
    both = claims.join(own, "claim_id", "left").join(whole, "question_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    note = F.concat(F.lit("Evidence for "), "claim_id", F.lit(": "), n("_own"), F.lit(" of "), n("_whole"), F.lit(" "), "question_id", F.lit(" source files support this claim. "), F.coalesce("claim_text", F.lit("")), F.lit(" Scope: "), F.coalesce("scope", F.lit("")))
    return both.select("claim_id", note.alias("note"))


def executive_section(summary: DataFrame, *keys: str) -> DataFrame:
    """A row (keys, ``executive``) for each summary: headline, context, findings with their notes, outcomes with who said so, open questions.

    summary: headline, body, findings array<struct<text, notes array<string>>>, outcomes array<struct<outcome, quote,
    attribution>>, open_questions array<string>.
    """
    found = lambda x: F.concat(F.lit("- "), x["text"], F.array_join(F.transform(F.coalesce(x["notes"], F.array().cast("array<string>")), lambda n: F.concat(F.lit("\n\n  "), n)), ""))
    mark = lambda t, a, b: F.when(t != "", F.concat(F.lit(a), t, F.lit(b))).otherwise("")
    came = lambda x: F.concat(F.lit("- **"), x["outcome"], F.lit("**"), F.coalesce(mark(x["quote"], '\n  > "', '"'), F.lit("")), F.coalesce(mark(x["attribution"], "\n  > — ", ""), F.lit("")))
    parts = [
        F.when(F.col("headline") != "", F.col("headline")),
        _if(F.trim(F.regexp_replace(F.coalesce("body", F.lit("")), r"\n\s*\n", GAP)), "## Context\n\n", None),
        _if(F.array_join(F.transform("findings", found), BREAK), "## Key Findings\n\n", None),
        _if(F.array_join(F.transform("outcomes", came), GAP), "## Notable Outcomes\n\n", None),
        _if(_listed(F.col("open_questions")), "## Open Questions\n\n", None),
    ]
    return summary.select(*keys, _joined(parts, GAP).alias("executive"))


def written_out(*frames: DataFrame, most: int = 10_000) -> str:
    """Markdown of a report on the driver: the text (last) column of each frame, by question where it has one."""
    texts = []
    for df in frames:
        by = "question_id" in df.columns
        rows = (df.orderBy("question_id") if by else df).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError("a report is made from a section for each question; there are more")
        texts += [r[-1] for r in rows if r[-1]]
    return GAP.join(texts) + BREAK
