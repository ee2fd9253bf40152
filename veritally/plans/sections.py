"""Queries on the text of reports: cells, tables, sections, headers and summaries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritally.operators import audit, counting, reporting, sections, selection
from veritally.plans.queries import FLAGGED, LATEST, SQL, TOTALS, Tables, _claims, pct, query
from veritally.sources.staging import dealt

DAY = date(2024, 1, 31)


def cell(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '[\r\n]', ' ', 'g'), '([\\|*_`\[\]#>])', '\\\1', 'g')"


_share = pct("mention_count", "total_mentions")
CELLS = f"""{FLAGGED}, sel as ({SQL["select_quotes"]}),
shown as (select s.*, f.type, {_share} as share, row_number() over (partition by s.theme_id order by not notable_quote, pick) as place from sel s join flagged f on s.theme_id = f.theme_id where not demoted),
cells as (select theme_id, string_agg('"' || {cell("quote")} || '" — customer (' || {cell("file_id")} || ')', ' • ' order by place) as quotes from shown where place <= 3 or (type = 'other' and share > 15) group by 1)"""
_rows = f"""kept as (select *, type = 'other' as last, 'theme ' || right(theme_id, 1) as label, {_share} || '%' as share from flagged where not demoted)"""


class Report(Tables):
    """What sections are made from."""

    def __init__(self, spark, sf_dir):
        super().__init__(spark, sf_dir)
        self.kept = self.flagged()

    def picked(self) -> DataFrame:
        return selection.select_quotes(self.mentions, self.assignments, self.themes)

    def cells(self, picked: DataFrame) -> DataFrame:
        return sections.quote_cells(sections.shown_quotes(picked, self.kept))

    def totals(self) -> DataFrame:
        return counting.question_totals(self.mentions, self.assignments, self.files)

    def written(self) -> DataFrame:
        rows = [(f"Q{k}", f"question {k}", "Said by many." if k % 2 else "", ["one", "two"] if k < 4 else []) for k in range(1, 6)]
        return self.spark.createDataFrame(rows, "question_id string, question string, synthesis string, takeaways array<string>")


@query(f"#{CELLS} select theme_id, quotes from cells")
def theme_quote_cells(spark, sf_dir):
    """Sample quotes as a theme table shows them."""
    t = Report(spark, sf_dir)
    return t.cells(t.picked())


@query(f"""#{CELLS}, {_rows},
seg as (select theme_id, {cell("string_agg(distinct segment, ', ' order by segment)")} as names from assignments a join placed p on a.mention_id = p.mention_id group by 1),
lines as (select k.*, '| ' || concat_ws(' | ', {cell("label")}, 'about ' || keyword, mention_count::varchar, share, case when total_source_types > 1 then source_type_count || '/' || total_source_types end,
  case when total_segments > 1 then coalesce(names, '') end, coalesce(quotes, ' ')) || ' |' as line from kept k join themes t on k.theme_id = t.theme_id left join seg on k.theme_id = seg.theme_id left join cells c on k.theme_id = c.theme_id),
tables as (select question_id, '| Theme | Description | Mentions | %' || case when any_value(total_source_types) > 1 then ' | Sources' else '' end || case when any_value(total_segments) > 1 then ' | Segments' else '' end || ' | Key Quotes |' || chr(10)
  || '| --- | --- | --- | ---' || case when any_value(total_source_types) > 1 then ' | ---' else '' end || case when any_value(total_segments) > 1 then ' | ---' else '' end || ' | --- |' || chr(10)
  || string_agg(line, chr(10) order by last, mention_count desc, theme_id) as body from lines group by 1),
leads as (select * from (select s.question_id, s.quote, row_number() over (partition by s.question_id order by c.type = 'other', c.mention_count desc, s.theme_id, not s.notable_quote, s.pick) as rn from sel s join counts c on s.theme_id = c.theme_id) where rn = 1)
select t.question_id, concat_ws(chr(10) || chr(10), '## ' || t.question_id || ': question ' || right(t.question_id, 1),
  'n = ' || t.total_mentions || ' mentions' || case when t.total_source_types > 1 then ' from ' || t.total_source_types || ' sources' else '' end,
  case when t.total_mentions < 15 then '> **Note:** Based on ' || t.total_mentions || ' mentions. Treat as directional signals, not patterns.' end,
  '> "' || l.quote || '"' || chr(10) || '> — customer', body, case when right(t.question_id, 1)::int % 2 = 1 then '### Synthesis' || chr(10) || chr(10) || 'Said by many.' end,
  case when right(t.question_id, 1)::int < 4 then '### Takeaways' || chr(10) || chr(10) || '- one' || chr(10) || '- two' end) as section
from totals t left join leads l on t.question_id = l.question_id left join tables b on t.question_id = b.question_id""")
def report_sections(spark, sf_dir):
    """A report's section for each question."""
    t = Report(spark, sf_dir)
    picked = t.picked()
    segments = dealt(t.assignments.select("theme_id", "mention_id"), "mention_id").join(dealt(counting.placed(t.mentions.select("mention_id", "file_id"), t.files).select("mention_id", "segment"), "mention_id"), "mention_id").select("theme_id", "segment").distinct()
    tables = sections.theme_tables(t.kept, t.themes, t.cells(picked), segments)
    leads = selection.pull_quotes(picked, t.kept.select("theme_id", "type", "mention_count"))
    return sections.question_sections(t.totals(), tables, leads, t.written())


@query(f"""#{FLAGGED}, {_rows}, sel as ({SQL["select_quotes"]}),
tables as (select question_id, '| Theme | Mentions | % | Sources |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) ||
  string_agg('| ' || {cell("label")} || ' | ' || mention_count || ' | ' || share || ' | ' || source_type_count || '/' || total_source_types || ' |', chr(10) order by last, mention_count desc, theme_id) as body from kept group by 1),
said as (select question_id, string_agg('> "' || quote || '"' || chr(10) || '> — customer', chr(10) || chr(10) order by place) as quotes
  from (select *, row_number() over (partition by question_id order by pick, theme_id) as place from sel) where place <= 3 group by 1)
select t.question_id, concat_ws(chr(10) || chr(10), '## ' || t.question_id || ': question ' || right(t.question_id, 1), case when right(t.question_id, 1)::int % 2 = 1 then 'Said by many.' end, body, quotes) as section
from totals t left join tables b on t.question_id = b.question_id left join said s on t.question_id = s.question_id""")
def context_sections(spark, sf_dir):
    """The context document's section for each question."""
    t = Report(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("pick", "theme_id"))
    quotes = t.picked().withColumn("place", place).where("place <= 3")
    return sections.context_sections(sections.compact_tables(t.kept, t.themes), quotes, t.written())


@query(f"""#{TOTALS}, {LATEST},
m as (select count(*) filter (quality = 'good' and not excluded) as sources from files), n as (select cast(sum(total_mentions) as bigint) as mentions, count(*) as questions from totals),
k as (select string_agg(n || ' ' || source_type, ', ' order by n desc, source_type) as kinds from (select source_type, count(*) as n from files group by 1)),
p as (select count(*) filter (verdict = 'pass') as passed, count(*) as total from latest)
select concat_ws(chr(10), '# Evidence' || chr(10), '**Date:** {DAY}', '**Sources:** ' || sources || ' files (' || kinds || ')', '**Questions:** ' || questions, '**Mentions retained:** ' || mentions) as header,
  concat_ws(chr(10), '---', 'company: "A \\"B\\" C"', 'date: {DAY}', 'source_count: ' || sources, 'mention_count: ' || mentions, 'question_count: ' || questions, 'audit_pass_rate: ' || case when total > 0 then ({pct("passed", "total")})::varchar else 'null' end, '---') as front
from m, n, k, p""")
def report_heads(spark, sf_dir):
    """What stands above a report, and above a context document."""
    t = Report(spark, sf_dir)
    method, totals = counting.methodology(t.files), counting.header_totals(t.totals())
    front = sections.front_matter(method, totals, audit.pass_counts(t.verdicts), 'A "B" C', DAY)
    return sections.header(method, totals, counting.ranked_source_types(t.files), "Evidence", DAY).crossJoin(front)


@query("""#c as (select question_id, question_id || '_c' || (doc_id % 50) as claim_id, count(distinct file_id) as own from mentions group by all),
w as (select question_id, count(distinct file_id) as n from mentions group by 1)
select claim_id, 'Evidence for ' || claim_id || ': ' || own || ' of ' || n || ' ' || c.question_id || ' source files support this claim. It is slow. Scope: all' as note from c join w on c.question_id = w.question_id""")
def evidence_notes(spark, sf_dir):
    """Of each claim how many files of its question support it, in words."""
    t = Tables(spark, sf_dir)
    return sections.evidence_notes(_claims(t).withColumns({"claim_text": F.lit("It is slow."), "scope": F.lit("all")}), t.mentions)


@query("""
select doc_id, concat_ws(chr(10) || chr(10), 'headline ' || doc_id, case when doc_id % 2 = 0 then '## Context' || chr(10) || chr(10) || 'one' || chr(10) || chr(10) || 'two' end,
  '## Key Findings' || chr(10) || chr(10) || '- found' || case when doc_id % 3 = 0 then chr(10) || chr(10) || '  note ' || doc_id else '' end,
  case when doc_id % 5 > 0 then '## Notable Outcomes' || chr(10) || chr(10) || '- **won**' || chr(10) || '  > "ours"' || case when doc_id % 5 > 1 then chr(10) || '  > — Kim' else '' end end,
  case when doc_id % 7 = 0 then '## Open Questions' || chr(10) || chr(10) || '- why?' end) as executive from documents""", alone=True)
def executive_sections(spark, sf_dir):
    """Summaries with and without each of their parts."""
    i = F.col("doc_id")
    some = lambda on, x: F.when(on, F.array(x)).otherwise(F.slice(F.array(x), 1, 0))
    rows = Tables(spark, sf_dir).raw("documents").select(
        "doc_id",
        F.concat(F.lit("headline "), "doc_id").alias("headline"),
        F.when(i % 2 == 0, "one\n \ntwo").otherwise("").alias("body"),
        F.array(F.struct(F.lit("found").alias("text"), some(i % 3 == 0, F.concat(F.lit("note "), "doc_id")).alias("notes"))).alias("findings"),
        some(i % 5 > 0, F.struct(F.lit("won").alias("outcome"), F.lit("ours").alias("quote"), F.when(i % 5 > 1, "Kim").alias("attribution"))).alias("outcomes"),
        some(i % 7 == 0, F.lit("why?")).alias("open_questions"),
    )
    return sections.executive_section(rows, "doc_id")


@query(f"""#{FLAGGED},
o as (select 'o_' || m.mention_id as id, m.k % 4 as c, case when m.k % 4 = 2 then 'zz' else a.theme_id end as theme_id from assignments a join mentions m on a.mention_id = m.mention_id)
select id as entity_key, 'field' as check_name from o where c = 3 union all select id, 'evidence' from o where c = 1 union all select id, 'theme' from o where c = 2
union all select id, 'demoted' from o join flagged f on o.theme_id = f.theme_id where demoted union all select id, 'stale' from o where theme_id = 'Q1_T1'""")
def opportunity_issues(spark, sf_dir):
    """An opportunity for each assigned mention, three of four with a fault, against counts of which one is stale."""
    t = Report(spark, sf_dir)
    rows = t.assignments.select("mention_id", "theme_id").join(t.mentions.select("mention_id", "question_id", (F.col("k") % 4).alias("c")), "mention_id")
    rows = rows.withColumns({"opportunity_id": F.concat(F.lit("o_"), "mention_id"), "question_id": F.when(F.col("c") == 1, "Q9").otherwise(F.col("question_id")), "theme_id": F.when(F.col("c") == 2, "zz").otherwise(F.col("theme_id")), "text": F.when(F.col("c") == 3, " ").otherwise("Do it")})
    stored = t.kept.select("theme_id", (F.col("mention_count") + (F.col("theme_id") == "Q1_T1").cast("long")).alias("mention_count"))
    return reporting.opportunity_issues(rows, t.mentions, t.assignments, stored, t.kept).select("entity_key", "check_name")


@query("""
select 'c' || doc_id as entity_key, case doc_id % 6 when 4 then 'open_quotation' else 'inline_quote' end as check_name from documents where doc_id % 6 in (1, 3, 4)""", alone=True)
def inline_quote_issues(spark, sf_dir):
    """Claims that quote a checked quote, an unchecked one, a part of their source, a part of a word of it, or don't end."""
    i = F.col("doc_id")
    said = F.lit("they said “")
    kinds = [F.concat(said, F.lit("checked "), i, F.lit("”")), F.concat(said, F.lit("unchecked "), i, F.lit("”")), F.concat(said, F.lit("Slow on"), F.lit("”")), F.concat(said, F.lit("low on"), F.lit("”")), F.lit("they said “and"), F.lit("they said so")]
    text = F.element_at(F.array(*kinds), (i % 6 + 1).cast("int"))
    rows = Tables(spark, sf_dir).raw("documents").select(F.concat(F.lit("c"), i).alias("claim_id"), text.alias("text"), F.lit(None).cast("string").alias("scope"), F.when((i % 6).isin(2, 3), "It was slow on Monday").alias("source_quote"), F.concat(F.lit("Checked "), i).alias("quote"))
    return reporting.inline_quote_issues(rows.drop("quote"), rows.select("quote")).select("entity_key", "check_name")
