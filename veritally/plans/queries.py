"""Queries over the corpus tables: each applies operators to whole tables. SQL states the same result for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritally.functions import figures, prose
from veritally.functions import text as fx
from veritally.operators import audit, checks, counting, grounding, ledger, rendering, reporting, selection, semantic
from veritally.schemas import category_of
from veritally.semantics import n_words, normalized
from veritally.sources import adapters as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, alone: bool = False):
    """Register a query under its name, with its SQL; ``alone``: the SQL needs none of the evidence tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            head = "with " if alone else src.SQL + ","
            SQL[f.__name__] = (head if sql.lstrip().startswith("#") else ("" if alone else src.SQL)) + sql.lstrip().removeprefix("#")
        return f

    return add


class Tables:
    """The evidence tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return src.themes(self.spark) if name == "themes" else getattr(src, name)(self.spark, self.sf_dir)

    def raw(self, name: str) -> DataFrame:
        return src.table(self.spark, self.sf_dir, name)

    def counts(self) -> DataFrame:
        return counting.theme_counts(self.mentions, self.assignments, self.themes, self.files)

    def flagged(self) -> DataFrame:
        return counting.demoted(self.counts())

    def outliers(self) -> DataFrame:
        return counting.outliers(self.mentions, self.assignments, self.flagged())


def pct(a: str, b: str) -> str:
    return f"case when {b} = 0 then 0 else cast(round_even({a} / {b} * 100, 0) as bigint) end"


TOTALS = """totals as (select question_id, count(distinct mention_id) as total_mentions, count(distinct category) as total_source_types, count(distinct segment) as total_segments from placed group by 1)"""
COUNTS = f"""{TOTALS},
counts as (
  select t.question_id, t.theme_id, t.type, coalesce(a.mention_count, 0) as mention_count, coalesce(a.source_type_count, 0) as source_type_count,
    coalesce(a.segment_count, 0) as segment_count, total_mentions, total_source_types, total_segments
  from themes t left join (
    select a.theme_id, count(*) as mention_count, count(distinct category) as source_type_count, count(distinct segment) as segment_count
    from assignments a left join placed p on a.mention_id = p.mention_id group by 1) a on t.theme_id = a.theme_id
  join totals q on t.question_id = q.question_id)"""
FLAGGED = f"""{COUNTS},
floors as (select *, cast(greatest(2, ceil(total_mentions * 0.03::double)) as bigint) as floor from counts),
flagged as (
  select *, total_mentions >= 10 and sum((mention_count >= floor)::int) over (partition by question_id) >= 2 and mention_count < floor as demoted from floors)"""
OUTLIERS = f"""{FLAGGED},
outliers as (
  select * from placed m where not exists (
    select 1 from assignments a join flagged f on a.theme_id = f.theme_id where not f.demoted and a.mention_id = m.mention_id))"""


@query(f"""#{COUNTS}
select question_id, theme_id, type, mention_count, {pct("mention_count", "total_mentions")} as mention_pct, source_type_count,
  {pct("source_type_count", "total_source_types")} as source_type_pct, segment_count, {pct("segment_count", "total_segments")} as segment_pct from counts""")
def theme_counts(spark, sf_dir):
    return Tables(spark, sf_dir).counts().select("question_id", "theme_id", "type", "mention_count", "mention_pct", "source_type_count", "source_type_pct", "segment_count", "segment_pct")


@query(f"#{TOTALS} select *, total_mentions < 15 as sparse from totals")
def question_totals(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return counting.question_totals(t.mentions, t.assignments, t.files)


@query(f"#{FLAGGED} select question_id, theme_id, mention_count, floor, demoted from flagged")
def theme_demotion(spark, sf_dir):
    return Tables(spark, sf_dir).flagged().select("question_id", "theme_id", "mention_count", "floor", "demoted")


@query(f"#{OUTLIERS} select question_id, mention_id, mention, quote, file_id from outliers")
def outliers(spark, sf_dir):
    return Tables(spark, sf_dir).outliers().select("question_id", "mention_id", "mention", "quote", "file_id")


@query(f"#{OUTLIERS} select question_id, category, count(distinct file_id) as n_files from outliers group by all")
def outlier_breakdown(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return counting.breakdown(counting.placed(t.outliers(), t.files), ["question_id"], "category")


@query("""
select a.question_id, a.theme_id, category, count(distinct file_id) as n_files from assignments a join placed p on a.mention_id = p.mention_id group by all""")
def source_type_breakdown(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.assignments.join(counting.placed(t.mentions, t.files).drop("question_id"), "mention_id")
    return counting.breakdown(rows, ["question_id", "theme_id"], "category")


@query("""
select a.question_id, a.theme_id, segment, count(distinct file_id) as n_files from assignments a join placed p on a.mention_id = p.mention_id group by all""")
def segment_breakdown(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.assignments.join(counting.placed(t.mentions, t.files).drop("question_id"), "mention_id")
    return counting.breakdown(rows, ["question_id", "theme_id"], "segment")


@query(f"""#q as (select question_id, count(distinct mention_id) as m, count(distinct file_id) as s from mentions group by 1),
t as (select a.question_id, a.theme_id, count(distinct m.mention_id) as m, count(distinct m.file_id) as s from assignments a join mentions m on a.mention_id = m.mention_id group by all),
u as (select question_id, question_id as ref, m, s, m as am, s as "as" from q union all select t.question_id, theme_id, t.m, t.s, q.m, q.s from t join q on t.question_id = q.question_id)
select ref || ':mentions' as stat_ref, question_id as scope, 'mentions' as unit, m as numerator, am as denominator, {pct("m", "am")} as percentage from u
union all select ref || ':sources', question_id, 'source_files', s, "as", {pct("s", '"as"')} from u""")
def inventory_stats(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return counting.inventory_stats(t.mentions, t.assignments)


@query(f"""#cohort as (select count(distinct file_id) as cohort from files),
per as (select a.question_id, a.theme_id, count(distinct m.file_id) as sources from assignments a join mentions m on a.mention_id = m.mention_id group by all)
select question_id, theme_id, sources, cohort, {pct("sources", "cohort")} as share from per, cohort""")
def cohort_theme_share(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return counting.cohort_shares(t.mentions, t.assignments, t.files).select("question_id", "theme_id", "sources", "cohort", "share")


@query("""
select count(*) filter (quality = 'good' and not excluded) as source_count, count(*) filter (excluded) as excluded_count,
  cast(coalesce(sum(interaction_count) filter (quality = 'good' and not excluded), 0) as bigint) as total_interactions from files""")
def methodology(spark, sf_dir):
    return counting.methodology(Tables(spark, sf_dir).files)


@query(f"""
select {src._category} as category, count(*) as n from files where quality = 'good' and not excluded group by 1""")
def sources_by_category(spark, sf_dir):
    return counting.sources_by_category(Tables(spark, sf_dir).files)


@query("""#r as (select case when excluded then 'excluded' when quality = 'bad' then 'bad quality' end as reason, count(*) as n from files group by 1)
select string_agg(reason || ': ' || n, '; ' order by reason) as notes from r where reason is not null""")
def quality_notes(spark, sf_dir):
    return counting.quality_notes(Tables(spark, sf_dir).files)


@query("""
select mention_id as entity_key, 'missing' as check_name, 'error' as severity, 'expected, not returned' as message from mentions where mention_id not in (select mention_id from assignments)""")
def assignment_integrity(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return checks.assignments(t.mentions, t.assignments, t.themes)


@query("""#u as (select distinct m.file_id, t.theme_id, t.type from assignments a join mentions m on a.mention_id = m.mention_id join themes t on a.theme_id = t.theme_id),
t as (select file_id, count(*) as nt, count(*) filter (type = 'other') as no from u group by 1), m as (select file_id, count(*) as nm from mentions group by 1)
select file_id as entity_key, 'theme_budget' as check_name, 'warning' as severity, 'too many themes' as message from t left join m using (file_id) where nt * 4 > coalesce(nm, 0)
union all select file_id, 'other', 'warning', 'more than one other' from t where no > 1""")
def theme_budget(spark, sf_dir):
    """The budget of themes against mentions, of each file by itself."""
    t = Tables(spark, sf_dir)
    of = t.mentions.select("mention_id", "file_id")
    used = t.assignments.join(of, "mention_id").join(t.themes.select("theme_id", "type"), "theme_id").select(F.col("file_id").alias("question_id"), "theme_id", "type").distinct()
    return checks.theme_budget(used, of.select(F.col("file_id").alias("question_id"), "mention_id"))


@query(f"""#n as (select m.file_id, question_id, count(*) as n, any_value(case when interaction_count > 1 then 25 else 6 end) as w, any_value(case when interaction_count > 1 then 35 else 12 end) as e from mentions m join files f on m.file_id = f.file_id group by all)
select file_id || '|' || question_id as entity_key, 'mention_cap' as check_name, case when n > e then 'error' else 'warning' end as severity, case when n > e then 'far too many mentions' else 'many mentions' end as message from n where n > w""")
def mention_caps(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return checks.mention_caps(t.mentions, t.files)


def squeeze(x: str) -> str:
    return f"lower(trim(regexp_replace({x}, '[\\s\\p{{Z}}]+', ' ', 'g')))"


STRAIGHT = "'\'\'\'\'\"\"--'"  #: in SQL: two apostrophes, two quotation marks, two hyphens


def norm(x: str) -> str:
    plain = rf"regexp_replace({x}, '\\([^\\])', '\1', 'g')"
    return squeeze(f"replace(translate({plain}, '‘’“”–—', {STRAIGHT}), '…', '...')")


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^\\s\\p{{Z}}]+'))"


@query(f"""#n as (select mention_id, row_number() over (partition by file_id, {squeeze("quote")} order by mention_id) as n from mentions where quote <> '')
select mention_id as entity_key, 'quote_reuse' as check_name, 'warning' as severity, 'quote used too often' as message from n where n > 5""")
def quote_reuse(spark, sf_dir):
    return checks.quote_reuse(Tables(spark, sf_dir).mentions)


@query(f"""#n as (select mention_id, {squeeze("quote")} as m, min(mention_id) over (partition by file_id, {squeeze("quote")}) as first from mentions)
select mention_id, first from n where mention_id <> first and m <> ''""")
def duplicate_mentions(spark, sf_dir):
    from veritally.semantics import squeezed

    rows = Tables(spark, sf_dir).mentions.withColumn("m", squeezed(F.col("quote"))).where("m <> ''")
    first = rows.groupBy("file_id", "m").agg(F.min("mention_id").alias("first"))
    return rows.join(first, ["file_id", "m"]).where("mention_id <> first").select("mention_id", "first")


@query()
def mention_issues(spark, sf_dir):
    """How often each check of mentions fires."""
    t = Tables(spark, sf_dir)
    questions = spark.createDataFrame([(f"Q{k}",) for k in range(1, 6)], "question_id string")
    return checks.mentions(t.mentions, questions, t.files).groupBy("check_name", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("""
select 'segment' as check_name, 'error' as severity, count(*) as n from files where segment not in ('unknown', 'seg1', 'seg2', 'seg3') having count(*) > 0
union all select 'exclusion_reason', 'error', count(*) from files where excluded having count(*) > 0""")
def plan_issues(spark, sf_dir):
    t = Tables(spark, sf_dir)
    segments = spark.createDataFrame([(f"seg{k}", "", "") for k in range(1, 4)], "id string, label string, description string")
    questions = spark.createDataFrame([(f"Q{k}", "") for k in range(1, 6)], "question_id string, text string")
    found = checks.plan(t.files.withColumn("exclusion_reason", F.lit(None).cast("string")), questions, segments)
    return found.groupBy("check_name", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("""
select entity_key, check_name from (
  select 'doc_' || doc_id as entity_key, 'missing' as check_name from documents where doc_id % 7 = 3 and doc_id % 11 <> 5
  union all select 'new_' || doc_id, 'invented' from documents where doc_id % 11 = 5
  union all select 'doc_' || doc_id, 'missing' from documents where doc_id % 7 = 3 and doc_id % 11 = 5
  union all select 'doc_' || doc_id, 'duplicate' from documents where doc_id % 7 <> 3 and doc_id % 13 = 0)""", alone=True)
def returned_ids(spark, sf_dir):
    """Missing, invented and repeated ids among those that a step gave back."""
    ids = Tables(spark, sf_dir).raw("documents").select("doc_id")
    name = lambda kind: F.concat(F.lit(kind), "doc_id").alias("file_id")
    back = ids.where("doc_id % 7 <> 3")
    got = back.select(name("doc_")).unionByName(back.where("doc_id % 13 = 0").select(name("doc_"))).unionByName(ids.where("doc_id % 11 = 5").select(name("new_")))
    return checks.exact_cover(ids.select(name("doc_")), got, "file_id").select("entity_key", "check_name")


@query(f"""#b as (select item_id, {squeeze("text")} as q from benchmark), d as (select doc_id, {squeeze("text")} as s from documents)
select item_id as quote_id, doc_id as source_id from b join d on contains(s, q) where q <> ''""", alone=True)
def quote_grounding(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return grounding.find_quotes(t.raw("benchmark").select(F.col("item_id").alias("quote_id"), "text"), t.raw("documents").select(F.col("doc_id").alias("source_id"), "text"))




@query(f"""
select mention_id, coalesce(contains({norm("d.text")}, {norm("m.quote")}), false) as grounded from mentions m left join documents d on m.doc_id = d.doc_id""")
def mention_grounding(spark, sf_dir):
    t = Tables(spark, sf_dir)
    sources = t.raw("documents").select(F.concat(F.lit("doc_"), "doc_id").alias("file_id"), "text")
    return grounding.grounded(t.mentions.select("mention_id", "file_id", "quote"), sources).select("mention_id", "grounded")




@query(f"""#f as (select mention_id, quote, {words("quote")} as n, [regexp_replace(x, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') for x in string_split(quote, ',')] as fields from mentions)
select mention_id, n as n_words, n > 150 or n < 5 or regexp_matches(quote, '\\d{{2}}:\\d{{2}}:\\d{{2}}') as disqualified, not n between 15 and 80 as off_length,
  regexp_matches(quote, '^[A-Z]{{2,}}-\\d+,') or (len(fields) >= 4 and len([x for x in fields if regexp_matches(x, '^(\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d+(\\.\\d+)?)$')]) > 0) as csv_row,
  regexp_matches(quote, '\\*\\*[^*]+\\*\\*|__[^_]+__') as markdown,
  regexp_matches(quote, '\\d{{2,}}|\\$\\d') or regexp_matches(quote, '(?i)\\b(?:{fx.STEMS})[\\p{{L}}\\p{{N}}_]*') or regexp_matches(quote, '(?i){fx.CLAIM}') as signal from f""")
def quote_flags(spark, sf_dir):
    q = F.col("quote")
    return Tables(spark, sf_dir).mentions.select("mention_id", n_words(q).alias("n_words"), fx.is_disqualified(q).alias("disqualified"), fx.off_length(q).alias("off_length"), fx.is_csv_row(q).alias("csv_row"), fx.has_markdown(q).alias("markdown"), fx.has_signal(q).alias("signal"))


@query()
def low_signal_quotes(spark, sf_dir):
    c = Tables(spark, sf_dir).raw("conversations")
    return c.select("conv_id", "turn", fx.is_low_signal(F.col("text")).alias("low_signal"))


LAYERS = """layers as (select *, row_number() over (partition by {0}, file_id order by not notable_quote, sha256(mention_id), mention_id) as layer from {1})"""


@query(f"""#{LAYERS.format("question_id", "mentions")},
p as (select *, row_number() over (partition by question_id order by layer, not notable_quote, sha256(mention_id), mention_id) as place from layers)
select question_id, mention_id, layer, place from p where place <= 40""")
def spread_sample(spark, sf_dir):
    return selection.spread_sample(Tables(spark, sf_dir).mentions, ["question_id"], 40).select("question_id", "mention_id", "layer", "place")


THEMED = "themed as (select a.theme_id, m.* from assignments a join mentions m on a.mention_id = m.mention_id)"


@query(f"""#{THEMED}, {LAYERS.format("theme_id", "themed")},
p as (select *, row_number() over (partition by theme_id order by not notable_quote, sha256(mention_id), mention_id) as place from layers where layer = 1)
select theme_id, mention_id, place from p where place <= 6""")
def executive_observations(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return selection.executive_observations(t.mentions, t.assignments).select("theme_id", "mention_id", "place")


@query("""
select question_id, mention_id, (row_number() over (partition by question_id order by mention_id) - 1) // 300 as chunk from mentions""")
def assignment_chunks(spark, sf_dir):
    rows = Tables(spark, sf_dir).mentions.select("question_id", "mention_id")
    return selection.chunks(rows, "question_id", "mention_id").select("question_id", "mention_id", "chunk")


@query(f"""#{THEMED}, {LAYERS.format("theme_id", "themed")},
p as (select theme_id, mention_id, length(quote) + length(mention) + 60 as size, row_number() over (partition by theme_id order by layer, not notable_quote, sha256(mention_id), mention_id) as place from layers),
s as (select *, cast(sum(size) over (partition by theme_id order by place) as bigint) as total from p)
select theme_id, mention_id, size, total from s where total <= 240000""")
def theme_sample_budget(spark, sf_dir):
    t = Tables(spark, sf_dir)
    size = F.char_length("quote") + F.char_length("mention") + 60
    return selection.theme_sample(t.mentions, t.assignments, size, cap=240_000, least=60).select("theme_id", "mention_id", "size", "total")


@query(f"""#{THEMED}, {LAYERS.format("question_id, theme_id", "themed")},
p as (select question_id, length(quote) as size, row_number() over (partition by question_id, theme_id order by layer, not notable_quote, sha256(mention_id), mention_id) as place from layers),
n as (select question_id, k, sum(size) as total from p, (values (40), (30), (20), (15), (10), (8), (6), (4), (3), (2), (1)) v(k) where place <= k group by all)
select question_id, cast(max(k) as bigint) as per_theme, cast(arg_max(total, k) as bigint) as total from n where total <= 240000 group by 1""")
def bounded_view(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return selection.bounded_view(t.mentions, t.assignments, F.char_length("quote"), 240_000)


@query()
def select_quotes(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return selection.select_quotes(t.mentions, t.assignments, t.themes).select("question_id", "theme_id", "pick", "mention_id", "file_id", "quote", "notable_quote")


@query()
def quote_candidates(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return selection.quote_candidates(t.mentions, t.assignments).select("question_id", "theme_id", "pick", "mention_id", "file_id", "quote")


LATEST = "latest as (select mention_id, round, line, verdict from (select *, row_number() over (partition by mention_id order by round desc, line desc) as rn from verdicts) where rn = 1)"


@query(f"#{LATEST} select * from latest")
def audit_latest(spark, sf_dir):
    return audit.latest(Tables(spark, sf_dir).verdicts)


@query(f"""#{LATEST}
select (select count(*) from verdicts where round = 1) as raw_total, (select count(*) from verdicts where round = 1 and verdict = 'pass') as raw_passed, count(*) as total, count(*) filter (verdict = 'pass') as passed from latest""")
def audit_pass_counts(spark, sf_dir):
    return audit.pass_counts(Tables(spark, sf_dir).verdicts)


@query(f"""#{LATEST},
s as (select count(*) as audited, count(*) filter (verdict = 'pass') as passed, count(*) filter (verdict = 'fail') as failed, count(*) filter (verdict = 'uncertain') as uncertain from latest)
select *, audited > 0 and passed * 100 >= audited * 90 as ready from s""")
def audit_summary(spark, sf_dir):
    return audit.summary(Tables(spark, sf_dir).verdicts)


@query("""#s as (select round, count(*) as checked, count(*) filter (verdict <> 'pass') as failures from verdicts group by 1)
select *, failures > 0 as escalate, case when failures * 100 <= checked * 5 then 'auto_fix' when failures * 100 <= checked * 20 then 'escalate' else 'flag_orchestrator' end as severity from s""")
def audit_severity(spark, sf_dir):
    return audit.severity(Tables(spark, sf_dir).verdicts)


@query("""#p as (select m.question_id, coalesce(m.source_type, 'other') as source_type, m.mention_id in (select mention_id from verdicts) as hit from placed m)
select question_id, source_type, count(*) as mentions, bool_or(hit) as covered from p group by all""")
def audit_cells(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = counting.placed(t.mentions, t.files).withColumn("source_type", F.coalesce("source_type", F.lit("other")))
    return audit.cells(rows, t.verdicts)


@query(f"#{LATEST} select question_id, count(*) as n from mentions where mention_id not in (select mention_id from latest where verdict <> 'pass') group by 1")
def audit_survivors(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return audit.surviving(t.mentions, t.verdicts).groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))


@query()
def fixed_audit_sample(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = counting.placed(t.mentions, t.files).withColumn("source_type", F.coalesce("source_type", F.lit("other")))
    return selection.fixed_audit_sample(rows)


@query()
def stratified_quotas(spark, sf_dir):
    return selection.strata_quotas(Tables(spark, sf_dir).files, "source_type", 0.25)


@query()
def stratified_sample(spark, sf_dir):
    return selection.stratified_sample(Tables(spark, sf_dir).files.select("file_id", "source_type"), "source_type", "file_id", 0.25)


@query(f"""#{FLAGGED}
select question_id, theme_id, mention_count, row_number() over (partition by question_id order by mention_count desc, theme_id) as rank,
  count(*) over (partition by question_id, mention_count) = 1 as strict from flagged where not demoted and type <> 'other'""")
def rank_claims(spark, sf_dir):
    return counting.rank_claims(Tables(spark, sf_dir).flagged())


@query(f"""#{FLAGGED}, top as (select question_id, max({pct("mention_count", "total_mentions")}) as t from flagged where not demoted group by 1)
select f.question_id, theme_id, type, mention_count, {pct("mention_count", "total_mentions")} as mention_pct,
  {pct(pct("mention_count", "total_mentions"), "t")} as bar, type = 'other' as is_other from flagged f join top on f.question_id = top.question_id where not demoted""")
def theme_table(spark, sf_dir):
    return rendering.theme_table(Tables(spark, sf_dir).flagged())


@query(f"""#{LATEST}, m as (select count(*) filter (quality = 'good' and not excluded) as a, count(*) filter (excluded) as b from files), p as (select count(*) filter (verdict = 'pass') as p, count(*) as n from latest)
select a || ' sources were analysed and ' || b || ' excluded.' as sources, case when n = 0 then 'No mentions were audited.' else p || ' of ' || n || ' audited mentions passed (' || {pct("p", "n")} || '%).' end as audit from m, p""")
def report_lines(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rendering.methodology_lines(counting.methodology(t.files), audit.pass_counts(t.verdicts))


TURNS = """turns as (
  select conv_id, turn, lpad((turn // 60)::varchar, 2, '0') || ':' || lpad((turn % 60)::varchar, 2, '0') || ' - ' || upper(role[1]) || lower(role[2:]) as header, text from conversations)"""


@query(f"""{TURNS}, n as (select *, length(header) + length(text) + 2 as n from turns)
select conv_id, turn, header, cast(sum(n) over w - n as bigint) as start, cast(sum(n) over w as bigint) as "end" from n window w as (partition by conv_id order by turn)""".replace("turns as", "#turns as", 1), alone=True)
def speaker_turns(spark, sf_dir):
    """Where each turn starts and ends in the transcript of its conversation."""
    rows = src.turns(spark, sf_dir).withColumn("n", F.char_length("header") + F.char_length("text") + 2)
    w = Window.partitionBy("conv_id").orderBy("turn")
    end = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    return rows.select("conv_id", "turn", "header", (end - F.col("n")).alias("start"), end.alias("end"))


@query()
def speaker_spans(spark, sf_dir):
    """Spans of up to 32 words of each turn."""
    rows = src.turns(spark, sf_dir).select("conv_id", "turn", F.concat("header", F.lit("\n"), "text").alias("text"))
    return rows.select("conv_id", F.col("turn").alias("at"), F.explode(prose.column("spans")("text")).alias("s")).select("conv_id", "at", "s.*")


@query("""#e as (select key, event, row_number() over (partition by key order by ts, event_id) as nth from ledger where event in ('claim', 'finish', 'fail')),
r as (
  with recursive x(key, nth, attempts, status) as (
    select distinct key, cast(0 as bigint), 0, 'new' from e
    union all
    select x.key, e.nth, case when e.event = 'claim' and x.status not in ('running', 'complete') and x.attempts < 2 then x.attempts + 1 else x.attempts end,
      case when e.event = 'claim' and x.status not in ('running', 'complete') and x.attempts < 2 then 'running'
        when e.event = 'finish' and x.status = 'running' then 'complete' when e.event = 'fail' and x.status = 'running' then 'failed' else x.status end
    from x join e on x.key = e.key and e.nth = x.nth + 1)
  select key, arg_max(attempts, nth) as attempts, arg_max(status, nth) as status from x group by 1),
c as (select key, count(*) filter (event = 'claim') as claims from e group by 1)
select r.key, cast(attempts as bigint) as attempts, status, claims, claims - attempts as refused from r join c on r.key = c.key""")
def ledger_replay(spark, sf_dir):
    return ledger.replay(Tables(spark, sf_dir).ledger)


@query("""#c as (select key, count(*) as n, count(value) as m from ledger where event = 'claim' group by 1)
select count(*) as keys, cast(sum(n) as bigint) as attempts, cast(sum(n - 1) as bigint) as retries, sum(m) = sum(n) as measured from c""")
def ledger_metrics(spark, sf_dir):
    m = ledger.metrics(Tables(spark, sf_dir).ledger)
    return m.select("keys", "attempts", "retries", F.col("tokens").isNotNull().alias("measured"))


@query("""#e as (select key, event, epoch_us(lead(ts) over (partition by key order by ts, event_id)) - epoch_us(ts) as span from ledger)
select key, cast(coalesce(sum(span) filter (event <> 'pause'), 0) as bigint) as active_micros, cast(coalesce(sum(span), 0) as bigint) as elapsed_micros from e group by 1""")
def ledger_active(spark, sf_dir):
    return ledger.active_seconds(Tables(spark, sf_dir).ledger)


@query("""
select *, running < 4 as open from (
  select key, event, event_id, cast(sum(case event when 'claim' then 1 else -1 end) over (order by ts, event_id rows unbounded preceding) as bigint) as running from ledger where event in ('claim', 'finish', 'fail'))""")
def ledger_in_flight(spark, sf_dir):
    return ledger.in_flight(Tables(spark, sf_dir).ledger).select("key", "event", "event_id", "running", "open")


@query("""#of_day as (select cast(ts as date)::varchar as run_id, key, event, event_id, row_number() over (partition by cast(ts as date) order by ts, event_id) as n from ledger),
walk as (
  select run_id, 0::bigint as n, []::varchar[] as running, []::varchar[] as complete, []::varchar[] as tries, false as paused, null::bigint as event_id, null::varchar as key, null::varchar as action from (select distinct run_id from of_day)
  union all
  select run_id, n, case when action = 'run' and not list_contains(running, key) then list_append(running, key) when event in ('finish', 'fail') then list_filter(running, lambda x: x <> key) else running end,
    case when event = 'finish' and list_contains(running, key) then list_append(complete, key) else complete end, case when action = 'run' then list_append(tries, key) else tries end,
    case event when 'pause' then true when 'resume' then false else paused end, event_id, key, action
  from (select d.*, w.running, w.complete, w.tries, w.paused,
      case when d.event <> 'claim' then null when w.paused then 'paused' when list_contains(w.complete, d.key) then 'reuse' when not list_contains(w.tries, d.key) and len(w.running) >= 4 then 'full'
        when len(list_filter(w.tries, lambda x: x = d.key)) >= 2 then 'spent' else 'run' end as action
    from walk w join of_day d on d.run_id = w.run_id and d.n = w.n + 1))
select run_id, event_id, key, action from walk where action is not null""")
def claims_enforced(spark, sf_dir):
    """What becomes of each claim where every day is a run: four keys at a time, two attempts each, none while it is paused."""
    events = Tables(spark, sf_dir).ledger
    return ledger.enforced(events.withColumn("run_id", F.to_date("ts").cast("string")))


def _html(check: str, severity: str, message: str, when: str) -> str:
    return f"select cast(page_id as varchar) as entity_key, '{check}' as check_name, '{severity}' as severity, {message} as message from h where {when}"


_lost = "list_distinct([x for x in regexp_extract_all(t, 'href=\"#([^\"]+)\"', 1) if not list_contains(regexp_extract_all(t, '\\bid=[\"'']([^\"'']+)[\"'']', 1), x)])"
_q = "regexp_matches(t, 'id=\"Q\\d+\"')"


@query(
    "#h as (select page_id, coalesce(html, '') as t from pages) "
    + " union all ".join(
        [
            _html("section_summary", "error", "'no summary'", "not contains(t, 'id=\"executive-summary\"')"),
            _html("section_methodology", "error", "'no methodology'", "not contains(t, 'id=\"methodology\"')"),
            _html("section_questions", "warning", "'no questions'", f"not {_q}"),
            _html("charts", "warning", "'no charts'", f"{_q} and not contains(t, 'chart-container')"),
            _html("nav_links", "error", f"'links to nothing: ' || len({_lost})", f"len({_lost}) > 0"),
            _html("skip_link", "error", "'no skip link'", "not contains(t, 'skip-link')"),
            _html("aria_label", "warning", "'no labels'", "not contains(t, 'aria-label=')"),
            _html("focus", "warning", "'no focus outline'", "not contains(t, 'outline:') or not contains(t, ':focus')"),
            _html("markdown", "error", "'markup left over'", "regexp_matches(t, '(?m)^### |^---\\s*$|\\[\\[|\\*\\*[^*]+\\*\\*')"),
            _html("closes", "error", "'doesn''t end'", "not ends_with(regexp_replace(t, '\\s+$', ''), '</html>')"),
            _html("style", "warning", "'shadows or gradients'", "contains(t, 'box-shadow') or contains(t, 'linear-gradient') or contains(t, 'radial-gradient')"),
            _html("colors", "warning", "'no primary color'", "not contains(t, '--primary')"),
        ]
    ),
    alone=True,
)
def html_checks(spark, sf_dir):
    return checks.html(Tables(spark, sf_dir).raw("pages"))


def numbers_sql(source: str, key: str, text: str) -> str:
    """CTEs up to ``numbers`` (key, value, type, start): all tokens of the text with their places, then the rules."""
    quoted = "“[^”]{0,299}”|‘[^’]{0,299}’|\"[^\"]{0,299}\""
    units = ",".join(f"'{w}'" for w in sorted(prose.MEASURES))
    return rf"""cut as (select {key}, {text} as body, regexp_extract_all({text}, '(?s){quoted}|[0-9]+(?:\.[0-9]+)?\s*%|[0-9]+\s*(?:of|/)\s*[0-9]+|[\p{{L}}\p{{M}}\p{{Nl}}\p{{No}}_]+|[0-9]+|.') as parts from {source} where regexp_matches({text}, '[0-9]')),
tokens as (select {key}, body, unnest(parts) as said, generate_subscripts(parts, 1) as i from cut),
placed_tokens as (select *, coalesce(sum(length(said)) over (partition by {key} order by i rows between unbounded preceding and 1 preceding), 0)::int as start,
  lag(said) over (partition by {key} order by i) as prior, lead(said) over (partition by {key} order by i) as next from tokens),
seen as (select *, substring(body, greatest(start - 5, 1), least(start, 6)) as before, substring(body, start + length(said) + 1, 20) as after from placed_tokens where regexp_matches(said, '^[0-9]')),
numbers as (
  select {key}, case when contains(said, '.') then cast(round_even(cast(regexp_extract(said, '^[0-9.]+') as double), 0) as bigint)::varchar else regexp_extract(said, '^[0-9]+') end as value, 'percentage' as type, start from seen where said like '%\%' escape '\'
  union all select {key}, regexp_extract(said, '^[0-9]+'), 'fraction_numerator', start from seen where regexp_matches(said, 'of|/')
  union all select {key}, regexp_extract(said, '[0-9]+$'), 'fraction_denominator', (start + length(said) - length(regexp_extract(said, '[0-9]+$')))::int from seen where regexp_matches(said, 'of|/')
  union all select {key}, said, 'count', start from seen where regexp_matches(said, '^[0-9]{{2,}}$') and not regexp_matches(coalesce(prior, ''), '[\p{{L}}\p{{M}}\p{{N}}_]$') and not regexp_matches(coalesce(next, ''), '^[\p{{L}}\p{{M}}\p{{N}}_]')
    and not regexp_matches(before, '\$\s{{0,2}}$') and not regexp_matches(before, '[~≈]\s?$') and not regexp_matches(before || said || left(after, 6), '[0-9]\s*[-–—]\s*[0-9]')
    and regexp_replace(lower(regexp_extract(after, '^\s*(\S+)', 1)), '[.,;:!?]+$', '') not in ({units}) and not regexp_matches(said, '^(19|20)[0-9]{{2}}$'))"""


@query(f"#{numbers_sql('mentions', 'mention_id', 'quote')} select * from numbers")
def number_extract(spark, sf_dir):
    return figures.numbers(Tables(spark, sf_dir).mentions, ["mention_id"], "quote")


@query(f"""#spoken as (select file_id, quote, unnest(string_split(text, '. ')) as sentence, generate_subscripts(string_split(text, '. '), 1) as i from (select 'doc_' || doc_id as file_id, text, '' as quote from documents where text is not null)),
spots as (select *, coalesce(sum(length(sentence) + 2) over (partition by file_id order by i rows between unbounded preceding and 1 preceding), 0) as a from spoken),
owners as (select quote as sentence, min(file_id) as x, max(file_id) as y from mentions group by 1),
copied as (select s.file_id, a, a + length(s.sentence) as b from spots s join owners o on s.sentence = o.sentence where x <> s.file_id or y <> s.file_id),
bodies as (select 'doc_' || doc_id as file_id, text from documents), {numbers_sql('bodies', 'file_id', 'text')}
select * from numbers n where not exists (select 1 from copied c where c.file_id = n.file_id and n.start >= c.a and n.start < c.b)""")
def number_view(spark, sf_dir):
    """Numbers that whole documents state outside sentences that another document has too."""
    t = Tables(spark, sf_dir)
    docs = t.raw("documents").where("text is not null").select(F.concat(F.lit("doc_"), "doc_id").alias("file_id"), "text")
    said = docs.select("file_id", F.posexplode(F.split("text", "\\. ", -1)).alias("place", "text"))
    order = Window.partitionBy("file_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    spots = said.withColumn("to", F.sum(F.char_length("text") + 2).over(order) - 2).withColumn("from", F.col("to") - F.char_length("text"))
    return reporting.number_view(figures.numbers(docs, ["file_id"], "text"), spots, t.mentions.select("file_id", F.col("quote").alias("text")))


@query()
def quantity_extract(spark, sf_dir):
    rows = Tables(spark, sf_dir).mentions.select("mention_id", F.explode(prose.column("quantities")("quote")).alias("n"))
    return rows.select("mention_id", "n.*")


@query()
def quotation_spans(spark, sf_dir):
    rows = Tables(spark, sf_dir).raw("documents").select("doc_id", F.explode(prose.column("quotations")("text")).alias("q"))
    return rows.select("doc_id", "q.start", "q.end", F.char_length("q.quote").alias("n_chars"))


@query()
def source_contexts(spark, sf_dir):
    """Where the first candidate of each theme stands in its source."""
    t = Tables(spark, sf_dir)
    first = selection.quote_candidates(t.mentions, t.assignments).where("pick = 1")
    texts = t.raw("documents").select(F.concat(F.lit("doc_"), "doc_id").alias("file_id"), "text")
    return first.join(texts, "file_id").select("theme_id", "mention_id", prose.context_column()("text", "quote").alias("c")).select("theme_id", "mention_id", "c.literal_verified", "c.start", "c.end")


@query("""#c as (select question_id, 'c' || (doc_id % 50) as claim_id, mention_id, file_id from mentions)
select question_id, count(distinct mention_id) as mentions, count(distinct file_id) as source_files, count(distinct question_id || claim_id) as claims from c group by 1""")
def claim_union_stats(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return counting.union_stats(_claims(t), t.mentions)


def _claims(t: Tables) -> DataFrame:
    """Fifty claims a question, each supported by a share of its mentions."""
    rows = t.mentions.select("question_id", F.concat("question_id", F.lit("_c"), F.col("doc_id") % 50).alias("claim_id"), "mention_id")
    return rows.groupBy("question_id", "claim_id").agg(F.collect_set("mention_id").alias("support_mention_ids"))


@query("""#c as (select question_id || '_c' || (doc_id % 50) as claim_id, mention_id, file_id from mentions)
select claim_id, count(distinct mention_id) as mentions, count(distinct file_id) as source_files, array_to_string(list_sort(list(distinct mention_id))[1:2], ',') as shown from c group by 1""")
def claim_annotations(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return counting.claim_annotations(_claims(t), t.mentions).select("claim_id", "mentions", "source_files", F.array_join("shown_ids", ",").alias("shown"))


@query("""#c as (select question_id || '_c' || (doc_id % 50) as claim_id, mention_id, file_id from mentions)
select claim_id, array_to_string(list_sort(list(distinct file_id)), ',') as files from c group by 1""")
def claim_sources(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return reporting.claim_sources(_claims(t), t.mentions).select("claim_id", F.array_join("source_file_ids", ",").alias("files"))


@query("""
select mention_id, question_id || '_c' || (doc_id % 50) as claim_id from mentions where notable_quote""")
def claim_bindings(spark, sf_dir):
    """Displayed quotes and the claims that cite them."""
    t = Tables(spark, sf_dir)
    return reporting.bindings(t.mentions.where("notable_quote"), _claims(t))


@query(f"""#{TOTALS}, c as (select question_id, question_id || '_c' || (doc_id % 50) as claim_id, mention_id, file_id from mentions),
s as (select claim_id, question_id, count(distinct mention_id) as mentions, count(distinct file_id) as source_files from c group by all)
select claim_id, s.question_id, mentions, source_files, total_mentions, {pct("mentions", "total_mentions")} as percentage from s join totals t on s.question_id = t.question_id""")
def claim_statistics(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return reporting.claim_statistics(_claims(t), t.mentions, counting.question_totals(t.mentions, t.assignments, t.files)).drop("stat_ref")


@query(f"""#{COUNTS}, q as (select question_id, count(distinct mention_id) as m, count(distinct file_id) as s from mentions group by 1),
t as (select a.question_id, a.theme_id, count(distinct m.mention_id) as m, count(distinct m.file_id) as s from assignments a join mentions m on a.mention_id = m.mention_id group by all),
u as (select question_id, m, s, m as am, s as "as" from q union all select t.question_id, t.m, t.s, q.m, q.s from t join q on t.question_id = q.question_id),
own as (select question_id as scope, unnest([mention_count, {pct("mention_count", "total_mentions")}, source_type_count, {pct("source_type_count", "total_source_types")}, segment_count, {pct("segment_count", "total_segments")}, total_mentions, total_source_types, total_segments])::bigint::varchar as value from counts
  union all select question_id, unnest([m, am, {pct("m", "am")}, s, "as", {pct("s", '"as"')}])::bigint::varchar from u
  union all select question_id, unnest(regexp_extract_all(quote, '[0-9]{{2,}}')) from mentions where not notable_quote),
everywhere as (select value from own union all select unnest([count(*) filter (quality = 'good' and not excluded), count(*) filter (excluded), coalesce(sum(interaction_count) filter (quality = 'good' and not excluded), 0)])::bigint::varchar from files),
notable as (select mention_id, question_id as scope, quote from mentions where notable_quote), {numbers_sql('notable', 'mention_id', 'quote')}
select mention_id as path, scope, value, type from numbers n join notable using (mention_id) where value not in (select value from everywhere)""")
def unverified_numbers(spark, sf_dir):
    """Numbers that notable quotes state, and neither a statistic of their question nor another quote of it has."""
    t = Tables(spark, sf_dir)
    method = counting.methodology(t.files)
    known = reporting.number_registry(t.counts(), counting.inventory_stats(t.mentions, t.assignments), t.mentions.where("not notable_quote"), method)
    fields = t.mentions.where("notable_quote").select(F.col("mention_id").alias("path"), F.col("quote").alias("text"), "question_id")
    return grounding.unverified_numbers(reporting.stated_numbers(fields), known)


@query("""
select mention_id, sha256('["' || file_id || '","' || mention_id || '","' || mention || '","' || replace(replace(quote, '\\', '\\\\'), '"', '\\"') || '"]') as fingerprint from mentions""")
def mention_fingerprints(spark, sf_dir):
    return audit.fingerprints(Tables(spark, sf_dir).mentions)


@query()
def extracted_mentions(spark, sf_dir):
    """Mentions that users' turns hold, by the plain stand-in for extraction."""
    return semantic.extract_mentions(Tables(spark, sf_dir).raw("conversations"))


@query(f"""#k as (select m.question_id, m.mention_id, t.theme_id, t.type, contains(lower(m.quote), t.keyword)::int + contains(lower(m.quote), t.keyword || 's')::int as hits from mentions m join themes t on m.question_id = t.question_id),
b as (select *, row_number() over (partition by mention_id order by hits desc, theme_id) as rn from k)
select question_id, mention_id, case when hits > 0 then theme_id else question_id || '_T8' end as theme_id from b where rn = 1""")
def keyword_assignments(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return semantic.assign_mentions(t.mentions, t.themes)


@query("""
select doc_id, case when length(text) <= 150 then text else case when regexp_matches(left(text, 147), '(?s) ') then regexp_extract(left(text, 147), '(?s)^(.*) ', 1) else left(text, 147) end || '...' end as summary from documents""", alone=True)
def source_summaries(spark, sf_dir):
    return Tables(spark, sf_dir).raw("documents").select("doc_id", fx.truncated(F.col("text"), 150).alias("summary"))


@query(f"select doc_id, sha256({norm('text')}) as digest from documents", alone=True)
def normalized_digests(spark, sf_dir):
    return Tables(spark, sf_dir).raw("documents").select("doc_id", F.sha2(normalized(F.col("text")), 256).alias("digest"))


@query(f"""#f as (select *, {src._category} as category from files)
select category, lifecycle, count(*) as n, count(*) filter (quality = 'bad') as bad from f group by all""")
def source_profile(spark, sf_dir):
    rows = Tables(spark, sf_dir).files.withColumn("category", category_of(F.col("source_type")))
    return rows.groupBy("category", "lifecycle").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("quality") == "bad").cast("long")).alias("bad"))


KEYED = """k as (select m.question_id, m.mention_id, t.theme_id, t.type, contains(lower(m.quote), t.keyword)::int + contains(lower(m.quote), t.keyword || 's')::int as hits from mentions m join themes t on m.question_id = t.question_id),
keyed as (select question_id, mention_id, case when hits > 0 then theme_id else question_id || '_T8' end as theme_id from (select *, row_number() over (partition by mention_id order by hits desc, theme_id) as rn from k) where rn = 1)"""


@query(f"""#{KEYED}, n as (select theme_id, count(*) as n, any_value(question_id) as q from keyed group by 1),
s as (select n.*, type, sum(n) over (partition by q) as total from n left join themes t on n.theme_id = t.theme_id)
select theme_id as entity_key, 'distribution' as check_name, 'warning' as severity, 'too large a share' as message from s where n * 100 > total * case when coalesce(type, 'other') = 'other' then 25 else 40 end""")
def distribution_warnings(spark, sf_dir):
    """Shares of themes that keywords assign."""
    t = Tables(spark, sf_dir)
    return checks.distribution(semantic.assign_mentions(t.mentions, t.themes), t.themes)


from veritally.plans import forms as _forms  # noqa: E402, F401  registers its queries here
from veritally.plans import sections as _sections  # noqa: E402, F401  uses SQL of theirs
from veritally.plans import packets as _packets  # noqa: E402, F401
SQL["claims_enforced"] = SQL["claims_enforced"].replace("with ", "with recursive ", 1)
