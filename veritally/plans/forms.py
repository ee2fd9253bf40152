"""Queries on forms of text, on checks of reports and runs, and on what carries over from run to run."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritally.functions import jsonschema
from veritally.functions import text as fx
from veritally.operators import audit, checks, counting, grounding, ledger, rendering, reporting, selection, semantic
from veritally.plans.queries import COUNTS, LAYERS, OUTLIERS, SQL, STRAIGHT, THEMED, TOTALS, Tables, norm, pct, query, squeeze, words
from veritally.semantics import anchor, canonical_digest, case_kept
from veritally.sources import adapters as src
from veritally.sources.staging import cut, unsent

NAME = "concat('doc_', doc_id)"


@query(r"""
select mention_id, sha256(replace(replace(replace(replace(replace(quote, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) as html,
  sha256(regexp_replace(quote, '([\\`*_{}\[\]<>#|$])', '\\\1', 'g')) as markdown, sha256(replace(quote, '\n', chr(10))) as unescaped, 'Doc ' || doc_id as title,
  array_to_string([replace(x, ',', '') for x in regexp_extract_all(lower(quote), '[$€£]?\d+(?:,\d{3})*(?:\.\d+)?(?:%|[kmbx]\b)?')], '|') as numerals,
  regexp_matches(quote, '(?i)\d+\s*%|\(\s*\d+\s+(?:votes?|mentions?|sources?)\s*\)') as numbered,
  'quote-' || left(sha256('["' || mention_id || '"]'), 24) as anchor, case when k % 2 = 0 then sha256(left(quote, 9)) else sha256(quote) end as shown,
  (['', 'Inference: ', 'Recommendation: '])[k % 3 + 1] || mention || case when k % 2 = 0 then ' (' || question_id || ')' else '' end as claim from mentions""")
def text_forms(spark, sf_dir):
    """Escapes, titles, figures, anchors, shown quotes and claim texts of mentions."""
    q, k = F.col("quote"), F.col("k")
    kind = F.element_at(F.array(*map(F.lit, ("observation", "inference", "recommendation"))), (k % 3 + 1).cast("int"))
    return Tables(spark, sf_dir).mentions.select(
        "mention_id",
        F.sha2(fx.html_escaped(q), 256).alias("html"),
        F.sha2(fx.markdown_escaped(q), 256).alias("markdown"),
        F.sha2(fx.newlines(q), 256).alias("unescaped"),
        fx.humanized(F.col("file_id")).alias("title"),
        F.array_join(fx.numerals(q), "|").alias("numerals"),
        fx.number_in_label(q).alias("numbered"),
        anchor("quote", F.col("mention_id")).alias("anchor"),
        F.sha2(fx.shown_quote(F.when(k % 2 == 0, F.left(q, F.lit(9))).otherwise(""), q), 256).alias("shown"),
        fx.claim_text(F.col("mention"), kind, F.when(k % 2 == 0, F.col("question_id"))).alias("claim"),
    )


@query(r"""
select doc_id, cast(len([x for x in string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) if regexp_matches(x, '\d')]) as bigint) as n from documents where text is not null""", alone=True)
def claim_sentences(spark, sf_dir):
    """Sentences with figures, by document."""
    docs = Tables(spark, sf_dir).raw("documents").where("text is not null")
    return docs.select("doc_id", F.size(fx.sentences_with_numbers(F.col("text"))).cast("long").alias("n"))


@query(rf"""
select mention_id, sha256(trim(regexp_replace(replace(translate(quote, '‘’“”–—', {STRAIGHT}), '…', '...'), '[\s\p{{Z}}]+', ' ', 'g'))) as kept_case from mentions""")
def case_kept_quotes(spark, sf_dir):
    return Tables(spark, sf_dir).mentions.select("mention_id", F.sha2(case_kept(F.col("quote")), 256).alias("kept_case"))


_stop = ",".join(f"'{w}'" for w in fx.STOPWORDS)
OWN = rf"""list_filter([regexp_replace(x, '^[.,;:()"''!?\-]+|[.,;:()"''!?\-]+$', '', 'g') for x in regexp_extract_all(lower(quote), '[^\s\p{{Z}}]+')], lambda x: length(x) >= 3 and x not in ({_stop}))"""
_alike = "len(list_filter(own, lambda w: case when length(w) >= 4 and length({0}) >= 4 then contains(w, {0}) or contains({0}, w) else w = {0} end)) > 0"


@query(f"""#w as (select a.theme_id, m.mention_id, t.keyword, t.keyword || 's' as plural, {OWN} as own from assignments a join mentions m on a.mention_id = m.mention_id join themes t on a.theme_id = t.theme_id)
select theme_id, mention_id, len(own) > 0 and not ((keyword not in ({_stop}) and {_alike.format("keyword")}) or {_alike.format("plural")}) as off_topic from w""")
def quote_topics(spark, sf_dir):
    """Whether a quote has a word in common with its theme."""
    t = Tables(spark, sf_dir)
    keys = t.themes.select("theme_id", fx.theme_keywords(F.col("include"), F.col("description")).alias("keys"))
    rows = t.assignments.select("theme_id", "mention_id").join(t.mentions.select("mention_id", "quote"), "mention_id").join(keys, "theme_id")
    return rows.select("theme_id", "mention_id", fx.off_topic(F.col("quote"), F.col("keys")).alias("off_topic"))


@query("""
select mention_id, k % 2 = 0 as kept_words from mentions where len(string_split(quote, ' ')) > 2""")
def display_deletions(spark, sf_dir):
    """Displays that drop the first word of a quote, and ones with a word of their own."""
    rows = Tables(spark, sf_dir).mentions.where(F.size(F.split("quote", " ")) > 2)
    shorter = F.regexp_replace("quote", "(?s)^[^ ]* ", "")
    display = F.when(F.col("k") % 2 == 0, shorter).otherwise(F.concat(shorter, F.lit(" §own")))
    return rows.select("mention_id", fx.deletion_only(display, F.col("quote")).alias("kept_words"))


@query("""
select 'doc_' || doc_id as entity_key, case when doc_id % 5 = 4 then 'error' else 'editorial' end as severity from documents where doc_id % 5 = 4 or doc_id % 5 < 2 or doc_id % 3 + 1 < 2""", alone=True)
def quality_scores(spark, sf_dir):
    """Scores of claims that are out of range, or too low to admit them."""
    i = F.col("doc_id")
    scores = F.struct((i % 5).alias("relevance"), (i % 3 + 1).alias("support"), F.lit(3).alias("added_value"), F.lit(2).alias("clarity"))
    rows = Tables(spark, sf_dir).raw("documents").select(F.expr(NAME).alias("claim_id"), scores.alias("quality"))
    return checks.quality_scores(rows).select("entity_key", "severity")


@query(rf"""s as (select 'doc_' || doc_id as key, text, {words("text")} as n, left(text, 130) as headline from documents)
select key as entity_key, 'synthesis_words' as check_name from s where text is not null and not n between 80 and 220
union all select key, 'paragraphs' from s where len([x for x in regexp_split_to_array(text, '\n\s*\n') if trim(x) <> '']) > 3
union all select key, 'headline' from s where length(headline) > 120 union all select key, 'newlines' from s where contains(text, '\n')
union all select key, 'headline_number' from s where regexp_matches(headline, '(?i)\d+\s*%|\(\s*\d+\s+(?:votes?|mentions?|sources?)\s*\)')
union all select key, 'missing' from s where substr(key, 5)::bigint % 7 = 3""".replace("s as (", "#s as (", 1), alone=True)
def report_issues(spark, sf_dir):
    """Lengths and layout of the sections of a report, and questions that have none."""
    docs = Tables(spark, sf_dir).raw("documents")
    rows = docs.select("doc_id", F.expr(NAME).alias("question_id"), F.col("text").alias("synthesis"), F.left("text", F.lit(130)).alias("headline"))
    every, some = checks.report(rows, rows), checks.report(rows, rows.where("doc_id % 7 <> 3"))
    return every.select("entity_key", "check_name").unionByName(some.where("check_name = 'missing'").select("entity_key", "check_name"))


_terms = f"list_distinct(list_filter(regexp_extract_all(lower(quote), '\\p{{L}}{{4,}}'), lambda w: w not in ({_stop})))"


@query(rf"""#c as (select mention_id, list_distinct(regexp_extract_all(quote, '\d+(?:\.\d+)?')) as n, {_terms} as t from mentions where question_id = 'Q1'),
s as (select list_distinct(regexp_extract_all(quote, '\d+(?:\.\d+)?')) as n, {_terms} as u from mentions where question_id = 'Q2'),
hits as (select distinct c.mention_id from (select mention_id, t, unnest(n) as x from c) c join (select u, unnest(n) as x from s) s on c.x = s.x where len(list_intersect(t, u)) >= 2)
select mention_id as claim_id, len(n) = 0 or mention_id in (select mention_id from hits) as traced from c""")
def claim_tracing(spark, sf_dir):
    """Claims of one question that state a number, traced to statements of another."""
    m = Tables(spark, sf_dir).mentions
    return grounding.trace_claims(m.where("question_id = 'Q1'").select(F.col("mention_id").alias("claim_id"), F.col("quote").alias("text")), m.where("question_id = 'Q2'").select(F.col("mention_id").alias("statement_id"), F.col("quote").alias("text")))


@query("""#b as (select quote, quote_attribution, file_id, left(quote, 5 + k % 2) as d from mentions where notable_quote),
one as (select quote, quote_attribution, file_id, min(d) as display_quote from b group by all having min(d) = max(d))
select mention_id, display_quote from mentions m left join one o on m.quote = o.quote and m.quote_attribution = o.quote_attribution and m.file_id = o.file_id""")
def carried_displays(spark, sf_dir):
    m = Tables(spark, sf_dir).mentions.withColumnRenamed("quote_attribution", "attribution")
    before = m.where("notable_quote").withColumn("display_quote", F.left("quote", 5 + F.col("k") % 2))
    return grounding.carried_displays(m.withColumn("display_quote", F.lit(None).cast("string")), before).select("mention_id", "display_quote")


@query("""
select f.file_id, mention_id from files f left join (select file_id, min(mention_id) as mention_id from mentions where notable_quote and question_id = 'Q3' group by 1 having count(*) = 1) m on f.file_id = m.file_id""")
def lead_quotes(spark, sf_dir):
    """The notable quote of a file on one question, where there is exactly one."""
    t = Tables(spark, sf_dir)
    rows = t.mentions.where("notable_quote and question_id = 'Q3'").select("file_id", "mention_id")
    return grounding.unique_matches(t.files.select("file_id"), rows, "file_id")


@query("""#s as (select conv_id, turn, turn // 4 as block, turn * 10 as a, turn * 10 + 9 as b from conversations),
p as (select conv_id, turn, 1 as place, turn as seq from s union all select conv_id, turn, 2, turn + 1 + (conv_id % 3 = 0)::int from s),
j as (select p.conv_id, p.turn, place, p.seq, s.block, s.a, s.b from p left join s on p.conv_id = s.conv_id and p.seq = s.turn),
l as (select *, lag(seq) over w as before, lag(block) over w as block0 from j window w as (partition by conv_id, turn order by place))
select conv_id || ':' || turn as selection_id, cast(min(a) as bigint) as start, cast(max(b) as bigint) as "end", bool_and(coalesce(a is not null and (place = 1 or (seq = before + 1 and block = block0)), false)) as consecutive from l group by 1""", alone=True)
def span_selections(spark, sf_dir):
    """Pairs of spans: offsets, and whether they follow one another in one turn."""
    c = Tables(spark, sf_dir).raw("conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("seq"))
    spans = c.select("file_id", "seq", F.floor(F.col("seq") / 4).alias("turn"), (F.col("seq") * 10).cast("long").alias("start"), (F.col("seq") * 10 + 9).cast("long").alias("end"))
    pick = lambda place, seq: c.select(F.concat("file_id", F.lit(":"), "seq").alias("selection_id"), F.lit(place).alias("place"), "file_id", seq.alias("seq"))
    chosen = pick(1, F.col("seq")).unionByName(pick(2, F.col("seq") + 1 + (F.col("file_id") % 3 == 0).cast("int")))
    return reporting.span_selections(chosen, spans)


_latest = "latest as (select mention_id, round, verdict from (select *, row_number() over (partition by mention_id order by round desc, line desc) as rn from verdicts) where rn = 1)"


@query(f"""#{_latest}, e as (select count(*) as entries, count(*) filter (doc_id % 10 <> 0) as by_agent from verdicts), l as (select count(*) as audited, count(*) filter (verdict <> 'pass') as open, coalesce(max(round), 0) as rounds from latest)
select entries, by_agent, audited, open, cast(rounds as integer) as rounds, case when audited < 5 then 'too_few' when by_agent * 100 < entries * 80 then 'not_by_agents' when open > 0 then 'open_failures' else 'complete' end as verdict from e, l""")
def audit_completeness(spark, sf_dir):
    rows = Tables(spark, sf_dir).verdicts.withColumn("agent_id", F.when(F.col("doc_id") % 10 != 0, "agent"))
    return audit.completeness(rows)


@query("""
select event as phase, count(*) as n, count(*) filter (event_id % 4 <> 0) as dispatched, count(*) filter (event_id % 4 <> 0) * 100 >= count(*) * 80 as compliant from ledger group by 1""")
def dispatch_compliance(spark, sf_dir):
    return audit.dispatch_compliance(Tables(spark, sf_dir).ledger.select(F.col("event").alias("phase"), (F.col("event_id") % 4 != 0).alias("dispatched")))


@query("""
select mention_id, round from verdicts where doc_id % 2 = 1""")
def stale_verdicts(spark, sf_dir):
    """Verdicts whose mention isn't what it was when they were given."""
    t = Tables(spark, sf_dir)
    now = audit.fingerprints(t.mentions)
    given = t.verdicts.join(now, "mention_id", "left").withColumn("fingerprint", F.when(F.col("doc_id") % 2 == 0, F.col("fingerprint")).otherwise("old"))
    return audit.stale(given, t.mentions).select("mention_id", "round")


_stats = f"""q as (select question_id, count(distinct mention_id) as m, count(distinct file_id) as s from mentions group by 1),
th as (select a.question_id, a.theme_id, count(distinct m.mention_id) as m, count(distinct m.file_id) as s from assignments a join mentions m on a.mention_id = m.mention_id group by all),
st as (select question_id as scope, m, m as am, s, s as sm from q union all select th.question_id, th.m, q.m, th.s, q.s from th join q on th.question_id = q.question_id)"""
_parts = ["mention_count", pct("mention_count", "total_mentions"), "source_type_count", pct("source_type_count", "total_source_types"), "segment_count", pct("segment_count", "total_segments"), "total_mentions", "total_source_types", "total_segments"]


@query(f"""#{COUNTS}, {_stats},
own as (select question_id as scope, unnest([{",".join(f"cast({x} as varchar)" for x in _parts)}]) as value from counts
  union all select scope, unnest([m::varchar, am::varchar, ({pct("m", "am")})::varchar, s::varchar, sm::varchar, ({pct("s", "sm")})::varchar]) from st
  union all select question_id, unnest(regexp_extract_all(quote, '\\d{{2,}}')) from mentions)
select distinct scope, value from (select * from own union all select 'global', value from own
  union all select 'global', unnest([(count(*) filter (quality = 'good' and not excluded))::varchar, (count(*) filter (excluded))::varchar, coalesce(sum(interaction_count) filter (quality = 'good' and not excluded), 0)::varchar]) from files)""")
def number_registry(spark, sf_dir):
    """Numbers that prose may state, by question and in all."""
    t = Tables(spark, sf_dir)
    return reporting.number_registry(t.counts(), counting.inventory_stats(t.mentions, t.assignments), t.mentions, counting.methodology(t.files))


@query(f"""#{OUTLIERS}
select question_id, theme_id, type, mention_count from counts where type <> 'other'
union all select question_id, question_id || '_other', 'other', count(*) from outliers group by 1""")
def other_rows(spark, sf_dir):
    """Theme rows with one for the mentions that no theme holds, where a question has no ``other``."""
    t = Tables(spark, sf_dir)
    return counting.with_other(t.counts().where("type <> 'other'").select("question_id", "theme_id", "type", "mention_count"), t.outliers())


@query(f"""#{TOTALS} select cast(sum(total_mentions) as bigint) as total_mentions, count(*) as questions from totals""")
def header_totals(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return counting.header_totals(counting.question_totals(t.mentions, t.assignments, t.files))


@query("""
select source_type, count(*) as n, row_number() over (order by count(*) desc, source_type) as place from files group by 1""")
def ranked_source_types(spark, sf_dir):
    return counting.ranked_source_types(Tables(spark, sf_dir).files)


@query("select status, count(*) as n from (" + SQL["ledger_replay"] + ") group by 1", alone=True)
def run_progress(spark, sf_dir):
    return ledger.progress(ledger.replay(Tables(spark, sf_dir).ledger))


@query(f"""#{THEMED}, {LAYERS.format("theme_id", "themed")},
p as (select theme_id, question_id, mention_id, notable_quote, row_number() over (partition by theme_id order by not notable_quote, sha256(mention_id), mention_id) as place from layers where layer = 1),
c as (select theme_id, count(*) as n from assignments group by 1),
r as (select p.*, row_number() over (partition by p.question_id order by t.type = 'other', c.n desc, p.theme_id, not notable_quote, place) as rn from p join c on p.theme_id = c.theme_id join themes t on p.theme_id = t.theme_id where place <= 6)
select question_id, theme_id, mention_id from r where rn = 1""")
def pull_quotes(spark, sf_dir):
    """The quote that stands for a question: of its largest theme, notable if there is one."""
    t = Tables(spark, sf_dir)
    shown = selection.executive_observations(t.mentions, t.assignments).select("theme_id", "mention_id", F.col("place").alias("pick"))
    shown = shown.join(t.mentions.select("mention_id", "question_id", "notable_quote"), "mention_id")
    return selection.pull_quotes(shown, t.counts().select("theme_id", "type", "mention_count")).select("question_id", "theme_id", "mention_id")


@query("""
select file_id from files where doc_id % 3 <> 0 order by file_id limit 4""")
def next_batch(spark, sf_dir):
    """The first four sources that nobody has reserved: what a batch is made of."""
    f = Tables(spark, sf_dir).files
    return selection.next_batch(f.select("file_id"), f.where("doc_id % 3 = 0"))


@query("""#e as (select mention_id, list_filter([case when k > 3 then '$.k: more than 3' end, case when regexp_matches(mention_id, '7$') then null else '$.mention_id: doesn''t match 7$' end,
  case when sentiment not in ('positive', 'negative') then '$.sentiment: not one of the values' end], lambda x: x is not null) as e from mentions)
select mention_id, array_to_string(e, '|') as errors from e where len(e) > 0""")
def json_errors(spark, sf_dir):
    """Mentions as JSON against a closed schema."""
    schema = {"type": "object", "required": ["mention_id"], "additionalProperties": False, "properties": {"k": {"type": "integer", "maximum": 3}, "sentiment": {"enum": ["positive", "negative"]}, "mention_id": {"type": "string", "pattern": "7$"}}}
    rows = Tables(spark, sf_dir).mentions
    found = rows.select("mention_id", jsonschema.column(schema)(F.to_json(F.struct("mention_id", "k", "sentiment"))).alias("e")).where(F.size("e") > 0)
    return found.select("mention_id", F.array_join("e", "|").alias("errors"))


@query("""
select 'doc_' || doc_id as entity_key, 'dominant near ' || (doc_id % 100) || '%' as message from documents where doc_id % 100 < 30""", alone=True)
def adjective_checks(spark, sf_dir):
    rows = Tables(spark, sf_dir).raw("documents").select(F.expr(NAME).alias("id"), F.concat(F.lit("a dominant theme at "), F.col("doc_id") % 100, F.lit("% of calls")).alias("text"))
    return checks.adjectives(rows).select("entity_key", "message")


@query(f"""#{COUNTS}, floors as (select *, cast(greatest(2, ceil(total_mentions * 0.03::double)) as bigint) as floor from counts),
flagged as (select *, total_mentions >= 10 and sum((mention_count >= floor)::int) over (partition by question_id) >= 2 and mention_count < floor as demoted from floors),
r as (select question_id, theme_id, row_number() over (partition by question_id order by mention_count desc, theme_id) as rank, count(*) over (partition by question_id, mention_count) = 1 as strict from flagged where not demoted and type <> 'other')
select theme_id as entity_key from themes t where not exists (select 1 from r where r.theme_id = t.theme_id and rank = 1 and strict)""")
def ordinal_claims(spark, sf_dir):
    """Claims that a theme is the most common one, of themes that aren't."""
    t = Tables(spark, sf_dir)
    said = t.themes.select(F.col("theme_id").alias("claim_id"), "question_id", "theme_id", F.concat(F.lit("the most common point: "), "theme_id").alias("text"))
    return checks.ordinal_claims(said, counting.rank_claims(t.flagged())).select("entity_key")


_kind = "(['nps_', 'call_', 'plain_'])[doc_id % 3 + 1]"


@query(f"""#r as (select {_kind} || doc_id as file_id, source_type, doc_id % 3 as h, doc_id % 50 as n, doc_id % 2 = 0 as unknown, doc_id % 7 = 3 as gone from files)
select file_id as entity_key, 'name_hint' as check_name from r where not gone and ((h = 0 and source_type <> 'nps_survey') or (h = 1 and source_type <> 'sales_call'))
union all select file_id, 'count_hint' from r where not gone and n >= 5 and unknown union all select file_id, 'missing' from r where gone""")
def classification_issues(spark, sf_dir):
    """What names and summaries of sources say against how they were classified."""
    i = F.col("doc_id")
    name = F.concat(F.element_at(F.array(*map(F.lit, ("nps_", "call_", "plain_"))), (i % 3 + 1).cast("int")), i).alias("file_id")
    rows = Tables(spark, sf_dir).files.select("doc_id", name, "source_type", F.concat(F.lit("It holds "), i % 50, F.lit(" reviews")).alias("summary"), F.when(i % 2 != 0, 2).alias("interaction_count"))
    return checks.classification(rows.where("doc_id % 7 <> 3"), rows).select("entity_key", "check_name")


@query(f"""#s as (select 'doc_' || doc_id as file_id, {norm("text")} as t from documents)
select file_id as entity_key, 'missing' as check_name from files where file_id not in (select file_id from mentions)
union all select mention_id, 'grounding' from mentions m left join s on m.file_id = s.file_id where quote <> '' and not coalesce(contains(t, {norm("case when k % 9 = 4 then '§' || quote else quote end")}), false)""")
def record_issues(spark, sf_dir):
    """Sources without a record, ids given twice, and quotes that aren't in their source: some of them were changed."""
    t = Tables(spark, sf_dir)
    sources = t.raw("documents").select(F.expr(NAME).alias("file_id"), "text")
    rows = t.mentions.withColumn("quote", F.when(F.col("k") % 9 == 4, F.concat(F.lit("§"), "quote")).otherwise(F.col("quote")))
    return checks.records(rows, t.files.select("file_id"), sources, t.mentions.select("file_id").distinct()).select("entity_key", "check_name")


@query(f"""#s as (select 'doc_' || doc_id as key, {words("text")} as n, doc_id % 5 as q from documents where text is not null)
select key as entity_key, 'words' as check_name from s where not n between 60 and 100 union all select key, 'quotes' from s where not q between 2 and 3 union all select key, 'verbatim' from s where q > 2""", alone=True)
def context_issues(spark, sf_dir):
    """Compressed context: its length, the number of its quotes, and quotes that were changed."""
    some = F.slice(F.array(*map(F.lit, "abcde")), F.lit(1), (F.col("doc_id") % 5).cast("int"))
    rows = Tables(spark, sf_dir).raw("documents").where("text is not null").select(F.expr(NAME).alias("question_id"), F.col("text").alias("summary"), some.alias("quotes"), F.array(F.lit("a"), F.lit("b")).alias("known_quotes"))
    return checks.context_words(rows).select("entity_key", "check_name")


@query("""
select cast(doc_id % 40 as varchar) as partition_id, cast(sum(length(text) // 4) as bigint) as tokens from documents group by 1 having sum(length(text) // 4) > 3000""", alone=True)
def over_capacity(spark, sf_dir):
    rows = Tables(spark, sf_dir).raw("documents").select((F.col("doc_id") % 40).cast("string").alias("partition_id"), F.col("doc_id").alias("part"), F.floor(F.char_length("text") / 4).alias("tokens"))
    return reporting.over_capacity(rows, 3000)


@query("""
select (['extract:', 'section:', 'paint:'])[doc_id % 3 + 1] || file_id as key from files where doc_id % 3 <> 0 union all select 'extract:new_' || doc_id from files where doc_id % 11 = 5""")
def unknown_keys(spark, sf_dir):
    """Work keys of a kind or subject that the plan doesn't have."""
    t = Tables(spark, sf_dir)
    own = t.files.select(F.concat(F.element_at(F.array(*map(F.lit, ("extract:", "section:", "paint:"))), (F.col("doc_id") % 3 + 1).cast("int")), "file_id").alias("key"))
    new = t.files.where("doc_id % 11 = 5").select(F.concat(F.lit("extract:new_"), "doc_id").alias("key"))
    return reporting.unknown_keys(own.unionByName(new), t.files, t.themes.select("question_id").distinct())


@query("""#f as (select key, event as sha256, min(event_id) as arrived from ledger group by all)
select key, sha256, arrived, row_number() over w as attempt, row_number() over w <= 3 as accepted from f window w as (partition by key order by arrived, sha256)""")
def accepted_parts(spark, sf_dir):
    """Submissions of a key: the same bytes again are none, of the others three count."""
    return ledger.accepted(Tables(spark, sf_dir).ledger.select("key", F.col("event").alias("sha256"), F.col("event_id").alias("arrived")))


@query("""
select key as question_id, arg_max(event_id, event_id) as part_id from ledger where event <> 'fail' group by 1""")
def effective_parts(spark, sf_dir):
    rows = Tables(spark, sf_dir).ledger
    return ledger.effective(rows.select(F.col("key").alias("question_id"), F.col("event_id").alias("part_id"), F.lit("").alias("sha256"), F.col("event_id").alias("arrived"), (F.col("event") != "fail").alias("valid"))).select("question_id", "part_id")


@query("""
select 'doc_' || doc_id as path, sha256(coalesce(text, '')) as sha256, case when doc_id % 9 <> 0 then sha256(coalesce(text, '') || '!') end as now from documents where doc_id % 9 = 0 or doc_id % 5 = 0""", alone=True)
def changed_inputs(spark, sf_dir):
    """Sources that changed since the manifest, or went."""
    d = Tables(spark, sf_dir).raw("documents")
    text = F.coalesce("text", F.lit(""))
    now = d.where("doc_id % 9 <> 0").select(F.expr(NAME).alias("path"), F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat(text, F.lit("!"))).otherwise(text), 256).alias("sha256"))
    return ledger.changed_inputs(d.select(F.expr(NAME).alias("path"), F.sha2(text, 256).alias("sha256")), now).select("path", "sha256", F.col("_now").alias("now"))


@query("""
select event_id, sha256('["' || key || '","' || event || '","' || (['retry','skip','fallback'])[event_id % 3 + 1] || '","step","' || (['fixed','accepted'])[event_id % 2 + 1] || '"]') as digest from ledger""")
def deviation_digests(spark, sf_dir):
    rows = Tables(spark, sf_dir).ledger
    pick = lambda n, *of: F.element_at(F.array(*map(F.lit, of)), (F.col("event_id") % n + 1).cast("int"))
    made = rows.select("event_id", F.col("key").alias("phase"), F.col("event").alias("step"), pick(3, "retry", "skip", "fallback").alias("category"), F.lit("step").alias("description"), pick(2, "fixed", "accepted").alias("resolution"))
    return ledger.deviations(made).select("event_id", "digest")


@query(f"""#l as (select {_kind} || doc_id as file_id, doc_id % 3 as h, doc_id % 4 as g from files)
select file_id, (['nps_survey', 'sales_call', 'other'])[h + 1] as source_type, (['seg1', 'seg2', 'seg3', 'unknown'])[g + 1] as segment_id from l""")
def classified_sources(spark, sf_dir):
    """The plain stand-ins: a type by the file's name, a segment by its label."""
    i = F.col("doc_id")
    name = F.concat(F.element_at(F.array(*map(F.lit, ("nps_", "call_", "plain_"))), (i % 3 + 1).cast("int")), i)
    label = F.element_at(F.array(*map(F.lit, (" Small  Firms", "MID market", "large", "?"))), (i % 4 + 1).cast("int"))
    files = Tables(spark, sf_dir).files.select(name.alias("file_id"), label.alias("segment"))
    known = spark.createDataFrame([("seg1", "small firms"), ("seg2", "Mid Market"), ("seg3", "Large")], "id string, label string")
    return semantic.classify(files.select("file_id")).join(semantic.reconcile_segments(files, known), "file_id")


@query(f"""#{THEMED}, {LAYERS.format("theme_id", "themed")},
p as (select theme_id, question_id, mention_id, quote, row_number() over (partition by theme_id order by not notable_quote, sha256(mention_id), mention_id) as place from layers where layer = 1)
select 'quote-' || left(sha256('["' || theme_id || '","' || mention_id || '"]'), 24) as anchor, question_id, theme_id, mention_id,
  replace(replace(replace(replace(replace(quote, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as quote from p where place <= 6""")
def evidence_rows(spark, sf_dir):
    """Quotes as the evidence file holds them."""
    t = Tables(spark, sf_dir)
    shown = selection.executive_observations(t.mentions, t.assignments).select("theme_id", "mention_id").join(t.mentions.select("mention_id", "question_id", "quote"), "mention_id")
    return rendering.evidence_rows(shown)


@query(f"""#{COUNTS}, floors as (select *, cast(greatest(2, ceil(total_mentions * 0.03::double)) as bigint) as floor from counts),
flagged as (select *, total_mentions >= 10 and sum((mention_count >= floor)::int) over (partition by question_id) >= 2 and mention_count < floor as demoted from floors)
select 'o_' || theme_id as opportunity_id, theme_id, 'raised in ' || mention_count || ' calls' as text from flagged where not demoted""")
def opportunity_texts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.themes.select(F.concat(F.lit("o_"), "theme_id").alias("opportunity_id"), "theme_id", F.lit("raised in {calls} calls").alias("text"))
    return rendering.opportunities(rows, t.flagged())


@query("""
select 'questions.doc_' || doc_id || p.part as path, sha256(case p.part when '.headline' then left(text, 20) when '.synthesis' then text else 'point ' || p.part end) as text, 'doc_' || doc_id as question_id
from documents, (values ('.headline'), ('.synthesis'), ('.takeaways[0]'), ('.takeaways[1]')) p(part) where text is not null
union all select 'findings.f' || doc_id || p.part, sha256(case p.part when '.title' then 'title' else left(text, 9) end), null from documents, (values ('.title'), ('.text')) p(part) where text is not null""", alone=True)
def narrative_fields(spark, sf_dir):
    """All prose of a report, field by field."""
    d = Tables(spark, sf_dir).raw("documents").where("text is not null")
    sections = d.select(F.expr(NAME).alias("question_id"), F.left("text", F.lit(20)).alias("headline"), F.col("text").alias("synthesis"), F.array(F.lit("point .takeaways[0]"), F.lit("point .takeaways[1]")).alias("takeaways"))
    findings = d.select(F.concat(F.lit("f"), "doc_id").alias("id"), F.lit("title").alias("title"), F.left("text", F.lit(9)).alias("text"))
    return reporting.narrative_fields(sections, findings).select("path", F.sha2("text", 256).alias("text"), "question_id")


@query("""
select file_id, case when doc_id % 3 = 0 then 'unknown' else 'seg' || (doc_id % 3) end as segment, doc_id % 23 = 0 as excluded, case when doc_id % 23 = 0 then 'why' end as exclusion_reason from files""")
def plan_files(spark, sf_dir):
    """A plan: classified sources with exclusions and segments."""
    f = Tables(spark, sf_dir).files
    segments = f.where("doc_id % 3 <> 0").select("file_id", F.concat(F.lit("seg"), F.col("doc_id") % 3).alias("segment_id"))
    out = reporting.plan_files(f.select("file_id", "segment", F.lit("s").alias("summary")), f.where("excluded").select("file_id", F.lit("why").alias("exclusion_reason")), segments)
    return out.select("file_id", "segment", "excluded", "exclusion_reason")


@query(f"""#{COUNTS} select theme_id, mention_count + (theme_id = 'Q1_T1')::int as mention_count, 'stored' as side from counts where theme_id = 'Q1_T1' union all select theme_id, mention_count, 'now' from counts where theme_id = 'Q1_T1'""")
def recomputed_counts(spark, sf_dir):
    """Stored counts, one of them off, against counts made now."""
    now = Tables(spark, sf_dir).counts().select("theme_id", "mention_count")
    stored = now.withColumn("mention_count", F.col("mention_count") + (F.col("theme_id") == "Q1_T1").cast("long"))
    return checks.changed(stored, now)


@query("""#i as (select mention_id as component_id, file_id as packet_id, case when k % 7 = 3 then 'editorial' when k % 11 = 5 then 'error' end as severity from mentions),
h as (select packet_id, not bool_or(coalesce(severity = 'error', false)) as packet_ok from i group by 1)
select component_id, i.packet_id, packet_ok from i join h on i.packet_id = h.packet_id where severity is null""")
def admitted_components(spark, sf_dir):
    """Parts of a packet without issues, and whether the packet stands."""
    rows = Tables(spark, sf_dir).mentions.select(F.col("mention_id").alias("component_id"), F.col("file_id").alias("packet_id"), "k")
    found = rows.select(F.col("component_id").alias("entity_key"), F.when(F.col("k") % 7 == 3, "editorial").when(F.col("k") % 11 == 5, "error").alias("severity")).where("severity is not null")
    return reporting.admitted(rows.drop("k"), found).select("component_id", "packet_id", "packet_ok")


@query("""
select mention_id as entity_key, 'source_observation' as check_name from mentions where k % 6 = 2 union all select 'ghost_' || doc_id, 'source_observation' from mentions where k = 0""")
def source_observations(spark, sf_dir):
    """Observations that are no exact copy of their mention: some changed, some of no mention."""
    m = Tables(spark, sf_dir).mentions
    names = ["file_id", "question_id", "mention", "quote", "quote_attribution", "sentiment"]
    own = m.select(F.col("mention_id").alias("claim_id"), "mention_id", *[F.when(F.col("k") % 6 == 2, F.concat(c, F.lit("!"))).otherwise(F.col(c)).alias(c) if c == "quote" else F.col(c) for c in names])
    ghosts = m.where("k = 0").select(F.concat(F.lit("ghost_"), "doc_id").alias("claim_id"), F.lit("none").alias("mention_id"), *names)
    return reporting.source_observations(own.unionByName(ghosts), m).select("entity_key", "check_name")


@query("""
select 'c' || doc_id as entity_key, case doc_id % 4 when 1 then 'clause_missing' when 2 then 'clause_repeated' else 'clauses_overlap' end as check_name from documents where doc_id % 4 <> 0""", alone=True)
def clause_bindings(spark, sf_dir):
    """Count clauses that don't occur exactly once in their text, or that overlap."""
    i = F.col("doc_id")
    said = F.concat(F.lit("it was 3 mentions, then 4 mentions; and 4 mentions"), F.lit(" in doc "), i)
    clauses = F.when(i % 4 == 0, F.array(F.lit("3 mentions"), F.lit("it was"))).when(i % 4 == 1, F.array(F.lit("9 mentions"))).when(i % 4 == 2, F.array(F.lit("4 mentions"))).otherwise(F.array(F.lit("it was 3"), F.lit("3 mentions")))
    rows = Tables(spark, sf_dir).raw("documents").select(F.concat(F.lit("c"), i).alias("claim_id"), said.alias("text"), clauses.alias("clauses"))
    return reporting.clause_issues(rows).select("entity_key", "check_name")


@query("""
select 'o' || doc_id as entity_key, cast(10 + doc_id % 90 as varchar) as value from documents where doc_id % 4 <> 0""", alone=True)
def opportunity_numbers(spark, sf_dir):
    """Numbers in opportunities that their quotes don't have."""
    i = F.col("doc_id")
    n = 10 + i % 90
    rows = Tables(spark, sf_dir).raw("documents").select(F.concat(F.lit("o"), i).alias("opportunity_id"), F.concat(F.lit("saves "), n, F.lit(" runs")).alias("text"), F.when(i % 4 == 0, F.concat(F.lit("we lost "), n, F.lit(" runs"))).otherwise("we lost some").alias("quote"))
    return reporting.opportunity_numbers(rows).select(F.col("opportunity_id").alias("entity_key"), "value")


@query("""
select mention_id as entity_key, 'not_failed' as check_name from verdicts where round = 2 and mention_id not in (select mention_id from verdicts where round = 1 and verdict <> 'pass')""")
def repair_subset(spark, sf_dir):
    """Repairs of mentions that hadn't failed."""
    v = Tables(spark, sf_dir).verdicts
    return checks.foreign(v.where("round = 2"), "mention_id", v.where("round = 1 and verdict <> 'pass'"), "mention_id", "not_failed").select("entity_key", "check_name")


@query("""#n as (select distinct mention_id as id from mentions where k % 3 = 0 intersect select mention_id from mentions where k % 2 = 0) select id as entity_key, 'shared' as check_name from n""")
def shared_ids(spark, sf_dir):
    """Ids that stand both in support and in contrast of a claim, where the two must be apart."""
    m = Tables(spark, sf_dir).mentions
    return checks.disjoint(m.where("k % 3 = 0").select("mention_id"), m.where("k % 2 = 0").select("mention_id"), "mention_id").select("entity_key", "check_name")


@query(r"""
select doc_id, array_to_string(['a > b', 'said ' || doc_id], '|') as quotes from documents""", alone=True)
def block_quotes(spark, sf_dir):
    """Block quotes of Markdown, lines that follow one another joined."""
    text = F.concat(F.lit("# T\n> a > b\n\nprose > none\n> said\n> "), "doc_id", F.lit("\nend"))
    return Tables(spark, sf_dir).raw("documents").select("doc_id", F.array_join(fx.block_quotes(text), "|").alias("quotes"))


@query("""
select 'r' || doc_id as entity_key, case doc_id % 4 when 1 then 'mode' else 'sample' end as check_name from documents where doc_id % 4 in (1, 2)""", alone=True)
def request_issues(spark, sf_dir):
    """Requests of an unknown mode, or with a sample beyond its limits."""
    i = F.col("doc_id")
    rows = Tables(spark, sf_dir).raw("documents").select(F.concat(F.lit("r"), i).alias("request_id"), F.when(i % 4 == 1, "quick").otherwise("sampled").alias("mode"), F.when(i % 4 == 2, 21).otherwise(20).alias("mentions"), F.lit(6).alias("sources"))
    return checks.requests(rows).select("entity_key", "check_name")


@query(f"""#d as (select file_id, {squeeze("quote")} as q from mentions)
select file_id, count(*) as mentions, count(distinct q) as quotes from d group by 1""")
def distinct_quotes(spark, sf_dir):
    """Mentions of a file and how many different quotes they have: what is left of its context without repeats."""
    return counting.distinct_quotes(Tables(spark, sf_dir).mentions)


# SQL of queries that stand elsewhere

_meta = "(" + " or ".join("contains(l, '" + x.replace("'", "''") + "')" for x in fx.META_PHRASES) + ")"
_not_intro, _roles = (",".join(f"'{w}'" for w in x) for x in (fx.NOT_INTRO, fx.ROLES))
_intro = r"(?:^|[.!?;]\s)(?:so\s+|and\s+|well\s+)?i(?:''m|\s+am)\s+(?:the\s+|a\s+|an\s+)?((?:[\p{L}\p{N}_]+\s+){0,8})"


def low_signal(x: str, rows: str) -> str:
    """SQL of rows with ``low``: whether the text ``x`` is about the call or the speaker and has no business signal."""
    return rf"""(select *, length({x}) >= 10 and ({_meta} or (coalesce(said[1], '') not in ({_not_intro}) and len(list_filter(said, lambda w: w in ({_roles}))) > 0))
  and not (regexp_matches({x}, '\d{{2,}}|\$\d') or regexp_matches({x}, '(?i)\b(?:{fx.STEMS})[\p{{L}}\p{{N}}_]*') or regexp_matches({x}, '(?i){fx.CLAIM}')) as low
  from (select *, lower({x}) as l, [regexp_replace(w, '^[.,;:()"'']+|[.,;:()"'']+$', '', 'g') for w in regexp_extract_all(regexp_extract(lower({x}), '{_intro}', 1), '\S+')] as said from {rows}))"""


SQL["low_signal_quotes"] = f"select conv_id, turn, coalesce(low, false) as low_signal from {low_signal('text', 'conversations')}"

_n = words("quote")
_fields = r"[regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') for x in string_split(quote, ',')]"
_csv = rf"(regexp_matches(quote, '^[A-Z]{{2,}}-\d+,') or (len({_fields}) >= 4 and len([x for x in {_fields} if regexp_matches(x, '^(\d{{4}}-\d{{2}}-\d{{2}}|\d+(\.\d+)?)$')]) > 0))"
_markup = r"regexp_matches(quote, '\*\*[^*]+\*\*|__[^_]+__')"

SQL["mention_issues"] = (
    src.SQL
    + f""", m as (select *, {_n} as n, {_csv} as csv, {_markup} as markup from {low_signal("quote", "mentions")}),
i as (
  select 'csv_quote' as check_name, 'warning' as severity from m where csv union all select 'markdown_quote', 'warning' from m where markup
  union all select 'low_signal', 'warning' from m where low union all select 'quote_long', 'error' from m where n > 100 union all select 'quote_short', 'warning' from m where n < 6
  union all select 'timestamp', 'warning' from m where regexp_matches(quote, '\\d{{2}}:\\d{{2}}:\\d{{2}}') union all select 'notable_short', 'warning' from m where notable_quote and n < 8
  union all select 'quote_is_mention', 'error' from m where quote = mention
  union all select 'quote_reuse', 'warning' from (select row_number() over (partition by file_id, {squeeze("quote")} order by mention_id) as r from m) where r > 5
  union all select 'mention_cap', case when c > case when w > 1 then 35 else 12 end then 'error' else 'warning' end from (
    select count(*) as c, any_value(f.interaction_count) as w from m join files f on m.file_id = f.file_id group by m.file_id, question_id) where c > case when w > 1 then 25 else 6 end)
select check_name, severity, count(*) as n from i group by all"""
)


def _greedy_sql(rows: str, group: str, keys: str, take: int, cap: int, columns: str) -> str:
    """A greedy choice as a recursive walk down each group's order: no text twice, at most ``cap`` of a source where there are several."""
    return f""", cand as (
  select *, {squeeze("quote")} as seen, row_number() over (partition by theme_id order by {keys}) as nth,
    case when min(file_id) over (partition by theme_id) = max(file_id) over (partition by theme_id) then {take} else {cap} end as most from ({rows})),
walk as (
  with recursive w(theme_id, nth, ids, seens, sources) as (
    select distinct theme_id, cast(0 as bigint), cast([] as varchar[]), cast([] as varchar[]), cast([] as varchar[]) from cand
    union all
    select w.theme_id, c.nth, case when ok then list_append(ids, mention_id) else ids end, case when ok then list_append(seens, seen) else seens end, case when ok then list_append(sources, file_id) else sources end
    from w join (select * from cand) c on w.theme_id = c.theme_id and c.nth = w.nth + 1,
      lateral (select not list_contains(seens, c.seen) and len(list_filter(sources, lambda x: x = c.file_id)) < c.most as ok) where len(ids) < {take})
  select theme_id, arg_max(ids, nth) as ids from w group by 1),
picked as (select theme_id, unnest(ids) as mention_id, generate_subscripts(ids, 1) as pick from walk)
select {columns} from picked p join cand c on p.theme_id = c.theme_id and p.mention_id = c.mention_id"""


_themed = f"""select a.question_id, a.theme_id, m.mention_id, m.file_id, m.quote, m.notable_quote, m.low, {_n} as n, {_csv} as csv, {_markup} as markup, {OWN} as own, t.keyword, t.keyword || 's' as plural
  from assignments a join {low_signal("quote", "mentions")} m on a.mention_id = m.mention_id join themes t on a.theme_id = t.theme_id"""
_off = f"(len(own) > 0 and not ((keyword not in ({_stop}) and {_alike.format('keyword')}) or {_alike.format('plural')}))"

SQL["select_quotes"] = src.SQL + _greedy_sql(
    f"select * from ({_themed}) where n <= 100",
    "theme_id",
    rf"(n > 150 or n < 5 or regexp_matches(quote, '\d{{2}}:\d{{2}}:\d{{2}}')), low, not notable_quote, csv::int * 2 + markup::int, not n between 15 and 80, {_off}, mention_id",
    5,
    3,
    "c.question_id, p.theme_id, p.pick, p.mention_id, c.file_id, c.quote, c.notable_quote",
)
SQL["quote_candidates"] = src.SQL + _greedy_sql(
    f"select * from ({_themed}) where n between 5 and 100", "theme_id", "low, csv, not notable_quote, not n between 15 and 80, mention_id", 3, 2, "c.question_id, p.theme_id, p.pick, p.mention_id, c.file_id, c.quote"
)

_quotas = """, z as (select source_type, count(*) as size from files group by 1), b as (select sum(size) as total, least(ceil(sum(size) * 0.25::double), sum(size)) as budget from z),
f as (select source_type, size, least(size, greatest(1, cast(floor(size::double / total * budget) as bigint))) as q, budget from z, b),
o as (select *, row_number() over (partition by q < size order by size desc, source_type) as place, sum(q) over () as given from f),
quotas as (select source_type, size, cast(q + (q < size and place <= budget - given)::int as bigint) as quota from o)"""
SQL["stratified_quotas"] = src.SQL + _quotas + " select source_type, size, quota from quotas"
SQL["stratified_sample"] = (
    src.SQL + _quotas + ", r as (select file_id, source_type, row_number() over (partition by source_type order by sha256('seed' || file_id), file_id) as rn from files) select file_id, r.source_type from r join quotas q on r.source_type = q.source_type where rn <= quota"
)

SQL["extracted_mentions"] = r"""with s as (
  select conv_id, turn, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) as quote, generate_subscripts(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) - 1 as k
  from conversations where role = 'user')
select 'conv_' || conv_id as file_id, 'conv_' || conv_id || '_Q1_' || (turn * 1000 + k) as mention_id, 'Q1' as question_id, quote from s where """ + words("quote") + " between 6 and 100"


@query("""
select claim_id, kind, number, unit, denominator, percentage, scopes from (
  select 'c' || doc_id as claim_id, 'ratio' as kind, cast(doc_id % 7 as double) as number, 'mentions' as unit, 20.0::double as denominator, cast(doc_id % 100 as double) as percentage, '' as scopes from documents
  union all select 'c' || doc_id, 'count', 10.0 + doc_id % 3, 'source_files', null, null, 'Q2' from documents
  union all select 'c' || doc_id, 'percentage', 30, null, null, null, '' from documents
  union all select 'c' || doc_id, 'count', 23, 'unverified_identity', null, null, '' from documents)""", alone=True)
def claim_quantities(spark, sf_dir):
    """Quantities of claims: a ratio with its share, a count of a question, a bare share, a number in words; a quoted one isn't read."""
    from veritally.functions import prose

    i = F.col("doc_id")
    said = F.concat(i % 7, F.lit(" of 20 mentions ("), i % 100, F.lit("%) and "), 10 + i % 3, F.lit(" Q2 sources; “99 mentions” and 30% by twenty-three customers, open 24/7"))
    rows = Tables(spark, sf_dir).raw("documents").select(F.concat(F.lit("c"), i).alias("claim_id"), F.explode(prose.column("quantities")(said)).alias("x"))
    return rows.select("claim_id", "x.kind", "x.number", "x.unit", "x.denominator", "x.percentage", F.array_join("x.question_scopes", ",").alias("scopes"))


@query(f"""#{_stats}, c as (select theme_id, question_id, count(*) as n from assignments group by all)
select theme_id as entity_key, 'unsupported' as check_name from c where not exists (select 1 from st where scope = question_id and m = n + 1)
union all select theme_id || ':elsewhere', 'scope' from c union all select theme_id || ':people', 'identity' from c""")
def unsupported_quantities(spark, sf_dir):
    """Claims about themes: one more mention than there are, the count under another question's name, and a count of people."""
    t = Tables(spark, sf_dir)
    n = t.assignments.groupBy("theme_id", "question_id").agg(F.count(F.lit(1)).alias("n"))
    more = n.select(F.col("theme_id").alias("claim_id"), "question_id", F.concat(F.lit("It was raised in "), F.col("n") + 1, F.lit(" mentions.")).alias("text"))
    other = n.select(F.concat("theme_id", F.lit(":elsewhere")).alias("claim_id"), "question_id", F.concat(F.lit("It was raised in "), "n", F.lit(" Q99 mentions.")).alias("text"))
    people = n.select(F.concat("theme_id", F.lit(":people")).alias("claim_id"), "question_id", F.concat(F.lit("It was raised by "), "n", F.lit(" customers.")).alias("text"))
    stats = counting.inventory_stats(t.mentions, t.assignments)
    return reporting.quantity_issues(more.unionByName(other).unionByName(people), stats).select("entity_key", "check_name")


@query("""#t as (select doc_id, 'Q1_T' || doc_id as theme_id from documents)
select case when doc_id % 5 = 1 then 'bad' || doc_id else theme_id end as entity_key, case doc_id % 5 when 1 then 'theme_id' when 2 then 'numbers' when 3 then 'type' else 'label' end as check_name from t where doc_id % 5 <> 0
union all select 'bad' || doc_id, 'owner' from t where doc_id % 5 = 1""", alone=True)
def theme_issues(spark, sf_dir):
    """Themes with malformed ids, numbers in labels, unknown types and long labels."""
    i = F.col("doc_id")
    label = F.when(i % 5 == 2, "raised by 40% of all").when(i % 5 == 4, F.repeat(F.lit("long "), 20)).otherwise("fine")
    rows = Tables(spark, sf_dir).raw("documents").select(F.lit("Q1").alias("question_id"), F.when(i % 5 == 1, F.concat(F.lit("bad"), i)).otherwise(F.concat(F.lit("Q1_T"), i)).alias("theme_id"), label.alias("label"), F.lit("").alias("description"), F.when(i % 5 == 3, "nothing").otherwise("risk").alias("type"))
    return checks.themes(rows).select("entity_key", "check_name")


def _span_sql() -> str:
    """Spans of turns as a recursive walk: each cut is the last sentence end from the 16th to the 32nd word, else the 32nd."""
    return r"""with turns as (
  select conv_id, turn, upper(role[1]) || lower(role[2:]) as speaker, string_split_regex(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') as w from conversations where trim(text) <> ''),
ends as (select *, [i for i in range(1, len(w) + 1) if regexp_matches(w[i], '[.!?]["”’'')]*$')] as e from turns),
walk as (
  with recursive x(conv_id, turn, seq, a, b) as (
    select conv_id, turn, 0, cast(0 as bigint), cast(0 as bigint) from ends
    union all
    select x.conv_id, x.turn, seq + 1, b, case when len(w) - b <= 32 then len(w) else coalesce(list_max([i for i in e if i >= b + 16 and i <= b + 32]), b + 32) end
    from x join ends on x.conv_id = ends.conv_id and x.turn = ends.turn where b < len(w))
  select * from x where seq > 0)
select conv_id, turn as at, seq, cast(b - a as integer) as words from walk"""


@query(_span_sql(), alone=True)
def span_words(spark, sf_dir):
    """The words of each span of each turn."""
    from veritally.functions import prose

    rows = src.turns(spark, sf_dir).select("conv_id", "turn", F.concat("header", F.lit("\n"), "text").alias("text"))
    return rows.select("conv_id", F.col("turn").alias("at"), F.explode(prose.column("spans")("text")).alias("s")).select("conv_id", "at", "s.seq", "s.words")


@query(r"""
select 'c' || doc_id as conv, case doc_id % 4 when 0 then 'no speaker turns' when 1 then 'a time mark that is no header' when 2 then 'a header without speaker' end as problem from documents""", alone=True)
def transcript_problems(spark, sf_dir):
    """Why transcripts can't be cut into spans."""
    from veritally.functions import prose

    i = F.col("doc_id")
    text = F.when(i % 4 == 0, "only words").when(i % 4 == 1, "00:01 - Lee\nhi\n00:02 and so\n").when(i % 4 == 2, "00:01 - (host)\nhi\n").otherwise("00:01 - Lee (host)\nhi\n")
    return Tables(spark, sf_dir).raw("documents").select(F.concat(F.lit("c"), i).alias("conv"), prose.column("span_problem")(text).alias("problem"))


SQL["fixed_audit_sample"] = (
    src.SQL
    + """, r as (select mention_id, file_id, question_id || '|' || coalesce(source_type, 'other') as cell, sha256('{"id":"' || mention_id || '","mention_sample":"bootcamp-v2"}') as tie from placed),
cells as (select file_id, list(distinct cell) as cells, sha256('{"id":"' || file_id || '","source_sample":"bootcamp-v2"}') as tie from r group by 1),
files6 as (
  with recursive x(step, chosen, covered) as (
    select 0, cast([] as varchar[]), cast([] as varchar[])
    union all
    select step + 1, list_append(chosen, b.file_id), list_distinct(list_concat(covered, b.cells)) from x,
      lateral (select arg_min(file_id, key) as file_id, arg_min(cells, key) as cells from (
        select file_id, cells, {'n': -len(list_filter(cells, lambda c: not list_contains(x.covered, c))), 't': tie} as key from cells where not list_contains(x.chosen, file_id))) b
    where step < 6 and b.file_id is not null)
  select unnest(arg_max(chosen, step)) as file_id from x),
pool as (select r.* from r join files6 f on r.file_id = f.file_id),
walk as (
  with recursive y(step, ids, cs, fs) as (
    select 0, cast([] as varchar[]), cast([] as varchar[]), cast([] as varchar[])
    union all
    select step + 1, list_append(ids, b.m.id), list_append(cs, b.m.cell), list_append(fs, b.m.f) from y,
      lateral (select arg_min({'id': mention_id, 'cell': cell, 'f': file_id}, key) as m from (
        select mention_id, cell, file_id, {'a': list_contains(y.cs, cell), 'b': list_contains(y.fs, file_id), 'c': len(list_filter(y.cs, lambda c: c = cell)), 'd': len(list_filter(y.fs, lambda f: f = file_id)), 'e': tie} as key
        from pool where not list_contains(y.ids, mention_id))) b
    where step < 20 and b.m is not null)
  select arg_max(ids, step) as ids from y),
got as (select unnest(ids) as mention_id, generate_subscripts(ids, 1) as place from walk)
select g.mention_id, file_id, cell, place from got g join r on g.mention_id = r.mention_id"""
)


def _constructed(t: Tables, *columns):
    """A row for each document with columns made from its id."""
    return t.raw("documents").select(*columns)


_tokens = lambda x: f"array_to_string(regexp_extract_all({norm(x)}, '[\\p{{L}}\\p{{N}}_]+'), ' ')"


@query(f"""#said as (select mention_id as path, 'Q' || ((k + 1) % 5 + 1) as question_id, quote, {_tokens("quote")} as w from mentions),
asked as (select distinct question_id, w from said), held as (select distinct question_id, {_tokens("quote")} as v from mentions),
hit as (select distinct a.question_id, a.w from asked a join held h on a.question_id = h.question_id where a.w <> '' and contains(' ' || v || ' ', ' ' || w || ' '))
select distinct path, quote from said s where (question_id, w) not in (select question_id, w from hit)""")
def ungrounded_quotations(spark, sf_dir):
    """Sentences quoted under the question after their own, that no sentence of that question holds."""
    m = Tables(spark, sf_dir).mentions
    after = F.concat(F.lit("Q"), (F.col("k") + 1) % 5 + 1)
    fields = m.select(F.col("mention_id").alias("path"), after.alias("question_id"), F.concat(F.lit("One said «"), "quote", F.lit("» twice")).alias("text"))
    return reporting.ungrounded_quotations(fields, m)


_plainly = lambda x: squeeze(f"replace(translate({x}, '‘’“”–—', {STRAIGHT}), '…', '...')")
_set = "unnest(list_distinct(regexp_extract_all(t, '[^\\s\\p{Z}]+'))) as w"


@query(f"""#asked as (select conv_id * 1000 + turn as quote_id, {_plainly("text")} as t from conversations),
known as (select {_plainly("quote")} as t, min(mention_id) as entry_id from mentions group by 1),
q as (select distinct t from asked where t <> '' and t not in (select t from known)), r as (select * from known where t <> ''),
qw as (select t, {_set} from q), rw as (select t, {_set} from r),
qn as (select t, count(*) as n from qw group by 1), rn as (select t, count(*) as n from rw group by 1),
shared as (select a.t, b.t as u, count(*) as c from qw a join rw b on a.w = b.w group by all),
inside as (select q.t, r.t as u, least(length(q.t), length(r.t)) as overlap from q, r where contains(q.t, r.t) or contains(r.t, q.t)),
found as (select t, u, 'inclusion' as match, overlap from inside
  union all select s.t, u, 'words', c from shared s join qn on s.t = qn.t join rn on s.u = rn.t where c * 10 >= least(qn.n, rn.n) * 6 and (s.t, u) not in (select t, u from inside)),
best as (select t, arg_min({{'entry_id': entry_id, 'match': match, 'overlap': overlap}}, (-overlap, entry_id)) as m from found f join r on f.u = r.t group by f.t)
select quote_id, entry_id, 'equal' as match, len(list_distinct(regexp_extract_all(a.t, '[^\\s\\p{{Z}}]+')))::int as overlap from asked a join known k on a.t = k.t
union all select quote_id, m.entry_id, m.match, m.overlap::int from asked a join best b on a.t = b.t""".replace("select t, arg_min", "select f.t, arg_min"))
def best_matches(spark, sf_dir):
    """The sentence of the documents that each turn of a conversation is most like."""
    t = Tables(spark, sf_dir)
    turns = t.raw("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("quote_id"), "text")
    with unsent(spark):
        return cut(grounding.best_matches(turns, t.mentions.select(F.col("mention_id").alias("entry_id"), F.col("quote").alias("text"))))


@query(rf"""#c as (select mention_id, list_distinct(regexp_extract_all(quote, '\d+(?:\.\d+)?')) as n, {_terms} as t from mentions where notable_quote),
s as (select distinct question_id, list_distinct(regexp_extract_all(quote, '\d+(?:\.\d+)?')) as n, {_terms} as u from mentions where not notable_quote),
hits as (select distinct c.mention_id, s.question_id from (select mention_id, t, unnest(n) as x from c) c join (select question_id, u, unnest(n) as x from s) s on c.x = s.x where len(list_intersect(t, u)) >= 2),
q as (select mention_id, string_agg(question_id, ',' order by question_id) as questions, count(*) as n from hits group by 1)
select c.mention_id as entity_key, case when q.n is null then 'untraced_claim' else 'cross_question_unverified' end as check_name, case when q.n is null then 'error' else 'warning' end as severity, coalesce(questions, '') as questions
from c left join q on c.mention_id = q.mention_id where len(c.n) > 0 and (q.n is null or q.n > 1)""")
def crossref_issues(spark, sf_dir):
    """Notable sentences with a number: those that no other sentence bears out, and those that sentences of several questions do."""
    m = Tables(spark, sf_dir).mentions
    return grounding.crossref_issues(m.where("notable_quote").select(F.col("mention_id").alias("claim_id"), F.col("quote").alias("text")), m.where("not notable_quote").select("question_id", F.col("quote").alias("text")))


@query("""
select 'p' || doc_id as entity_key, case doc_id % 3 when 1 then 'error' else 'warning' end as severity from documents where doc_id % 3 <> 0""", alone=True)
def attribution_issues(spark, sf_dir):
    """Quotations given to another speaker than the registry does, or that it doesn't have."""
    i = F.col("doc_id")
    t = Tables(spark, sf_dir)
    own = F.concat_ws(" ", *[F.concat(F.lit(p), i) for p in ("alpha", "beta", "gamma", "delta")])
    said = F.when(i % 3 == 2, F.concat(F.lit("nothing"), i, F.lit(" like it"))).otherwise(own)
    fields = _constructed(t, F.concat(F.lit("p"), i).alias("path"), F.concat(F.lit("So “"), said, F.lit("” — "), F.when(i % 3 == 1, "Dana Fox").otherwise("Kim Lee")).alias("text"))
    registry = _constructed(t, i.alias("entry_id"), own.alias("text"), F.lit("Kim Lee, VP (ops)").alias("attribution"))
    return reporting.attribution_issues(fields, registry).select("entity_key", "severity")


@query("""
select mention_id, 'zed qux' || doc_id as piece from mentions where k % 2 = 1""")
def attribution_errors(spark, sf_dir):
    """Names of speakers that don't stand in their source."""
    t = Tables(spark, sf_dir)
    m = t.mentions.withColumn("quote_attribution", F.when(F.col("k") % 2 == 1, F.concat(F.lit("Zed Qux"), "doc_id", F.lit(", Customer"))).otherwise("Anonymous Customer"))
    return grounding.attribution_errors(m, t.raw("documents").select(F.expr(NAME).alias("file_id"), "text"), ["sales call"])


@query("""
select 'c' || doc_id as entity_key, 'ratio' as check_name from documents where doc_id % 4 in (1, 3) union all select 'c' || doc_id, 'breadth' from documents where doc_id % 4 in (2, 3)""", alone=True)
def prose_quantities(spark, sf_dir):
    """Prose that should state neither shares nor breadth."""
    i = F.col("doc_id")
    text = F.when(i % 4 == 0, "it was said").when(i % 4 == 1, F.concat(F.lit("it was "), i, F.lit(" of 20"))).when(i % 4 == 2, "Most agreed").otherwise("nobody, so 0 percent")
    return checks.quantities(_constructed(Tables(spark, sf_dir), F.concat(F.lit("c"), i).alias("id"), text.alias("text"))).select("entity_key", "check_name")


@query(f"""
select file_id, coalesce((map {{{", ".join(f"'{k}': '{v}'" for k, v in fx.DESCRIPTORS.items())}}})[source_type], 'source: ' || file_id) as descriptor from files""")
def source_descriptors(spark, sf_dir):
    """What quotes of each file without a speaker are said to come from."""
    return Tables(spark, sf_dir).files.select("file_id", fx.source_descriptor(F.col("source_type"), F.col("file_id")).alias("descriptor"))


_states = "(?i)[0-9]+\\s*(?:%|percent|/|of\\s+[0-9])|\\b[0-9]+\\s+(?:mentions?|sources?|customers?|calls?)\\b|" + fx.BREADTH
_CLEANED = f"""units as (select doc_id, unnest(parts) as unit, generate_subscripts(parts, 1) as i
  from (select doc_id, string_split(replace(regexp_replace(replace(coalesce(text, ''), '"', ''), '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(10), chr(1)), chr(1)) as parts from documents)),
judged as (select *, regexp_matches(unit, '{_states}') as bad from units),
whole as (select doc_id, coalesce(string_agg(unit, ' ' order by i) filter (not bad), '') as body, count(*) filter (bad) as n from judged group by 1)"""


@query(f"#{_CLEANED} select doc_id, sha256(body) as body from whole where trim(body) <> '' and not regexp_matches(body, '{_states}')", alone=True)
def cleaned_documents(spark, sf_dir):
    """Whole texts without the units that state counts, shares or breadth; those of which nothing usable is left are none."""
    docs = Tables(spark, sf_dir).raw("documents").select("doc_id", F.col("text").alias("body"))
    return reporting.kept_items(reporting.cleaned_items(docs, ["doc_id"], ["body"])).withColumn("body", F.sha2("body", 256))


@query(f"#{_CLEANED} select doc_id, 'body' as field, unit from judged where bad union all select doc_id, 'item', null from whole where trim(body) = '' or regexp_matches(body, '{_states}')", alone=True)
def dropped_units(spark, sf_dir):
    """What cleaning takes out of whole texts, and the texts of which nothing usable is left."""
    docs = Tables(spark, sf_dir).raw("documents").select("doc_id", F.col("text").alias("body"))
    return reporting.dropped_units(reporting.cleaned_items(docs, ["doc_id"], ["body"]), ["doc_id"])


@query("""
select doc_id, 'Doc ' || doc_id || ' is kept. It ends.' as kept, 'About 40% said so.|Most agree;' as dropped from documents""", alone=True)
def cleaned_prose(spark, sf_dir):
    """Prose without the units that state counts, shares or breadth."""
    i = F.col("doc_id")
    text = F.concat(F.lit('Doc "'), i, F.lit('" is kept. About 40% said so. Most agree;\nIt ends.'))
    rows = Tables(spark, sf_dir).raw("documents").select("doc_id", fx.clean_prose(text).alias("c"))
    return rows.select("doc_id", "c.kept", F.array_join("c.dropped", "|").alias("dropped"))


@query("""
select 'm' || doc_id as entity_key, (['title', 'headings', 'tables', 'tags'])[doc_id % 5] as check_name from documents where doc_id % 5 <> 0""", alone=True)
def markdown_issues(spark, sf_dir):
    """Reports in Markdown without title or headings, with a row that isn't closed, or with tags."""
    i = F.col("doc_id")
    text = F.when(i % 5 == 1, "no title\n## H\nx\n").when(i % 5 == 2, "# T\nx\n").when(i % 5 == 3, "# T\n## H\n| a | b\n").when(i % 5 == 4, "# T\n## H\n<div>x</div>\n").otherwise("# T\n## H\n| a | b |\nx\n")
    return checks.markdown(_constructed(Tables(spark, sf_dir), F.concat(F.lit("m"), i).alias("id"), text.alias("text"))).select("entity_key", "check_name")


@query("""
select 'c' || doc_id as conv, doc_id % 3 = 0 as literal_verified, case when doc_id % 3 = 0 then 38 else -1 end as start, case when doc_id % 3 = 0 then 'Lee' end as speaker from documents""", alone=True)
def quote_contexts(spark, sf_dir):
    """Where quotes stand in their source, if exactly once: offsets and the speaker of the turn."""
    i = F.col("doc_id")
    from veritally.functions import prose

    source = F.lit("00:01 - Morgan\nWell.\n00:02 - Lee (vp)\nIt was “so”  slow. We left. We left.\n")
    quote = F.when(i % 3 == 0, 'it was "so" slow').when(i % 3 == 1, "We left.").otherwise("never said")
    rows = _constructed(Tables(spark, sf_dir), F.concat(F.lit("c"), i).alias("conv"), prose.context_column()(source, quote).alias("c"))
    return rows.select("conv", "c.literal_verified", F.coalesce("c.start", F.lit(-1)).alias("start"), "c.speaker")


@query(r"""
select mention_id, sha256('{"file_id":"' || file_id || '","mention":"' || mention || '","quote":"' || replace(replace(replace(replace(replace(quote, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '","sentiment":null}') as digest from mentions""")
def canonical_digests(spark, sf_dir):
    """Digests of mentions as JSON objects: keys sorted, compact, letters as they are, nulls kept."""
    m = Tables(spark, sf_dir).mentions
    return m.select("mention_id", canonical_digest(quote=F.col("quote"), file_id=F.col("file_id"), sentiment=F.lit(None).cast("string"), mention=F.col("mention")).alias("digest"))


@query("""
select file_id as entity_key, 'segment' as check_name from files where doc_id % 4 = 0 and doc_id % 7 <> 3 union all select file_id, 'missing' from files where doc_id % 7 = 3""")
def reconciliation_issues(spark, sf_dir):
    """Files without a segment, and ones with a segment that isn't defined."""
    f = Tables(spark, sf_dir).files
    segments = spark.createDataFrame([(f"seg{k}",) for k in range(1, 4)], "id string")
    assigned = f.where("doc_id % 7 <> 3").select("file_id", F.concat(F.lit("seg"), F.col("doc_id") % 4).alias("segment_id"))
    return checks.reconciliation(assigned, segments, f.select("file_id")).select("entity_key", "check_name")


@query("""#n as (select a.theme_id, case when a.theme_id like '%_T2' then 'none' else min(mention_id) end as mention_id from assignments a group by 1)
select mention_id as entity_key, 'missing' as check_name from mentions where mention_id not in (select mention_id from assignments)
union all select theme_id, 'nominee' from n where mention_id = 'none' union all select 'Q9_T1', 'no_evidence'""")
def analysis_issues(spark, sf_dir):
    """Mentions without a theme, nominees of no theme, and a theme of a question that nobody answered."""
    t = Tables(spark, sf_dir)
    themes = t.themes.unionByName(t.themes.where("theme_id = 'Q1_T1'").withColumn("question_id", F.lit("Q9")).withColumn("theme_id", F.lit("Q9_T1")))
    first = t.assignments.groupBy("theme_id").agg(F.min("mention_id").alias("mention_id"))
    nominees = first.withColumn("mention_id", F.when(F.col("theme_id").endswith("_T2"), "none").otherwise(F.col("mention_id")))
    return checks.analysis(themes, t.assignments, t.mentions, nominees).select("entity_key", "check_name")


@query("""
select mention_id, verdict from verdicts where round = 1 and verdict <> 'pass'""")
def repair_cohort(spark, sf_dir):
    return audit.repair_cohort(Tables(spark, sf_dir).verdicts)


@query("""#a as (select v.mention_id, v.verdict, r.verdict as fix from verdicts v left join (select mention_id, verdict from verdicts where round = 2) r on v.mention_id = r.mention_id where v.round = 1),
s as (select count(*) as audited, count(*) filter (verdict <> 'pass' and fix is not null) as repaired, count(*) filter (case when verdict <> 'pass' and fix is not null then fix else verdict end = 'pass') as passed from a)
select *, audited > 0 and passed * 100 >= audited * 90 as ready from s""")
def audit_gate(spark, sf_dir):
    """The audit after its one repair of what failed."""
    v = Tables(spark, sf_dir).verdicts
    return audit.finalized(v, v.where("round = 2").select("mention_id", "verdict"))


@query("""#b as (select file_id from files where doc_id % 3 <> 0 order by file_id limit 4)
select mention_id from mentions where file_id in (select file_id from b) and k % 9 <> 4""")
def batch_mentions(spark, sf_dir):
    """What a batch of four sources brings in: quotes that were changed are left out."""
    t = Tables(spark, sf_dir)
    batch = selection.next_batch(t.files.select("file_id"), t.files.where("doc_id % 3 = 0"))
    rows = t.mentions.withColumn("quote", F.when(F.col("k") % 9 == 4, F.concat(F.lit("§"), "quote")).otherwise(F.col("quote")))
    return grounding.merged_batch(rows, t.raw("documents").select(F.expr(NAME).alias("file_id"), "text"), batch).select("mention_id")


@query(f"""#m as (select *, min(mention_id) over (partition by question_id, file_id, {squeeze("quote")}) as first from mentions)
select question_id, file_id, mention_id, mention, quote from m where mention_id = first""")
def model_view(spark, sf_dir):
    return grounding.model_view(Tables(spark, sf_dir).mentions)
