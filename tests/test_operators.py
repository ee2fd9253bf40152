"""Operators on hand-made rows: greedy choices, samples, predicates, checks, ledger and reports."""

import hashlib
import json
import math
import random
import re
from collections import Counter
from datetime import date, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritally import semantics
from veritally.functions import prose
from veritally.functions import text as fx
from veritally.operators import audit, checks, counting, grounding, ledger, rendering, selection, semantic
from veritally.sources import readers


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_percentages_are_half_even(spark):
    rows = [(a, b) for b in range(41) for a in range(b + 1)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", semantics.pct(F.col("a"), F.col("b")).alias("p")).collect()
    assert all(r["p"] == (round(r["a"] / r["b"] * 100) if r["b"] else 0) for r in got)


def test_normalized(spark):
    said = "  It’s\u00a0“fine” — \\$400K…\n\tok "
    assert one(spark, said, semantics.normalized) == "it's \"fine\" - $400k... ok"
    assert one(spark, "a\u00a0b  été", semantics.n_words) == 3
    assert one(spark, "doc_Q9_x_Q2_0", semantics.file_of) == "doc_Q9_x" and one(spark, "none", semantics.file_of) is None


@pytest.mark.parametrize(
    ("text", "low"),
    [
        ("I am the manager here and so", True), ("I am the manager.", False), ("I'm a sales director at a firm", True), ("Good question, let me think", True),
        ("Good question, we lost 40 seats", False), ("short", False), ("I am not the manager of this", False), ("I am pretty sure the manager left", False), ("nothing of note was said today", False),
    ],
)
def test_low_signal(spark, text, low):
    assert one(spark, text, fx.is_low_signal) is low


def test_quote_predicates(spark):
    assert one(spark, "WL-021,2025-08-02,open", fx.is_csv_row) and one(spark, "a, b, 42, d", fx.is_csv_row)
    assert not one(spark, "CRM, ERP, GDPR, and so on", fx.is_csv_row) and not one(spark, None, fx.is_csv_row)
    assert one(spark, "so **bold** it is", fx.has_markdown) and not one(spark, "so *thin* it is", fx.has_markdown)
    assert one(spark, "four words are few", fx.is_disqualified) and one(spark, "at 00:01:02 they said all of it", fx.is_disqualified)
    assert one(spark, "a b c", lambda t: fx.deletion_only(F.lit("a c"), t)) and not one(spark, "a b c", lambda t: fx.deletion_only(F.lit("c a"), t))
    assert one(spark, "the reporting is slow", lambda t: fx.off_topic(t, F.array(F.lit("report")))) is False
    assert one(spark, "the weather is slow", lambda t: fx.off_topic(t, F.array(F.lit("report")))) is True
    assert one(spark, "word " * 50, lambda t: F.char_length(fx.truncated(t, 150))) <= 150
    assert one(spark, "Kept well. About 40% said so. Most agree. Done.", lambda t: fx.clean_prose(t)["kept"]) == "Kept well. Done."
    assert one(spark, "$1,200 and 35% of 3k", fx.numerals) == ["$1200", "35%", "3k"]
    assert one(spark, "Kim Lee, VP (ops)", fx.attribution_key) == "kim lee"
    assert one(spark, "01_big_deal", fx.humanized) == "Big Deal" and one(spark, "<a & 'b'>", fx.html_escaped) == "&lt;a &amp; &#x27;b&#x27;&gt;"


def greedy(rows, key, seen, source, take, cap):
    rows = sorted(rows, key=key)
    most = take if len({source(r) for r in rows}) <= 1 else cap
    out, texts, n = [], set(), Counter()
    for r in rows:
        if len(out) == take:
            break
        if seen(r) not in texts and n[source(r)] < most:
            out.append(r)
            texts.add(seen(r))
            n[source(r)] += 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_greedy_selection(spark, seed):
    rng = random.Random(seed)
    texts = [f"said this thing number {k} with words " + "more " * rng.choice([0, 2, 12]) for k in range(rng.choice([3, 8, 40]))]
    files = rng.choice([1, 2, 6])
    rows = [(t, f"f{rng.randrange(files)}_Q1_{i}", rng.choice(texts), rng.random() < 0.3) for t in ("Q1_T1", "Q1_T2") for i in range(60)]
    rows = [(t, m.replace("_Q1_", f"_Q1_{t[-1]}"), m.split("_")[0], q, b) for t, m, q, b in rows]
    mentions = spark.createDataFrame([(m, f, "Q1", q, b) for _, m, f, q, b in rows], "mention_id string, file_id string, question_id string, quote string, notable_quote boolean")
    assigned = spark.createDataFrame([("Q1", m, t) for t, m, *_ in rows], "question_id string, mention_id string, theme_id string")
    themes = spark.createDataFrame([("Q1_T1", "thing", ""), ("Q1_T2", "absent", "")], "theme_id string, include string, description string")
    got = {}
    for r in selection.select_quotes(mentions, assigned, themes).orderBy("theme_id", "pick").collect():
        got.setdefault(r["theme_id"], []).append(r["mention_id"])
    n = lambda r: len(r[3].split())
    for t in ("Q1_T1", "Q1_T2"):
        mine = [r for r in rows if r[0] == t]
        key = lambda r: (n(r) < 5, False, not r[4], 0, not 15 <= n(r) <= 80, r[1])
        assert got[t] == [r[1] for r in greedy(mine, key, lambda r: " ".join(r[3].split()), lambda r: r[2], 5, 3)]
    picked = {}
    for r in selection.quote_candidates(mentions, assigned).orderBy("theme_id", "pick").collect():
        picked.setdefault(r["theme_id"], []).append(r["mention_id"])
    for t in ("Q1_T1", "Q1_T2"):
        mine = [r for r in rows if r[0] == t]
        key = lambda r: (not r[4], not 15 <= n(r) <= 80, r[1])
        assert picked[t] == [r[1] for r in greedy(mine, key, lambda r: " ".join(r[3].split()), lambda r: r[2], 3, 2)]


def test_spread_takes_turns(spark):
    rows = [(f"m{i}", f"f{i % 3 if i < 20 else 0}", i % 4 == 0) for i in range(40)]
    got = [r["mention_id"] for r in selection.spread_sample(spark.createDataFrame([("g", *r) for r in rows], "g string, mention_id string, file_id string, notable_quote boolean"), ["g"], 40).orderBy("place").collect()]
    key = lambda r: (not r[2], hashlib.sha256(r[0].encode()).hexdigest())
    queues = {}
    for r in sorted(rows, key=key):
        queues.setdefault(r[1], []).append(r)
    want = [r[0] for k in range(40) for r in sorted((q[k] for q in queues.values() if k < len(q)), key=key)]
    assert got == want


def plain_quotas(sizes, fraction):
    total = sum(sizes.values())
    budget = math.ceil(total * fraction)
    order = sorted(sizes, key=lambda s: (-sizes[s], s))
    q = {s: min(sizes[s], max(1, math.floor(sizes[s] / total * budget))) for s in order}
    while sum(q.values()) > budget:
        q[max(order, key=lambda s: (q[s], -order.index(s)))] -= 1
    while sum(q.values()) < budget and any(q[s] < sizes[s] for s in order):
        for s in order:
            if q[s] < sizes[s] and sum(q.values()) < budget:
                q[s] += 1
    return q


@pytest.mark.parametrize("sizes", [{"a": 50, "b": 3, "c": 1}, {"a": 1, "b": 1, "c": 1, "d": 1}, {"a": 40, "b": 40, "c": 39}, {"a": 7}])
@pytest.mark.parametrize("fraction", [0.25, 0.5, 1.0])
def test_quotas(spark, sizes, fraction):
    rows = [(s, f"{s}{i}") for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "s string, id string")
    assert {r["s"]: r["quota"] for r in selection.strata_quotas(df, "s", fraction).collect()} == plain_quotas(sizes, fraction)
    drawn = Counter(r["s"] for r in selection.stratified_sample(df, "s", "id", fraction).collect())
    assert drawn == Counter({s: n for s, n in plain_quotas(sizes, fraction).items() if n})


def test_fixed_audit_sample(spark):
    rng = random.Random(5)
    rows = [(f"f{i % 11}_Q{q}_{i}", f"f{i % 11}", f"Q{q}", f"t{i % 11 % 4}") for i in range(70) for q in [rng.randrange(1, 5)]]
    tie = lambda kind, x: hashlib.sha256(json.dumps({f"{kind}_sample": "bootcamp-v2", "id": x}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    cells, chosen, covered = {}, [], set()
    for _, f, q, t in rows:
        cells.setdefault(f, set()).add((q, t))
    while len(chosen) < 6:
        f = min((f for f in cells if f not in chosen), key=lambda f: (-len(cells[f] - covered), tie("source", f)))
        chosen.append(f)
        covered |= cells[f]
    pool, nc, nf, want = [r for r in rows if r[1] in chosen], Counter(), Counter(), []
    while pool and len(want) < 20:
        r = min(pool, key=lambda r: (nc[r[2:]] > 0, nf[r[1]] > 0, nc[r[2:]], nf[r[1]], tie("mention", r[0])))
        pool.remove(r)
        want.append(r[0])
        nc[r[2:]] += 1
        nf[r[1]] += 1
    df = spark.createDataFrame(rows, "mention_id string, file_id string, question_id string, source_type string")
    assert [r["mention_id"] for r in selection.fixed_audit_sample(df).orderBy("place").collect()] == want


def test_audit_bars(spark):
    def ready(passed, total):
        rows = [(f"m{i}", 1, i, "pass" if i < passed else "fail") for i in range(total)]
        return audit.summary(spark.createDataFrame(rows, "mention_id string, round int, line long, verdict string")).first()["ready"]

    assert ready(9, 10) and not ready(17, 20) and not ready(0, 0)
    two = spark.createDataFrame([("m", 1, 1, "fail"), ("m", 1, 2, "pass")], "mention_id string, round int, line long, verdict string")
    assert audit.latest(two).first()["verdict"] == "pass"
    assert audit.severity(two).first()["severity"] == "flag_orchestrator"
    fixed = audit.with_repairs(two.where("line = 1").select("mention_id", "verdict"), spark.createDataFrame([("m", "pass")], "mention_id string, verdict string"))
    assert tuple(fixed.first()) == ("m", "pass", True)


def test_counting_of_unknown_and_undefined(spark):
    mentions = spark.createDataFrame([("f1_Q1_0", "f1", "Q1"), ("f2_Q1_0", "f2", "Q1")], "mention_id string, file_id string, question_id string")
    assigned = spark.createDataFrame([("Q1", "f1_Q1_0", "Q1_T1"), ("Q1", "ghost_Q1_0", "Q1_T1"), ("Q1", "f2_Q1_0", "Q1_T9")], "question_id string, mention_id string, theme_id string")
    themes = spark.createDataFrame([("Q1", "Q1_T1", "risk"), ("Q1", "Q1_T2", "praise")], "question_id string, theme_id string, type string")
    files = spark.createDataFrame([("f1", "review", "seg1", "bad", False), ("f2", "review", "seg2", "good", True)], "file_id string, source_type string, segment string, quality string, excluded boolean")
    got = {r["theme_id"]: (r["type"], r["mention_count"], r["source_type_count"], r["total_mentions"]) for r in counting.theme_counts(mentions, assigned, themes, files).collect()}
    assert got == {"Q1_T1": ("risk", 2, 1, 3), "Q1_T2": ("praise", 0, 0, 3), "Q1_T9": ("other", 1, 1, 3)}
    totals = counting.question_totals(mentions, assigned, files).first()
    assert totals["total_source_types"] == 2 and totals["sparse"]


@pytest.mark.parametrize(("total", "small", "demoted"), [(9, 1, False), (10, 1, True), (200, 6, False), (200, 5, True)])
def test_demotion_floor(spark, total, small, demoted):
    rows = [("Q1", "a", total, total), ("Q1", "b", total, total), ("Q1", "c", small, total)]
    got = counting.demoted(spark.createDataFrame(rows, "question_id string, theme_id string, mention_count long, total_mentions long")).where("theme_id = 'c'").first()
    assert got["demoted"] is demoted


def test_grounding(spark):
    sources = spark.createDataFrame([(1, "The quick brown  fox jumps over the lazy dog today"), (2, "nothing of it"), (3, "unquicken")], "source_id long, text string")
    quotes = spark.createDataFrame([(10, "quick brown fox jumps over the lazy"), (11, "UICK brown fox jumps over the laz"), (12, "brown fox jumps"), (13, "quick"), (14, "fox sleeps over the lazy dog"), (15, "of it"), (16, "")], "quote_id long, text string")
    got = sorted((r["quote_id"], r["source_id"]) for r in grounding.find_quotes(quotes, sources).collect())
    assert got == [(10, 1), (11, 1), (12, 1), (13, 1), (13, 3), (15, 2)]


def test_best_match_and_tracing(spark):
    q = spark.createDataFrame([(1, "we love the reporting tools"), (2, "love the reporting"), (3, "reporting tools matter much more")], "quote_id long, text string")
    r = spark.createDataFrame([(7, "We love the  reporting tools"), (8, "reporting tools matter")], "entry_id long, text string")
    got = {x["quote_id"]: (x["entry_id"], x["match"]) for x in grounding.best_matches(q, r).collect()}
    assert got == {1: (7, "equal"), 2: (7, "inclusion"), 3: (8, "inclusion")}
    c = spark.createDataFrame([(1, "churn hit 40 accounts in spring"), (2, "churn hit 41 accounts"), (3, "no figures")], "claim_id long, text string")
    s = spark.createDataFrame([(1, "in spring churn reached 40")], "statement_id long, text string")
    assert {x["claim_id"]: x["traced"] for x in grounding.trace_claims(c, s).collect()} == {1: True, 2: False, 3: True}
    found = spark.createDataFrame([("Q1", "12"), ("Q1", "99"), ("Q2", "7")], "scope string, value string")
    known = spark.createDataFrame([("Q1", "12"), ("global", "7")], "scope string, value string")
    assert [tuple(x) for x in grounding.unverified_numbers(found, known).select("scope", "value").collect()] == [("Q1", "99")]


def test_attribution(spark):
    m = spark.createDataFrame([("a", "f", "Dana Fox, Customer"), ("b", "f", "Dan")], "mention_id string, file_id string, quote_attribution string")
    s = spark.createDataFrame([("f", "said Dana Fox. And so")], "file_id string, text string")
    assert [tuple(r) for r in grounding.attribution_errors(m, s, ["sales call"]).collect()] == [("b", "dan")]


def test_mention_checks(spark):
    row = lambda i, **k: {"mention_id": f"f_Q1_{i}", "file_id": "f", "question_id": "Q1", "mention": f"point {i}", "quote": f"this is a quote with enough words {i}", "quote_attribution": "x", "sentiment": "positive", "notable_quote": False} | k
    rows = [row(0), row(1, mention="point 0"), row(2, sentiment="sad"), row(3, quote="few words"), row(4, quote="x " * 101), row(5, question_id="Q9", mention_id="f_Q9_5"), row(6, quote_attribution=" "), row(7, mention="same text as it is", quote="same text as it is"), row(0, mention="point zero")]
    df = spark.createDataFrame(rows, "mention_id string, file_id string, question_id string, mention string, quote string, quote_attribution string, sentiment string, notable_quote boolean")
    got = Counter(r["check_name"] for r in checks.mentions(df, spark.createDataFrame([("Q1",)], "question_id string"), spark.createDataFrame([("f", 1)], "file_id string, interaction_count int")).collect())
    assert got == Counter(mention_unique=1, sentiment=1, quote_short=2, quote_long=1, question=1, attribution=1, quote_is_mention=1, id_unique=1, mention_cap=1)


def test_other_checks(spark):
    prose_rows = spark.createDataFrame([(1, "a dominant theme at 12% of calls"), (2, "a dominant theme at 45%"), (3, "rare at 2%")], "id long, text string")
    assert [(r["entity_key"], r["check_name"]) for r in checks.adjectives(prose_rows).collect()] == [("1", "adjective_dominant")]
    assert {(r["entity_key"], r["check_name"]) for r in checks.quantities(spark.createDataFrame([(1, "Most said 3 of 10"), (2, "It was said")], "id long, text string")).collect()} == {("1", "ratio"), ("1", "breadth")}
    page = rendering.as_html({"title": "T", "date": "2024-01-01", "themes": [{"question_id": "Q1", "theme_id": "Q1_T1", "mention_count": 3, "mention_pct": 30, "bar": 100}], "quotes": [{"question_id": "Q1", "quote": "a < b"}], "notes": [{"x": "n"}]})
    assert checks.html(spark.createDataFrame([(1, page)], "page_id long, html string")).collect() == []
    themes = spark.createDataFrame([("Q1", "bad", "x", "", "risk"), ("Q1", "Q1_T4", "y", "", "risk")], "question_id string, theme_id string, label string, description string, type string")
    assert {r["theme_id"] for r in checks.numbered_themes(themes).collect()} == {"Q1_T4", "Q1_T5"}
    claims = spark.createDataFrame([("c1", ["m1"]), ("c2", ["m2"])], "claim_id string, support_mention_ids array<string>")
    picks = spark.createDataFrame([("s1", ["c1", "c2"]), ("s2", ["c2"])], "selection_id string, claim_ids array<string>")
    assert {r["entity_key"] for r in checks.closure(spark.createDataFrame([("m1",)], "mention_id string"), claims, picks).collect()} == {"c1", "s1"}
    ranked = spark.createDataFrame([("Q1", "Q1_T1", 1, False)], "question_id string, theme_id string, rank long, strict boolean")
    said = spark.createDataFrame([("c", "Q1", "Q1_T1", "the most common complaint")], "claim_id string, question_id string, theme_id string, text string")
    assert checks.ordinal_claims(said, ranked).count() == 1
    md = rendering.as_markdown({"title": "T", "date": date(2024, 1, 1).isoformat(), "themes": [], "quotes": [], "notes": []})
    assert checks.markdown(spark.createDataFrame([(1, md)], "id long, text string")).collect() == []


def test_ledger_caps(spark):
    def end(events, key="extract:a"):
        rows = [(key, e, datetime(2024, 1, 1, 0, i), i, None) for i, e in enumerate(events.split())]
        r = ledger.replay(spark.createDataFrame(rows, "key string, event string, ts timestamp, event_id long, value double")).first()
        return r["attempts"], r["status"], r["refused"]

    assert end("claim fail claim fail claim") == (2, "failed", 1)
    assert end("finish fail finish claim claim finish claim") == (1, "complete", 2)
    assert end("claim fail claim", "audit-repair:x") == (1, "failed", 1) and end("claim fail claim fail claim finish", "other:x") == (3, "complete", 0)
    subs = spark.createDataFrame([("k", "a", 1), ("k", "a", 2), ("k", "b", 3), ("k", "c", 4), ("k", "d", 5)], "key string, sha256 string, arrived long")
    assert sorted(r["sha256"] for r in ledger.accepted(subs).where("accepted").collect()) == ["a", "b", "c"]


def test_ledger_stream(spark, tmp_path):
    from veritally.streaming import ledger as stream
    from tests.conftest import SMALL
    from veritally.sources import adapters

    rows = adapters.ledger(spark, SMALL).where("event in ('claim', 'finish', 'fail')")
    for k in range(2):
        rows.where("event_id < 500" if k == 0 else "event_id >= 500").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    order = rows.selectExpr("min(ts)", "max(ts)").first()
    assert order[0] is not None
    out = tmp_path / "out"
    q = (
        stream.replay(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in" / "*")))
        .writeStream.foreachBatch(lambda df, i: df.write.mode("append").parquet(str(out)))
        .outputMode("update")
        .option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    got = {r["key"]: (r["attempts"], r["status"], r["claims"]) for r in spark.read.parquet(str(out)).collect()}
    want = {r["key"]: (r["attempts"], r["status"], r["claims"]) for r in ledger.replay(rows).collect()}
    assert got == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("3 of 10 mentions (30%)", [("ratio", 3, "mentions", 10, 30)]), ("open 24/7", []), ("one hundred and five sources", [("count", 105, "source_files", None, None)]),
        ("12.5% of sources", [("percentage", 12.5, "source_files", None, None)]), ("\"40 users\" said so", []), ("twenty-three customers and both users", [("count", 23, "unverified_identity", None, None), ("count", 2, "unverified_identity", None, None)]),
    ],
)
def test_quantities(text, want):
    assert [(x["kind"], x["number"], x["unit"], x["denominator"], x["percentage"]) for x in prose.quantities(text)] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("5 mentions in Q2", [("count", 5, [])]), ("5 Q2 mentions and 3 of the 9 Q1 sources", [("count", 5, ["Q2"]), ("ratio", 3, ["Q1"])]),
        ("thirty percent of the 12 distinct Q3 sources", [("percentage", 30, ["Q3"])]), ("twenty-one source types", [("count", 21, [])]), ("two hundred and five mentions", [("count", 205, [])]),
        ("v2 mentions, 1.5 mentions", [("count", 1.5, [])]), ("5 \u201cnew\u201d mentions", [("count", 5, [])]), ("20-30 users", []), ("bothersome users", []),
    ],
)
def test_quantities_by_hand(text, want):
    assert [(x["kind"], x["number"], x["question_scopes"]) for x in prose.quantities(text)] == want


def test_span_problems():
    assert prose.span_problem("no headers") == "no speaker turns" and prose.span_problem("00:01 - A\nx\n00:02 odd\n") == "a time mark that is no header"
    assert prose.span_problem("00:01 - (host)\nx") == "a header without speaker" and prose.span_problem("00:01 - A\nx") is None
    with pytest.raises(ValueError):
        prose.spans("nothing", strict=True)
    words = [f"w{i}" + ("." if i in (4, 20, 40) else "") for i in range(60)]
    assert [x["words"] for x in prose.spans("00:01 - A\n" + " ".join(words))] == [21, 20, 19]


def test_json_equality():
    from veritally.functions import jsonschema

    f = jsonschema.form
    assert f(1) == f(1.0) and f(True) != f(1) and f([1, {"a": None}]) == f([1.0, {"a": None}]) and f({"a": 1, "b": 2}) == f({"b": 2, "a": 1}) and f("1") != f(1)


def test_numbers_in_words():
    assert [prose.number_value(x) for x in ("seven", "ninety nine", "three hundred", "two thousand and six", "one point five", "1,200")] == [7, 99, 300, 2006, 1.5, 1200]
    assert math.isnan(prose.number_value("five six")) and math.isnan(prose.number_value("point five point"))
    assert [x["value"] for x in prose.numbers("Q12 had 45%, 14 of 50, $300, 20-30, ~99, 40 hours, 2024, 7 and 1234 rows, “88” out")] == ["45", "14", "50", "1234"]


def test_quotations():
    spans, alone = prose.quotations("she said “it’s 5' tall” and 'the customer's view' or 6\" so “open")
    assert [s[2] for s in spans] == ["it’s 5' tall", "the customer's view"] and len(alone) == 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["00:01 - Morgan (host)\n", "word ", "end. ", "\n", "1:02:03 - Lee\n"]), max_size=120))
def test_spans_cover_their_turns(parts):
    text = "".join(parts)
    got = prose.spans(text)
    heads = list(prose.HEADER.finditer(text))
    for k, h in enumerate(heads):
        end = heads[k + 1].start() if k + 1 < len(heads) else len(text)
        own = [x for x in got if x["turn"] == k]
        assert "".join(text[x["start"] : x["end"]] for x in own) == (text[h.end() : end] if own else "") and all(x["words"] <= 32 for x in own)
        assert sum(x["words"] for x in own) == len(text[h.end() : end].split())


def test_context():
    source = "00:01 - Morgan\nWell.\n00:02 - Lee (buyer)\nIt was “really”  slow — we left.\n"
    got = prose.context(source, 'It was "really" slow - we left.')
    assert got["literal_verified"] and got["speaker"] == "Lee" and source[got["start"] : got["end"]] == "It was “really”  slow — we left."
    assert not prose.context("a a", "a")["literal_verified"]


def test_registered_functions(spark):
    prose.register(spark)
    assert spark.sql("select numbers('about 45% of it') as n").first()["n"][0]["value"] == "45"


def test_readers(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"file_id":"a","mentions":[{"mention_id":"a_Q1_0"},{"mention_id":"a_Q1_0"}]}\n\n{"file_id":"b","mentions":[]}\n')
    from veritally import schemas

    rows = readers.flatten(readers.json_lines(spark, str(tmp_path / "m.jsonl"), schemas.MENTION_RECORDS))
    assert rows.count() == 2 and readers.repeated_ids(rows).first()["n"] == 2
    (tmp_path / "d.jsonl").write_text('{"category":"retry","step":"x"}\nnot json\n{"category":"skip"}\n')
    assert readers.json_lines_tolerant(spark, str(tmp_path / "d.jsonl"), schemas.DEVIATIONS, "retry").count() == 1
    (tmp_path / "themes_Q3.json").write_text('{"question_id":null,"label":"x"}')
    assert readers.json_per_question(spark, str(tmp_path / "themes_*.json"), "question_id string, label string").first()["question_id"] == "Q3"
    (tmp_path / "s.txt").write_text("héllo\nworld")
    r = readers.source_texts(spark, spark.createDataFrame([("f", str(tmp_path / "s.txt"))], "file_id string, path string")).first()
    assert r["text"] == "héllo\nworld" and r["sha256"] == hashlib.sha256("héllo\nworld".encode()).hexdigest()
    p = tmp_path / "once"
    readers.write_once(p, b"x")
    readers.write_once(p, b"x")
    with pytest.raises(FileExistsError):
        readers.write_once(p, b"y")
    with pytest.raises(ValueError):
        readers.inside(str(tmp_path), "../x")
    (tmp_path / "land").mkdir()
    (tmp_path / "land" / "a.json").write_text("{bad")
    assert readers.landing(spark, str(tmp_path / "land"), "a int").first()["sha256"] == hashlib.sha256(b"{bad").hexdigest()


def test_stand_ins(spark):
    turns = spark.createDataFrame([(1, 0, "user", "This is a sentence of words. Short one."), (1, 1, "assistant", "This one is not by a user at all.")], "conv_id long, turn long, role string, text string")
    out, issues = semantic.run(semantic.extract_mentions, turns, lambda d: checks.repeated(d, "mention_id", "id"))
    assert [r["quote"] for r in out.collect()] == ["This is a sentence of words."] and issues.count() == 0
    kinds = semantic.classify(spark.createDataFrame([("nps_2024",), ("misc",)], "file_id string")).collect()
    assert [r["source_type"] for r in kinds] == ["nps_survey", "other"]
    segs = semantic.reconcile_segments(spark.createDataFrame([("f", " Mid  Market"), ("g", "?")], "file_id string, segment string"), spark.createDataFrame([("s1", "mid market")], "id string, label string"))
    assert {r["file_id"]: r["segment_id"] for r in segs.collect()} == {"f": "s1", "g": "unknown"}


def test_digests(spark):
    got = spark.range(1).select(semantics.digest(F.lit('a"b'), F.lit(None).cast("string"), F.lit("c\\")).alias("d")).first()["d"]
    assert got == hashlib.sha256(b'["a\\"b",null,"c\\\\"]').hexdigest()
    assert re.fullmatch("quote-[0-9a-f]{24}", spark.range(1).select(semantics.anchor("quote", F.lit("x"))).first()[0])
