"""Report checks and JSON validation on hand-made rows."""

import pytest

from veritally.functions import jsonschema
from veritally.operators import checks, rendering, reporting, sections


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def names(df):
    return {(r["entity_key"], r["check_name"]) for r in df.collect()}


def test_json_schema(spark):
    schema = {
        "type": "object", "required": ["id"], "additionalProperties": False,
        "properties": {
            "id": {"type": "string", "pattern": r"^Q\d+$"}, "n": {"type": "integer", "minimum": 1}, "kind": {"enum": ["a", 1]}, "tags": {"type": "array", "items": {"type": "string"}, "uniqueItems": True, "maxItems": 2},
            "maybe": {"type": ["string", "null"]}, "either": {"oneOf": [{"type": "string"}, {"type": "object", "required": ["t"]}]},
        },
    }
    fine = {"id": "Q1", "n": 2.0, "kind": 1, "tags": ["x", "y"], "maybe": None, "either": {"t": 1}}
    assert jsonschema.errors(fine, schema) == []
    bad = {"n": True, "kind": True, "tags": ["x", "x", 3], "more": 1, "either": 3, "id": "X"}
    said = jsonschema.errors(bad, schema)
    assert said == sorted(said) and {s.split(":")[0] for s in said} == {"$.n", "$.kind", "$.tags", "$.tags[2]", "$.more", "$.either", "$.id"}
    assert jsonschema.errors({}, schema) == ["$: lacks id"] and jsonschema.errors([], schema) == ["$: not object"]
    assert jsonschema.excluded_rule({"files": [{"excluded": True}, {"excluded": True, "exclusion_reason": "x"}, {}]}) == ["$.files[0]: excluded without a reason"]
    rows = frame(spark, [('{"id":"Q1"}',), ("{",), (None,)], "t string")
    assert [r[0] for r in rows.select(jsonschema.column(schema)("t")).collect()] == [[], ["$: not JSON"], None]


def test_plan_files(spark):
    c = frame(spark, [("a", "x", "long " * 300), ("b", "y", "short")], "file_id string, segment string, summary string")
    got = {r["file_id"]: r for r in reporting.plan_files(c, frame(spark, [("a", "bad audio")], "file_id string, exclusion_reason string"), frame(spark, [("b", "s1")], "file_id string, segment_id string")).collect()}
    assert got["a"]["excluded"] and got["a"]["segment"] == "unknown" and len(got["a"]["summary"]) <= 1000 and got["b"]["segment"] == "s1" and not got["b"]["excluded"]


def test_prose_against_evidence(spark):
    sections = frame(spark, [("Q1", "head", 'They said "the tool is slow" and "it is so fast".', ["plain", 'again "TOOL is"']), ("Q2", None, 'We heard "the tool is slow"', None)], "question_id string, headline string, synthesis string, takeaways array<string>")
    findings = frame(spark, [("F1", "title", 'On top: "the tool is slow"')], "id string, title string, text string")
    fields = reporting.narrative_fields(sections, findings)
    assert fields.count() == 7
    mentions = frame(spark, [("Q1", "Well, the tool is  slow today")], "question_id string, quote string")
    got = {(r["path"], r["quote"]) for r in reporting.ungrounded_quotations(fields, mentions).collect()}
    assert got == {("questions.Q1.synthesis", "it is so fast"), ("questions.Q2.synthesis", "the tool is slow")}
    said = frame(spark, [("p", None, '"the tool is slow indeed" — Kim Lee, and "no one ever wrote this" — Someone')], "path string, question_id string, text string")
    registry = frame(spark, [(1, "the tool is slow indeed", "Dana Fox (buyer)")], "entry_id long, text string, attribution string")
    assert sorted(r["severity"] for r in reporting.attribution_issues(said, registry).collect()) == ["error", "warning"]


def test_numbers(spark):
    stats = frame(spark, [("Q1", "mentions", 3, 10, 30), ("Q1", "source_files", 4, 8, 50)], "scope string, unit string, numerator long, denominator long, percentage long")
    claims = frame(spark, [("a", "Q1", "3 of 10 mentions (30%)"), ("b", "Q1", "5 mentions"), ("c", "Q1", "12 customers"), ("d", "Q1", "50% of source files"), ("e", "Q2", "3 mentions"), ("f", "Q1", "two source types")], "claim_id string, question_id string, text string")
    assert names(reporting.quantity_issues(claims, stats)) == {("b", "unsupported"), ("c", "identity"), ("e", "unsupported"), ("f", "source_types")}
    counts = frame(spark, [("Q1", 3, 30, 1, 50, 1, 50, 10, 2, 2)], "question_id string, mention_count long, mention_pct long, source_type_count long, source_type_pct long, segment_count long, segment_pct long, total_mentions long, total_source_types long, total_segments long")
    known = reporting.number_registry(counts, stats, frame(spark, [("Q1", "we lost 77 seats")], "question_id string, quote string"), frame(spark, [(99,)], "source_count long"))
    assert {("Q1", "30"), ("Q1", "77"), ("global", "99")} <= {tuple(r) for r in known.collect()}
    fields = frame(spark, [("p", "Q1", "about 45% and 30%")], "path string, question_id string, text string")
    assert {r["value"] for r in reporting.stated_numbers(fields).collect()} == {"45", "30"}


def test_claims(spark):
    m = [("m1", "f1", "Q1", "x", "q", "who", "mixed"), ("m2", "f2", "Q1", "y", "r", "who", "mixed")]
    mentions = frame(spark, m, "mention_id string, file_id string, question_id string, mention string, quote string, quote_attribution string, sentiment string")
    claims = frame(spark, [("c1", "Q1", ["m1", "m2"]), ("c2", "Q1", ["m2"])], "claim_id string, question_id string, support_mention_ids array<string>")
    assert {(r[0], r[1]) for r in reporting.bindings(mentions.where("mention_id = 'm1'"), claims).collect()} == {("m1", "c1")}
    assert {r["claim_id"]: r["source_file_ids"] for r in reporting.claim_sources(claims, mentions).collect()} == {"c1": ["f1", "f2"], "c2": ["f2"]}
    s = {r["claim_id"]: r for r in reporting.claim_statistics(claims, mentions, frame(spark, [("Q1", 4)], "question_id string, total_mentions long")).collect()}
    assert s["c1"]["percentage"] == 50 and s["c1"]["stat_ref"] != s["c2"]["stat_ref"]
    seen = frame(spark, [("c1", *m[0]), ("c2", "m2", "f2", "Q1", "changed", "r", "who", "mixed")], "claim_id string, mention_id string, file_id string, question_id string, mention string, quote string, quote_attribution string, sentiment string")
    assert names(reporting.source_observations(seen, mentions)) == {("c2", "source_observation")}


def test_excerpts_and_spans(spark):
    text = "00:01 - Kim Lee\nIt was slow. It was slow.\n00:02 - Dana\nWe left early.\n"
    quotes = frame(spark, [("a", "f", "We left early.", "Dana"), ("b", "f", "It was slow.", "Kim Lee"), ("c", "f", "left early", "Kim Lee")], "mention_id string, file_id string, text string, attribution string")
    assert names(reporting.excerpts(quotes, frame(spark, [("f", text)], "file_id string, text string"))) == {("b", "excerpt"), ("c", "speaker")}
    spans = frame(spark, [("f", 0, 1, 0, 10), ("f", 0, 2, 10, 20), ("f", 1, 3, 25, 40)], "file_id string, turn long, seq long, start long, end long")
    chosen = frame(spark, [("s", 1, "f", 1), ("s", 2, "f", 2), ("t", 1, "f", 2), ("t", 2, "f", 3), ("u", 1, "f", 9)], "selection_id string, place long, file_id string, seq long")
    got = {r["selection_id"]: (r["start"], r["end"], r["consecutive"]) for r in reporting.span_selections(chosen, spans).collect()}
    assert got == {"s": (0, 20, True), "t": (10, 40, False), "u": (None, None, False)}


def test_keys_capacity_and_admission(spark):
    keys = frame(spark, [("extract:a",), ("extract:z",), ("analysis:Q1",), ("audit",), ("bake:a",)], "key string")
    assert {r["key"] for r in reporting.unknown_keys(keys, frame(spark, [("a",)], "file_id string"), frame(spark, [("Q1",)], "question_id string")).collect()} == {"extract:z", "bake:a"}
    assert [r["partition_id"] for r in reporting.over_capacity(frame(spark, [("p", "x", 6), ("p", "y", 5), ("q", "x", 9)], "partition_id string, part string, tokens long"), 10).collect()] == ["p"]
    parts = frame(spark, [("k1", "p"), ("k2", "p"), ("k3", "q"), ("k4", "q")], "component_id string, packet_id string")
    found = frame(spark, [("k1", "x", "editorial", ""), ("k3", "x", "error", "")], "entity_key string, check_name string, severity string, message string")
    assert {(r["component_id"], r["packet_ok"]) for r in reporting.admitted(parts, found).collect()} == {("k2", True), ("k4", False)}


def test_sections(spark):
    """Nulls and empty parts leave no trace; cells stay on one line; ``other`` with a large share shows all quotes."""
    flagged = frame(spark, [("Q1", "Q1_T1", "risk", 8, 80, 2, 2, 1, False), ("Q1", "Q1_T8", "other", 2, 20, 1, 2, 1, False), ("Q1", "Q1_T2", "risk", 1, 10, 1, 2, 1, True)], "question_id string, theme_id string, type string, mention_count long, mention_pct long, source_type_count long, total_source_types long, total_segments long, demoted boolean")
    picked = frame(spark, [(t, k, f"q{k}|\n" if k > 1 else None, k == 4, None if k % 2 else "Kim", "f_1") for t in ("Q1_T1", "Q1_T8", "Q1_T2") for k in range(1, 6)], "theme_id string, pick long, quote string, notable_quote boolean, quote_attribution string, file_id string")
    shown = sections.shown_quotes(picked, flagged)
    assert sorted((r["theme_id"], r["pick"]) for r in shown.collect()) == [("Q1_T1", 1), ("Q1_T1", 2), ("Q1_T1", 4)] + [("Q1_T8", k) for k in range(1, 6)]
    cells = sections.quote_cells(shown)
    assert {r["theme_id"]: r["quotes"] for r in cells.collect()}["Q1_T1"] == '"q4\\| " — Kim (f\\_1) • "q2\\| " — Kim (f\\_1)'
    labels = frame(spark, [("Q1_T1", "a*b", None), ("Q1_T8", None, "rest")], "theme_id string, label string, description string")
    segments = frame(spark, [("Q1_T1", "s")], "theme_id string, segment string")
    table = sections.theme_tables(flagged, labels, cells.where("theme_id = 'Q1_T8'"), segments).first()["table"].split("\n")
    assert table[:3] == ["| Theme | Description | Mentions | % | Sources | Key Quotes |", "| --- | --- | --- | --- | --- | --- |", "| a\\*b |  | 8 | 80% | 2/2 |   |"] and table[3].startswith("| Q1\\_T8 | rest | 2 | 20% | 1/2 | ")
    totals = frame(spark, [("Q1", 9, 1, 1, True)], "question_id string, total_mentions long, total_source_types long, total_segments long, sparse boolean")
    none = frame(spark, [], "question_id string, table string"), frame(spark, [], "question_id string, quote string, quote_attribution string")
    written = frame(spark, [("Q1", None, "", None), ("Q2", "why", None, ["x"])], "question_id string, question string, synthesis string, takeaways array<string>")
    got = sections.question_sections(totals, *none, written)
    assert {r["question_id"]: r["section"] for r in got.collect()} == {"Q1": "## Q1: \n\nn = 9 mentions\n\n> **Note:** Based on 9 mentions. Treat as directional signals, not patterns.", "Q2": "## Q2: why\n\n### Takeaways\n\n- x"}
    bare = frame(spark, [(None, None, None, None, None)], "headline string, body string, findings array<struct<text:string,notes:array<string>>>, outcomes array<struct<outcome:string,quote:string,attribution:string>>, open_questions array<string>")
    assert sections.executive_section(bare).first()["executive"] == ""
    assert sections.written_out(sections.executive_section(bare), got).count("## Q") == 2
    with pytest.raises(ValueError):
        sections.written_out(got, most=1)


def test_page(spark):
    """Every part of a page is there, and passes the checks of pages."""
    quote = {"question_id": "Q1", "theme_id": "Q1_T1", "quote": "x" * 300, "quote_attribution": "Kim & Co"}
    doc = {
        "title": "T <1>", "date": "2024-01-01", "company": "A", "banner": rendering.banner("sampled", None, "2 of 3 passed."), "notes": [{"x": "n"}],
        "executive": {"headline": "H", "body": "one\n\ntwo", "findings": [{"text": "found", "notes": ["of 3"]}], "outcomes": [{"outcome": "won"}], "open_questions": ["why?"]},
        "themes": [{"question_id": "Q1", "theme_id": "Q1_T1", "label": "slow", "mention_count": 3, "mention_pct": 30, "bar": 100}],
        "written": [{"question_id": "Q1", "question": "What?", "synthesis": "s", "takeaways": ["t"]}, {"question_id": "Q2"}],
        "quotes": [quote], "leads": [{"question_id": "Q1", "quote": "lead"}], "outliers": [{"question_id": "Q1", "quote": f"o{k}"} for k in range(7)],
    }
    page = rendering.as_html(doc)
    for part in ("T &lt;1&gt;", "Kim &amp; Co", "Sampled audit. 2 of 3", "<details><summary>" + "x" * 250 + "...", "<strong>won</strong>", "<li>found<p>of 3</p></li>", "Outliers (7)", "2 more not shown", '<section id="Q2">', "<blockquote>lead"):
        assert part in page, part
    assert checks.html(frame(spark, [(1, page)], "page_id long, html string")).collect() == []
    assert rendering.banner("full", "complete", "x") == "" and rendering.banner("full", "incomplete", "x") == "Incomplete audit. x"


def test_cleaning_has_two_outputs(spark):
    """What stays and what goes of items, from the same rows: nothing is lost between them."""
    rows = [(1, "A plain title", 'It "works". About 40% said so. It ends.'), (2, "Most agree", "Fine text"), (3, "Over 3", "of 10 calls"), (4, None, "Text"), (5, "Good", "9 of 10 said; nobody else")]
    done = reporting.cleaned_items(frame(spark, rows, "id int, title string, body string"), ["id"], ["title", "body"])
    kept = {r["id"]: (r["title"], r["body"]) for r in reporting.kept_items(done).collect()}
    gone = {(r["id"], r["field"], r["unit"]) for r in reporting.dropped_units(done, ["id"]).collect()}
    assert kept == {1: ("A plain title", "It works. It ends.")}
    assert gone == {(1, "body", "About 40% said so."), (2, "title", "Most agree"), (2, "item", None), (3, "item", None), (4, "item", None), (5, "body", "9 of 10 said;"), (5, "body", "nobody else"), (5, "item", None), (3, "body", "of 10 calls")}
    assert reporting.dropped_units(done.limit(0), ["id"]).count() == 0
