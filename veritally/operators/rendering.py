"""Reports from small, aggregated frames; the driver renders what operators have counted."""

from __future__ import annotations

import html
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.functions import text as fx
from veritally.semantics import pct


def theme_table(flagged: DataFrame) -> DataFrame:
    """Themes as a report shows them: none demoted, ``other`` last, the most mentioned first; widths of bars against the longest."""
    rows = flagged.where(~F.col("demoted"))
    top = rows.groupBy("question_id").agg(F.max("mention_pct").alias("_top"))
    out = rows.join(F.broadcast(top), "question_id")  # a row for each question
    return out.select("question_id", "theme_id", "type", "mention_count", "mention_pct", pct(F.col("mention_pct"), F.col("_top")).alias("bar"), (F.col("type") == "other").alias("is_other")).orderBy("question_id", "is_other", F.desc("mention_count"), "theme_id")


def methodology_lines(method: DataFrame, audit: DataFrame) -> DataFrame:
    """Sentences on sources and audit; rates are worded from whole counts."""
    both = method.crossJoin(audit)  # one row each
    share = pct(F.col("passed"), F.col("total"))
    return both.select(
        F.format_string("%d sources were analysed and %d excluded.", "source_count", "excluded_count").alias("sources"),
        F.when(F.col("total") == 0, "No mentions were audited.").otherwise(F.format_string("%d of %d audited mentions passed (%d%%).", F.col("passed"), F.col("total"), share)).alias("audit"),
    )


def document(title: str, table: DataFrame, quotes: DataFrame, notes: DataFrame, day: date | None = None, most: int = 10_000) -> dict:
    """What a report is written from, collected; the frames are a row for each theme, quote and note."""
    take = lambda df: [r.asDict() for r in df.limit(most + 1).collect()]
    parts = {"themes": take(table), "quotes": take(quotes), "notes": take(notes)}
    if any(len(x) > most for x in parts.values()):
        raise ValueError("a report is made from aggregated frames; these are larger")
    return {"title": title, "date": (day or date.today()).isoformat(), **parts}


def as_markdown(doc: dict) -> str:
    esc = lambda t: "".join("\\" + c if c in "\\`*_{}[]<>#|$" else c for c in str(t))
    out = [f"# {esc(doc['title'])}", "", f"Date: {doc['date']}", ""]
    for q in dict.fromkeys(t["question_id"] for t in doc["themes"]):
        out += [f"## {q}", "", "| Theme | Mentions | Share |", "| --- | --- | --- |"]
        out += [f"| {esc(t['theme_id'])} | {t['mention_count']} | {t['mention_pct']}% |" for t in doc["themes"] if t["question_id"] == q]
        out += ["", *(f"> {esc(x['quote'])}" for x in doc["quotes"] if x["question_id"] == q), ""]
    out += ["## Methodology", "", *(esc(v) for n in doc["notes"] for v in n.values()), ""]
    return "\n".join(out)


STYLE = (
    ":root{--primary:#234}a:focus{outline:2px solid var(--primary)}.skip-link:not(:focus){position:absolute;left:-99em}"
    ".hero .badge{border:1px solid;display:inline-block}.bar{background:var(--primary);height:.8em}.audit-banner{border:1px solid}"
)
LONG_QUOTE, OUTLIERS_SHOWN = 250, 5


def _tag(name: str, inner: str, **attributes: str) -> str:
    """An element, or nothing if it would be empty; ``inner`` is markup, attributes are text."""
    said = "".join(f' {k.rstrip("_").replace("_", "-")}="{html.escape(v)}"' for k, v in attributes.items())
    return f"<{name}{said}>{inner}</{name}>" if inner else ""


def _each(name: str, texts) -> str:
    return "".join(_tag(name, html.escape(str(t))) for t in texts if t)


def _quote(q: dict) -> str:
    """A quote as it is displayed, long ones folded, with who said it."""
    text = q.get("display_quote") or q.get("quote") or ""
    body = _tag("blockquote", html.escape(text))
    if len(text) > LONG_QUOTE:
        body = _tag("details", _tag("summary", html.escape(text[:LONG_QUOTE].rstrip() + "...")) + body)
    return body and body + _tag("cite", html.escape(q.get("quote_attribution") or q.get("file_id") or ""))


def _chart(themes: list[dict]) -> str:
    bar = lambda t: _tag("tr", _tag("th", html.escape(str(t.get("label") or t["theme_id"])), scope="row") + f'<td><div class="bar" style="width:{t["bar"]}%"></div>{t["mention_pct"]}%</td>')
    return _tag("div", _tag("table", "".join(map(bar, themes))), class_="chart-container", role="img", aria_label="Share of mentions by theme")


def _details(themes: list[dict], quotes: list[dict]) -> str:
    """A row for each theme with its counts and the quotes that it shows."""
    rows = ""
    for t in themes:
        said = "".join(_quote(q) for q in quotes if q.get("theme_id") == t["theme_id"])
        rows += f"<tr><td>{html.escape(str(t.get('label') or t['theme_id']))}</td><td>{html.escape(str(t.get('description') or ''))}</td><td>{t['mention_count']}</td><td>{t['mention_pct']}%</td><td>{said}</td></tr>"
    return _tag("table", rows and "<tr><th>Theme</th><th>Description</th><th>Mentions</th><th>Share</th><th>Quotes</th></tr>" + rows)


def _outliers(rows: list[dict]) -> str:
    more = len(rows) - OUTLIERS_SHOWN
    inner = "".join(_quote(q) for q in rows[:OUTLIERS_SHOWN]) + (f"<p>{more} more not shown</p>" if more > 0 else "")
    return _tag("details", inner and _tag("summary", f"Outliers ({len(rows)})") + inner)


def _executive(doc: dict) -> str:
    s = doc.get("executive", {})
    found = "".join(_tag("li", html.escape(f["text"]) + _each("p", f.get("notes", ()))) for f in s.get("findings", ()))
    came = "".join(_tag("li", _tag("strong", html.escape(o["outcome"])) + _quote({"quote": o.get("quote"), "quote_attribution": o.get("attribution")})) for o in s.get("outcomes", ()))
    parts = [_each("p", (s.get("body") or "").split("\n\n"))]
    parts += [inner and _tag("h2", title) + _tag("ul", inner) for title, inner in (("Key findings", found), ("Notable outcomes", came), ("Open questions", _each("li", s.get("open_questions", ()))))]
    return _tag("h2", html.escape(s.get("headline") or "")) + "".join(parts)


def as_html(doc: dict) -> str:
    """A report as a page: hero, sections to go to, audit banner, executive part, questions with charts and details, methodology.

    Of ``doc`` only title, date, themes, quotes and notes must be there; ``executive`` (headline, body, findings, outcomes,
    open_questions), ``company``, ``banner``, ``written`` (question_id, question, synthesis, takeaways), ``leads`` and
    ``outliers`` add their parts.
    """
    of = lambda name, q: [x for x in doc.get(name, ()) if x["question_id"] == q]
    named = {w["question_id"]: w for w in doc.get("written", ())}
    ids = list(dict.fromkeys([*named, *(t["question_id"] for t in doc["themes"])]))
    title = html.escape(doc["title"])
    nav = '<a href="#executive-summary">Summary</a> ' + "".join(f'<a href="#{html.escape(q)}">{html.escape(named.get(q, {}).get("question") or q)}</a> ' for q in ids) + '<a href="#methodology">Methodology</a>'
    parts = []
    for q in ids:
        w, themes, quotes = named.get(q, {}), of("themes", q), of("quotes", q)
        loose = "".join(_quote(x) for x in quotes if "theme_id" not in x)
        prose = _each("p", [w.get("synthesis")]) + _tag("ul", _each("li", w.get("takeaways") or ()))
        body = _tag("h2", html.escape(w.get("question") or q)) + _chart(themes) + "".join(_quote(x) for x in of("leads", q)) + prose + _details(themes, quotes) + loose + _outliers(of("outliers", q))
        parts.append(_tag("section", body, id=q))
    notes = _each("p", (v for n in doc["notes"] for v in n.values()))
    hero = _tag("header", _tag("div", html.escape(doc.get("company") or ""), class_="badge") + f"<h1>{title}</h1><p>{html.escape(doc['date'])}</p>", class_="hero")
    banner = _tag("div", html.escape(doc.get("banner") or ""), class_="audit-banner", role="note")
    return (
        f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>{STYLE}</style></head><body>'
        f'<a class="skip-link" href="#executive-summary">Skip to the summary</a><nav aria-label="Sections">{nav}</nav>{hero}{banner}'
        f'<main><section id="executive-summary">{_executive(doc)}</section>{"".join(parts)}<section id="methodology"><h2>Methodology</h2>{notes}</section></main></body></html>'
    )


def banner(mode: str | None, status: str | None, lines: str) -> str:
    """What a reader must know first: that the audit was skipped, sampled or isn't complete; nothing for a whole one."""
    title = "Incomplete audit" if status == "incomplete" else {"skip": "Audit skipped", "sampled": "Sampled audit"}.get(mode or "")
    return f"{title}. {lines}" if title else ""


def evidence_rows(quotes: DataFrame) -> DataFrame:
    """Quotes as they go into the evidence file, with a stable anchor."""
    from veritally.semantics import anchor

    return quotes.select(anchor("quote", F.col("theme_id"), F.col("mention_id")).alias("anchor"), "question_id", "theme_id", "mention_id", fx.html_escaped(F.col("quote")).alias("quote"))


def compressed_context(findings: DataFrame, quotes: DataFrame, most: int = 3) -> DataFrame:
    """Of each question its totals as they are and up to three of its quotes."""
    best = quotes.where(F.col("pick") <= most).groupBy("question_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("pick", "theme_id", "quote"))), 1, most).alias("q"))
    return findings.join(best, "question_id", "left").withColumn("quotes", F.transform("q", lambda x: x["quote"])).drop("q")


def opportunities(bindings: DataFrame, counts: DataFrame) -> DataFrame:
    """Opportunities (opportunity_id, text, theme_id) with the calls of their theme written in, those of demoted themes left out."""
    rows = bindings.join(counts.where(~F.col("demoted")).select("theme_id", "mention_count"), "theme_id")
    return rows.select("opportunity_id", "theme_id", F.replace("text", F.lit("{calls}"), F.col("mention_count").cast("string")).alias("text"))
