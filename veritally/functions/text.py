"""Predicates and transformations of quotes and prose, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritally.semantics import n_words, squeezed, straightened, words

# Phrases, word lists and patterns that quotes are judged by.
META_PHRASES = [
    "take a call", "take this call", "on my laptop", "on my phone", "on my computer", "thanks for having", "thanks for taking",
    "thanks for calling", "glad to be here", "glad we could", "nice to meet", "nice to talk", "nice to speak", "before we get started",
    "before we begin", "before we dive in", "good question", "great question", "that's a great question", "appreciate you taking the time",
]
ROLES = "manager director head lead coordinator trainer coach owner founder president officer supervisor specialist instructor administrator analyst vp ceo cfo coo cto".split()
NOT_INTRO = (
    "pretty really just not also still already never always sure certain confident convinced going trying telling hoping looking thinking "
    "feeling working dealing afraid glad happy sorry one person only first last"
).split()
STOPWORDS = (
    "the and for are has was with from that they this their have been were who what which when where how not but can all more its into than "
    "also other any each about our your out new one use does issues using without across between manager director trainer coordinator "
    "instructor coach owner founder president officer supervisor specialist head lead"
).split()
STEMS = (
    "crash|broken|downtime|outage|churn|revenue|budget|pricing|subscription|schedul|workflow|automat|onboard|migrat|integrat|evaluat|implement|"
    "audit|competitor|alternative|vendor|hir|retain|cancel|renew|frustrat|nightmare|chaos|inefficien|bottleneck|compliance|deadline"
)
CLAIM = (
    r"\b(?:and|but|so|yet|because|since|where|then)\s+(?:the|it|we|our|i|they|my|this|that|things)\b.*?(?:hate|love|need|want|struggle|frustrat|"
    r"nightmare|chaos|terrible|broken|painful|amazing|difficult|challenge|problem|issue|spend|waste|save|cost|switch|evaluat|looking for|trying to|dealing with)"
)
INTRO = r"(?:^|(?<=[.!?;]\s))(?:so\s+|and\s+|well\s+)?i(?:'m|\s+am)\s+(?:the\s+|a\s+|an\s+)?((?:\w+\s+){0,8})"
BREADTH = r"\b(?:most|majority|many|several|few|all|every|everyone|nobody|widespread|often|commonly|frequently|half)\b"
RANKED = r"\b(?:most common|top|number one|leading|biggest|largest|primary|second most|third most)\b"
HEADER = r"^(\d{1,2}:\d{2}(?::\d{2})?) - (.+)$"


def both_cases(pattern: str) -> str:
    return "(?iu)" + pattern


def attribution_key(name: Column) -> Column:
    """A speaker's name for matching: before the comma, without a trailing parenthesis, squeezed."""
    return squeezed(F.regexp_replace(F.split(straightened(name), ",")[0], r"\s*\([^)]*\)\s*$", ""))


def is_csv_row(text: Column) -> Column:
    """A ticket id at the start, or four fields of which one is a date or a bare number."""
    fields = F.transform(F.split(text, ","), lambda f: F.regexp_replace(f, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    structured = F.exists(fields, lambda f: f.rlike(r"^(\d{4}-\d{2}-\d{2}|\d+(\.\d+)?)$"))
    return F.coalesce(text.rlike(r"^[A-Z]{2,}-\d+,") | ((F.size(fields) >= 4) & structured), F.lit(False))


def has_markdown(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\*\*[^*]+\*\*|__[^_]+__"), F.lit(False))


def has_signal(text: Column) -> Column:
    """Figures, business terms or a claim."""
    return F.coalesce(text.rlike(r"\d{2,}|\$\d") | text.rlike(both_cases(rf"\b(?:{STEMS})\w*\b")) | text.rlike(both_cases(CLAIM)), F.lit(False))


def is_low_signal(text: Column) -> Column:
    """Talk about the call, or a speaker's introduction by role, without a business signal."""
    low = F.lower(text)
    meta = F.exists(F.array(*map(F.lit, META_PHRASES)), lambda p: F.contains(low, p))
    said = F.transform(words(F.regexp_extract(low, "(?U)" + INTRO, 1)), lambda w: F.regexp_replace(w, r"^[.,;:()\"']+|[.,;:()\"']+$", ""))
    first = F.coalesce(F.get(said, F.lit(0)), F.lit(""))
    intro = ~first.isin(NOT_INTRO) & F.arrays_overlap(said, F.array(*map(F.lit, ROLES)))
    return F.coalesce((F.char_length(text) >= 10) & (meta | intro) & ~has_signal(text), F.lit(False))


def is_disqualified(text: Column) -> Column:
    n = n_words(text)
    return (n > 150) | (n < 5) | F.coalesce(text.rlike(r"\d{2}:\d{2}:\d{2}"), F.lit(False))


def off_length(text: Column) -> Column:
    return ~n_words(text).between(15, 80)


def _content(tokens: Column, strip: str) -> Column:
    bare = F.transform(tokens, lambda w: F.regexp_replace(w, f"^[{strip}]+|[{strip}]+$", ""))
    return F.array_distinct(F.filter(bare, lambda w: (F.char_length(w) >= 3) & ~w.isin(STOPWORDS)))


def theme_keywords(include: Column, description: Column) -> Column:
    joined = F.lower(F.concat_ws(" ", F.coalesce(include, F.lit("")), F.coalesce(description, F.lit(""))))
    return _content(words(F.replace(joined, F.lit(","), F.lit(" "))), ".,;:()")


def off_topic(text: Column, keywords: Column) -> Column:
    """No word of the quote matches a keyword: equal, or one inside the other where both have four letters."""
    own = _content(words(F.lower(text)), r".,;:()\"'!?\-")
    alike = lambda k, w: F.when((F.char_length(k) >= 4) & (F.char_length(w) >= 4), F.contains(w, k) | F.contains(k, w)).otherwise(k == w)
    return (F.size(keywords) > 0) & (F.size(own) > 0) & ~F.exists(keywords, lambda k: F.exists(own, lambda w: alike(k, w)))


def deletion_only(display: Column, quote: Column) -> Column:
    """The words of ``display`` are those of ``quote`` in order, some left out."""
    full = words(squeezed(quote))
    step = lambda shown: lambda at, w: F.when(at < F.size(shown), at + (F.get(shown, at) == w).cast("int")).otherwise(at)
    kept = lambda shown: F.aggregate(full, F.lit(0), step(shown)) == F.size(shown)
    return F.get(F.transform(F.array(words(squeezed(display))), kept), 0)  # bound to a variable, or each step would cut the words again


def truncated(text: Column, most: int) -> Column:
    """At most ``most`` characters, cut at the last blank, with an ellipsis."""
    head = F.substring(text, 1, most - 3)
    cut = F.regexp_extract(head, "(?s)^(.*) ", 1)
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.when(cut == "", head).otherwise(cut), F.lit("...")))


def html_escaped(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def markdown_escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_{}\[\]<>#|$])", r"\\$1")


def marked_up(text: Column) -> Column:
    """Bold and italic marks of escaped Markdown as tags."""
    return F.regexp_replace(F.regexp_replace(html_escaped(text), r"\*\*([^*]+)\*\*", "<strong>$1</strong>"), r"\*([^*]+)\*", "<em>$1</em>")


def newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\\n"), F.lit("\n"))


def humanized(file_id: Column) -> Column:
    return F.initcap(F.trim(F.replace(F.regexp_replace(file_id, r"^\d+[_-]*", ""), F.lit("_"), F.lit(" "))))


def shown_quote(display: Column, quote: Column) -> Column:
    return F.coalesce(F.nullif(display, F.lit("")), quote, F.lit(""))


def numerals(text: Column) -> Column:
    """Figures with currency, percent and size signs, without thousands separators."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[$€£]?\d+(?:,\d{3})*(?:\.\d+)?(?:%|[kmbx]\b)?"), F.lit(0))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")))


def unit_of(word: Column) -> Column:
    """What a counted noun stands for."""
    w = F.lower(word)
    return F.when(w.rlike(r"^source[ -]+types?$"), "source_types").when(w.startswith("mention"), "mentions").when(w.startswith("source"), "source_files").when(w.isNotNull(), "unverified_identity")


def headers(text: Column) -> Column:
    """Speaker headers of a transcript."""
    return F.regexp_extract_all(text, F.lit("(?m)" + HEADER), F.lit(0))


def sentences_with_numbers(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s.rlike(r"\d"))


def number_in_label(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?i)\d+\s*%|\(\s*\d+\s+(?:votes?|mentions?|sources?)\s*\)"), F.lit(False))


def clean_prose(text: Column) -> Column:
    """struct(kept, dropped): units of prose without those that state counts, ratios, percents or breadth."""
    units = F.split(F.replace(text, F.lit('"'), F.lit("")), r"(?<=[.!?;])\s+|\n")
    bad = lambda u: u.rlike(both_cases(r"\d+\s*(?:%|percent|/|of\s+\d)|\b\d+\s+(?:mentions?|sources?|customers?|calls?)\b")) | u.rlike(both_cases(BREADTH))
    return F.struct(F.array_join(F.filter(units, lambda u: ~bad(u)), " ").alias("kept"), F.filter(units, bad).alias("dropped"))


#: What a quote without a speaker is said to come from, by the type of its source.
DESCRIPTORS = {
    "sales_call": "sales call",
    "renewal_call": "renewal call",
    "churn_interview": "churn interview",
    "cs_call": "cs call",
    "nps_survey": "survey",
    "csat_survey": "survey",
    "general_survey": "survey",
    "review": "review",
    "support_ticket": "support ticket",
}


def source_descriptor(source_type: Column, file_id: Column) -> Column:
    """The neutral name of a source, that gives its speaker no role."""
    known = F.element_at(F.create_map(*[F.lit(x) for kv in DESCRIPTORS.items() for x in kv]), source_type)
    return F.coalesce(known, F.concat(F.lit("source: "), file_id))


def claim_text(text: Column, kind: Column, scope: Column) -> Column:
    lead = F.when(kind == "inference", "Inference: ").when(kind == "recommendation", "Recommendation: ").otherwise("")
    return F.concat(lead, text, F.when(F.coalesce(scope, F.lit("")) != "", F.concat(F.lit(" ("), scope, F.lit(")"))).otherwise(""))


def block_quotes(text: Column) -> Column:
    """Block quotes of Markdown without their marks; lines that follow one another are one quote."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)(?:^>[^\n]*(?:\n|\z))+"), F.lit(0))
    return F.transform(found, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?m)^> ?", ""), r"\s*\n\s*", " ")))
