"""Decisions on rounding, words and text that every operator shares.

Percentages are half-even over a/b*100 in that order of operations. Words are stretches without white space in the
Unicode sense. Regular expressions name letters as classes, so that any engine reads them alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\s\p{Z}]+"
BLANKS = r"[\s\p{Z}]+"


def pct(part: Column, whole: Column) -> Column:
    """Whole percent as long, 0 without a denominator."""
    ratio = F.try_divide(part.cast("double"), whole.cast("double")) * 100
    return F.coalesce(F.bround(ratio), F.lit(0.0)).cast("long")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def squeezed(text: Column) -> Column:
    """Lower case, runs of blanks as one space, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(text, BLANKS, " ")))


def straightened(text: Column) -> Column:
    """Curly quotation marks and long dashes as ASCII, an ellipsis as three dots."""
    return F.replace(F.translate(text, "‘’“”–—", "''\"\"--"), F.lit("…"), F.lit("..."))


def case_kept(text: Column) -> Column:
    """Straight signs and single spaces, letters as they are."""
    return F.trim(F.regexp_replace(straightened(text), BLANKS, " "))


def normalized(text: Column) -> Column:
    """The form in which quotes are compared with sources: no escapes, straight signs, squeezed."""
    return squeezed(straightened(F.regexp_replace(text, r"\\([^\\])", "$1")))


def stable(id_col: Column) -> Column:
    """A spreading order of ids that owes nothing to the alphabet."""
    return F.sha2(id_col, 256)


def file_of(mention_id: Column) -> Column:
    """The file id inside a mention id, as greedily as can be; null if the id has another form."""
    return F.nullif(F.regexp_extract(mention_id, r"^(.+)_Q\d+_\d+$", 1), F.lit(""))


def digest(*parts: Column) -> Column:
    """SHA-256 of a canonical JSON array of strings: compact, null as null, in the order given."""
    quoted = [F.coalesce(F.concat(F.lit('"'), F.replace(F.replace(p.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit("null")) for p in parts]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *quoted), F.lit("]")), 256)


def canonical_digest(**parts: Column) -> Column:
    """SHA-256 of a canonical JSON object: keys sorted, compact separators, letters unescaped, nulls kept."""
    body = F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]), {"ignoreNullFields": "false"})
    return F.sha2(body, 256)


def anchor(kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{kind}-"), F.substring(digest(*parts), 1, 24))
