"""Numbers that prose states as data, read by one JVM pattern with a few characters on either side of each.

No row goes through Python. A text's numbers become rows with their places, so that checks on places are joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritally.functions.prose import MEASURES

LETTER = r"[\p{L}\p{M}\p{N}_]"
QUOTED = "“[^”]{0,299}”|‘[^’]{0,299}’|\"[^\"]{0,299}\""
SHARE = r"[0-9]+(?:\.[0-9]+)?\s*%"
RATIO = r"[0-9]+\s*(?:of|/)\s*[0-9]+"
ALONE = f"(?<!{LETTER})[0-9]+(?!{LETTER})"
BESIDE, AHEAD = 6, 20  #: characters in which a range, or a measured unit, counts
NUMBER = f"(?s)(?<=(.{{{BESIDE}}}|\\A.{{0,{BESIDE - 1}}}))({QUOTED}|{SHARE}|{RATIO}|{ALONE})(?=(.{{{AHEAD}}}|.{{0,{AHEAD - 1}}}\\z))"
RANGE = "[0-9]\\s*[-–—]\\s*[0-9]"


def numbers(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, value, type, start) of the numbers outside quotations: percentages, both sides of ratios, and counts.

    Counts are whole numbers of two digits or more that stand alone: no amounts of money, none within BESIDE characters of a
    range, no approximations, none that a unit of measure follows, no years. ``key`` names a row; ``start`` counts characters.
    Null texts have none.
    """
    part = lambda i: F.regexp_extract_all(text, F.lit(NUMBER), F.lit(i))
    gaps = F.transform(F.split(text, NUMBER, -1), lambda g: F.char_length(g))
    read = rows.where(F.col(text).rlike("[0-9]")).select(*key, F.posexplode(F.arrays_zip(part(1).alias("before"), part(2).alias("said"), part(3).alias("after"), gaps.alias("gap"))).alias("_nth", "_x"))
    read = read.where("_x.said is not null").select(*key, "_nth", "_x.*")
    order = Window.partitionBy(*key).orderBy("_nth").rowsBetween(Window.unboundedPreceding, 0)
    read = read.withColumn("start", (F.sum(F.col("gap") + F.char_length("said")).over(order) - F.char_length("said")).cast("int"))
    said, before, after = F.col("said"), F.col("before"), F.col("after")
    digits = said.rlike("^[0-9]+$")
    unit = F.regexp_replace(F.lower(F.regexp_extract(after, r"^\s*(\S+)", 1)), "[.,;:!?]+$", "")
    near = F.concat(before, said, F.left(after, F.lit(BESIDE)))
    plain = (F.char_length(said) > 1) & ~before.rlike(r"\$\s{0,2}$") & ~before.rlike(r"[~≈]\s?$") & ~near.rlike(RANGE) & ~unit.isin(*sorted(MEASURES)) & ~said.rlike("^(19|20)[0-9]{2}$")
    made = lambda value, kind, at: F.struct(value.alias("value"), F.lit(kind).alias("type"), at.cast("int").alias("start"))
    number = F.regexp_extract(said, "^[0-9.]+", 0)
    share = F.when(F.contains(number, F.lit(".")), F.bround(number.cast("double")).cast("long").cast("string")).otherwise(number)
    last = F.regexp_extract(said, "[0-9]+$", 0)
    found = (
        F.when(F.endswith(said, F.lit("%")), F.array(made(share, "percentage", F.col("start"))))
        .when(said.rlike(f"^{RATIO}$"), F.array(made(F.regexp_extract(said, "^[0-9]+", 0), "fraction_numerator", F.col("start")), made(last, "fraction_denominator", F.col("start") + F.char_length(said) - F.char_length(last))))
        .when(digits & plain, F.array(made(said, "count", F.col("start"))))
    )
    return read.select(*key, F.explode(found).alias("n")).select(*key, "n.*")


def outside(points: DataFrame, spans: DataFrame, key: list[str], width: int = 256) -> DataFrame:
    """``points`` (key, start, …) that lie in none of ``spans`` (key, from, to) of the same key: a join on stretches of ``width`` characters."""
    bins = spans.where("to > from").select(*key, "from", "to", F.explode(F.sequence(F.floor(F.col("from") / width), F.floor((F.col("to") - 1) / width))).alias("_bin"))
    p, s = points.withColumn("_bin", F.floor(F.col("start") / width)).alias("p"), bins.alias("s")
    same = [F.col(f"p.{c}") == F.col(f"s.{c}") for c in (*key, "_bin")]
    held = (F.col("p.start") >= F.col("s.from")) & (F.col("p.start") < F.col("s.to"))
    for c in same:
        held = held & c
    return p.join(s, held, "left_anti").drop("_bin")
