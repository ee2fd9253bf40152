"""Secret scan: candidates by pattern, false positives removed by a random forest; DataFrame operations throughout.

A candidate is what a name such as password or token is set to, of 8 characters or more of any kind; or, wherever it stands,
a stretch of 16 or more key characters with a digit among them. Its features are its length, how likely its transitions
from character to character are in secrets and in other findings, its classes of characters, how much of it dictionary words
cover, what its path says, and the words on either side. The forest is Spark's own; it and the transitions are learned from
labelled findings. The dictionary is the letters-only part of a public vocabulary.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritally.llm import common

KEY = "[A-Za-z0-9+/_\\-]"
FOR = "pass|pwd|secret|token|api.?key|access.?key|private|credential|auth|bearer|signing|client_id"
SET = "[:=][\"' ]{0,2}"
ASSIGNED = f"(?<={SET})(?<=(?i:{FOR})[A-Za-z_\\-]{{0,12}}[\"']?[ ]?{SET})[^\\s\"'<>,;&()]{{8,}}"
CANDIDATE = f"{ASSIGNED}|(?<!{KEY})(?=[A-Za-z+/_\\-]*+[0-9]){KEY}{{16,}}+={{0,2}}"
BEFORE, AFTER = 48, 24  #: characters that count as neighbours
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
SIGNS = len(ALPHABET) + 1  #: kinds of characters in a transition; all others are one
WORD_LETTERS = (4, 12)  #: letters of the dictionary's words
PIECE = 256  #: characters of a candidate that are looked at together
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Words that names in code are made of; the labelled findings below use them. Fixed values.
WORDS = (
    "about above account action address after again agent alert align alpha apple apply array async author avail back base batch beta "
    "block board body book border button cache call cart case chain change check child class clean client clone close cloud code color "
    "column comment commit common config connect content control count create data date debug default delete demo detail device draft "
    "edit element email empty enable entry error event example export false field file filter final first folder font form frame from "
    "global grid group guide hash head hello home host html icon image import index info input item json label last layout left length "
    "level library line link list load local login main manager master menu message method model module month name network node null "
    "number object option order page panel param parse path place post print process profile project public query read release report "
    "request reset response result return right root sample save schema script search section select server service session set show "
    "size sort source start state static status step string style system table target task test text theme thread time title token tool "
    "tree true type update upload user value version video view widget window with word work world xxxx your zone"
).split()
AGAINST = "commit|revision|sha|md5|checksum|digest|uuid|guid|etag|hash|isbn|order|invoice|card|account|phone|build|version|image|example|placeholder|dummy"
PATHS = "test|example|sample|fixture|mock|doc|vendor|node_modules|\\.lock|\\.md$"


def dictionary(spark: SparkSession, vocabulary: str) -> DataFrame:
    """The lower-case words of WORD_LETTERS letters in a vocabulary file (tokenizers, word ends marked); at most its size."""
    low, high = WORD_LETTERS
    found = json.loads(common.vocabulary_bytes(vocabulary))["model"]["vocab"]
    words = sorted({w.removesuffix("</w>") for w in found if w.endswith("</w>")})
    words = [w for w in words if low <= len(w) <= high and w.isascii() and w.isalpha()]
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(words)), "array<string>")).alias("word"))


def _pieces(rows: DataFrame) -> DataFrame:
    """(digest, n, piece, lead, own, tail): each different candidate of ``rows`` in stretches of PIECE characters.

    ``n`` is the candidate's length; a stretch knows a word's letters on either side, no row has more of its candidate.
    """
    one = rows.where("candidate is not null").select(F.sha2("candidate", 256).alias("digest"), "candidate").dropDuplicates(["digest"])
    parts = one.select("digest", F.char_length("candidate").alias("n"), F.regexp_extract_all("candidate", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("c"))
    part = lambda i: F.coalesce(F.get("c", i), F.lit(""))
    beside = WORD_LETTERS[1] - 1
    spots = F.sequence(F.lit(0), F.greatest(F.size("c") - 1, F.lit(0)))
    made = F.transform(spots, lambda i: F.struct(i.alias("piece"), F.right(part(i - 1), F.lit(beside)).alias("lead"), part(i).alias("own"), F.left(part(i + 1), F.lit(beside)).alias("tail")))
    return parts.select("digest", "n", F.explode(made).alias("x")).select("digest", "n", "x.*")


def shaped(rows: DataFrame, words: DataFrame, table: list[float]) -> DataFrame:
    """``rows`` with three numbers of each ``candidate``, read in bounded stretches, so that its length costs time and no memory.

    ``cover``: the share of characters that lie in words of the dictionary; ``transitions``: the mean of ``table`` over its
    transitions; ``distinct``: different characters in its length. All are 0 for a null candidate.
    """
    low, high = WORD_LETTERS
    pieces = common.staged(_pieces(rows), "pieces", compact=True)
    text, lead = F.translate(F.concat("lead", "own", "tail"), CAPITALS, CAPITALS.lower()), F.char_length("lead")
    starts = pieces.select("digest", "piece", lead.alias("lead"), F.char_length("own").alias("own"), text.alias("text")).where(F.col("text").rlike(f"[a-z]{{{low}}}"))
    starts = starts.withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.char_length("text") - low + 1, F.lit(1)))))
    parts = starts.withColumn("word", F.explode(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda n: F.substring(F.col("text"), F.col("at"), n)))).drop("text")
    hits = parts.where(F.col("word").rlike("^[a-z]+$")).join(F.broadcast(words), "word")  # bounded by the vocabulary file
    spans = hits.groupBy("digest", "piece", "lead", "own").agg(F.collect_set(F.struct("at", F.char_length("word").alias("n"))).alias("spans"))
    places = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1))))
    inside = F.filter(places, lambda x: (x > F.col("lead")) & (x <= F.col("lead") + F.col("own")))
    none = F.lit(None)
    covered = spans.select("digest", none.cast("int").alias("n"), F.size(inside).alias("places"), none.cast("decimal(38,12)").alias("odds"), none.cast("string").alias("sign"))
    odds = F.from_json(F.lit(json.dumps(table)), "array<double>")
    sum_of = F.aggregate(_pairs(F.concat(F.right("lead", F.lit(1)), "own")), F.lit(0.0), lambda total, x: total + F.element_at(odds, x + 1))
    passed = pieces.select("digest", "n", F.lit(0).alias("places"), sum_of.cast("decimal(38,12)").alias("odds"), none.cast("string").alias("sign"))
    signs = pieces.select("digest", none.cast("int").alias("n"), F.lit(0).alias("places"), none.cast("decimal(38,12)").alias("odds"), F.explode(F.array_distinct(F.filter(F.split("own", ""), lambda x: x != ""))).alias("sign"))
    each = covered.unionByName(passed).unionByName(signs).groupBy("digest").agg(F.max("n").alias("n"), F.sum("places").alias("places"), F.sum("odds").alias("odds"), F.countDistinct("sign").alias("signs"))
    n = F.greatest(F.col("n"), F.lit(1))
    numbers = each.select("digest", (F.col("places") / n).alias("cover"), (F.col("odds").cast("double") / F.greatest(n - 1, F.lit(1))).alias("transitions"), (F.col("signs") / n).alias("distinct"))
    keyed = rows.withColumn("digest", F.sha2("candidate", 256)).join(numbers, "digest", "left").drop("digest")
    return keyed.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("cover", "transitions", "distinct")})


def _pairs(candidate: Column) -> Column:
    """Numbers of the transitions from each character to the next."""
    kinds = F.transform(F.split(candidate, ""), lambda x: F.when(x == "", 0).otherwise(F.instr(F.lit(ALPHABET), x)))
    return F.zip_with(F.slice(kinds, F.lit(1), F.greatest(F.size(kinds) - 1, F.lit(0))), F.slice(kinds, F.lit(2), F.greatest(F.size(kinds) - 1, F.lit(0))), lambda a, b: a * SIGNS + b)


def transitions(findings: DataFrame) -> list[float]:
    """Of each transition, the log of how much likelier it is in secrets than in other findings; a row for each pair of signs."""
    labels = findings.groupBy(F.sha2("candidate", 256).alias("digest")).agg(F.sum("label").alias("of"), F.count(F.lit(1)).alias("n"))
    pairs = _pieces(findings).select("digest", F.explode(_pairs(F.concat(F.right("lead", F.lit(1)), "own"))).alias("pair"))
    each = pairs.join(labels, "digest").groupBy("pair").agg(F.sum("of").alias("of"), F.sum("n").alias("n"))
    rows = {r["pair"]: (r["of"], r["n"] - r["of"]) for r in each.collect()}  # at most SIGNS squared
    of, off = (sum(x[k] for x in rows.values()) + SIGNS * SIGNS for k in (0, 1))
    return [math.log((rows.get(k, (0, 0))[0] + 1) / of) - math.log((rows.get(k, (0, 0))[1] + 1) / off) for k in range(SIGNS * SIGNS)]


@dataclass(eq=False)
class Model:
    forest: RandomForestClassificationModel
    transitions: list[float]
    vocabulary: str


def features(candidate: Column, path: Column, before: Column, after: Column) -> dict[str, Column]:
    """Named numbers of rows that are ``shaped``; each is defined for null parts as for empty ones."""
    c, path, before, after = (F.coalesce(x, F.lit("")) for x in (candidate, path, before, after))
    n = F.greatest(F.char_length(c), F.lit(1))
    share = lambda pattern: F.char_length(F.regexp_replace(c, pattern, "")) / n  # noqa: E731  of what the pattern leaves
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "#"), "[a-z]", "a"), "[A-Z]", "A"), "[^#aA]", ".")
    lower = F.lower(c)
    return {
        "transitions": F.col("transitions"),
        "length": F.char_length(c).cast("double"),
        "changes": (F.char_length(F.regexp_replace(kinds, "(.)\\1+", "$1")) - 1) / n,
        "repeats": 1 - F.char_length(F.regexp_replace(c, "(.)\\1+", "$1")) / n,
        "digits": share("[^0-9]"),
        "upper": share("[^A-Z]"),
        "lower": share("[^a-z]"),
        "signs": share("[A-Za-z0-9]"),
        "vowels": share("[^aeiouAEIOU]"),
        "hex": lower.rlike("^[0-9a-f]+$").cast("double"),
        "plain": c.rlike("^[0-9]+$").cast("double"),
        "grouped": lower.rlike("^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$").cast("double"),
        "distinct": F.col("distinct"),
        "cover": F.col("cover"),
        "prefix": c.rlike("^(AKIA|ASIA|ghp_|gho_|sk_live_|sk-|xox[bp]-|glpat-|AIza|eyJ)").cast("double"),
        "path": F.lower(path).rlike(PATHS).cast("double"),
        "set": before.rlike("[=:]\\s*[\"']?$").cast("double"),
        "quoted": (before.rlike("[\"']$") & after.rlike("^[\"']")).cast("double"),
        "for": F.lower(before).rlike(f"({FOR})[^\\n]{{0,12}}$").cast("double"),
        "against": F.lower(before).rlike(f"({AGAINST})[^\\n]{{0,12}}$").cast("double"),
        "address": before.rlike("(://|www\\.|[/.@])\\S*$").cast("double"),
    }


def labelled_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """(path, before, candidate, after, label): findings of known kind, made by rule from hashes of their number.

    A stand-in for findings that people have labelled; any table with these columns can take its place.
    """
    i = F.col("id").cast("string")
    hexes, other = F.sha2(i, 512), F.sha2(F.concat(F.lit("o"), i), 512)
    letters = F.base64(F.unhex(hexes))
    r = F.col("id") % 32
    digits = F.regexp_replace(F.conv(F.substring(other, 1, 15), 16, 10), "^", "4")
    word = lambda k: F.element_at(F.array(*map(F.lit, WORDS)), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))).cast("int") + 1)
    name = F.concat_ws("_", word(1), word(2), word(3), F.substring(digits, 3, 2))
    upper = F.translate(F.upper(F.substring(letters, 1, 16)), "+/0189", "QZWXYK")
    kinds = [  # candidate, what stands before, what stands after, label
        (F.concat(F.lit("AKIA"), upper), "", " ", 1),
        (F.concat(F.lit("AKIA"), upper), "aws_access_key_id = ", "\n", 1),
        (F.substring(hexes, 1, 18), "password=", " ", 1),
        (F.substring(hexes, 1, 40), 'token = "', '"', 1),
        (F.substring(letters, 1, 40), 'aws_secret_access_key: "', '"', 1),
        (F.concat(F.lit("ghp_"), F.translate(F.substring(letters, 1, 36), "+/", "aB")), "", " ", 1),
        (F.concat(F.lit("sk_live_"), F.translate(F.substring(letters, 5, 24), "+/", "aB")), "key: ", "\n", 1),
        (F.substring(hexes, 1, 64), "client_secret=", "&", 1),
        (F.substring(letters, 1, 32), "api_key='", "'", 1),
        (F.concat(F.lit("eyJ"), F.translate(F.substring(letters, 1, 70), "+/", "-_")), "Authorization: Bearer ", "\n", 1),
        (F.substring(hexes, 1, 24), "PASSWORD: ", "\n", 1),
        (F.substring(digits, 1, 16), "", " ", 0),
        (F.substring(digits, 1, 16), "card number ", ".", 0),
        (F.substring(hexes, 1, 40), "commit ", "\n", 0),
        (F.substring(hexes, 1, 32), "md5: ", " ", 0),
        (F.substring(hexes, 1, 64), "sha256=", "\n", 0),
        (F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12)), "id: ", " ", 0),
        (name, "", "(", 0),
        (F.concat_ws("-", word(4), word(5), word(6), F.substring(digits, 2, 4)), "https://host/", "/", 0),
        (F.concat(F.repeat(F.lit("x"), 12), F.lit("1234")), 'token = "', '"', 0),
        (F.concat(F.lit("your_"), word(7), F.lit("_key_123")), "api_key=", "\n", 0),
        (F.concat(F.lit("00000000"), F.substring(digits, 2, 10)), "order ", " ", 0),
        (F.concat_ws("/", word(8), word(9), word(1), F.substring(digits, 4, 3)), "src/", ".", 0),
        (F.concat(F.substring(digits, 1, 8), F.lit("-"), F.substring(digits, 4, 8)), "build ", " ", 0),
        (F.concat(F.translate(F.substring(letters, 1, 10), "0123456789+/", "!@#$%^*?~.-_"), F.substring(hexes, 1, 2)), "password: ", "\n", 1),
        (F.concat(F.initcap(word(1)), F.initcap(word(2)), F.initcap(word(5)), F.substring(digits, 5, 2)), 'db_password="', '"', 1),
        (F.translate(F.substring(letters, 1, 32), "0123456789+/", "abcdefghijkl"), "api_key = ", "\n", 1),
        (F.concat(F.lit("$"), F.translate(F.substring(letters, 3, 18), "+/", "#!")), "SECRET_KEY='", "'", 1),
        (F.concat(F.lit("config."), word(1), F.lit("."), word(2)), "password = ", "\n", 0),
        (F.concat(F.lit("${"), F.upper(word(3)), F.lit("_SECRET}")), "secret: ", "\n", 0),
        (F.concat(F.lit("get_"), word(4), F.lit("_"), word(2)), "token = ", "(", 0),
        (F.concat(F.lit("changeme"), word(6)), "password: ", "\n", 0),
    ]
    row = F.element_at(F.array(*[F.struct(c.alias("candidate"), F.lit(b).alias("before"), F.lit(a).alias("after"), F.lit(float(y)).alias("label")) for c, b, a, y in kinds]), (r + 1).cast("int"))
    path = F.when(F.pmod(F.xxhash64("id"), F.lit(7)) == 0, F.lit("tests/fixture.py")).otherwise(F.lit("src0"))
    lead = F.concat(word(3), F.lit(" "), word(4), F.lit(" "))
    return spark.range(0, n, 1, 1).select(path.alias("path"), row.alias("r"), lead.alias("lead")).select("path", F.concat("lead", "r.before").alias("before"), "r.candidate", "r.after", "r.label")


def fit(findings: DataFrame, trees: int = 25, depth: int = 7, bound: int = 20_000, seed: int = 3, vocabulary: str = "word_bpe_49k.json") -> Model:
    """A forest from at most ``bound`` labelled findings, those with the smallest hashes; findings without label don't count."""
    known = findings.where("label is not null and candidate is not null").orderBy(F.xxhash64("path", "before", "candidate", "after"), "candidate").limit(bound)
    known = common.staged(known, "findings")  # plans of training stay small
    table = transitions(known)
    rows = shaped(known, dictionary(findings.sparkSession, vocabulary), table)
    made = features(F.col("candidate"), F.col("path"), F.col("before"), F.col("after"))
    order = F.xxhash64("path", "before", "candidate", "after")
    wide = common.staged(rows.select("label", order.alias("order"), *[v.alias(k) for k, v in made.items()]), "features", compact=True).repartition(1).sortWithinPartitions("order", *made)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(VectorAssembler(inputCols=list(made), outputCol="features").transform(wide))
    return Model(forest, table, vocabulary)


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", path: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """id, nth, start, candidate, score, is_secret: of each candidate of each whole text.

    ``nth`` and ``start`` (characters) count from 0 within the text. Texts without candidates, null and empty ones give
    no rows. Each row of ``docs`` gives its own findings, also when rows or ids repeat or the id is null; a missing or
    null path counts as empty. A candidate may be of any length: what is counted in it is counted in stretches of PIECE
    characters, so one line of base64 is no more than many rows. Other columns are not carried on.
    """
    path_of = F.col(path) if path and path in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("_id"), path_of.alias("_path"), F.col(text).alias("_text")).where(F.col("_text").rlike(CANDIDATE))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    found = F.regexp_extract_all("_text", F.lit(CANDIDATE), F.lit(0))
    between = F.split("_text", CANDIDATE, -1)
    rows = rows.select("_id", "_path", "_row", F.arrays_zip(found.alias("candidate"), between.alias("gap"), F.slice(between, 2, F.size(between)).alias("next")).alias("all"))
    rows = rows.select("_id", "_path", "_row", F.posexplode("all").alias("nth", "x")).where(F.col("x.candidate").isNotNull())
    before, after = F.right(F.col("x.gap"), F.lit(BEFORE)), F.left(F.coalesce("x.next", F.lit("")), F.lit(AFTER))
    rows = rows.select("_id", "_path", "_row", "nth", F.col("x.candidate").alias("candidate"), F.char_length("x.gap").alias("gap"), before.alias("before"), after.alias("after"))
    order = Window.partitionBy("_row").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.sum(F.col("gap") + F.char_length("candidate")).over(order) - F.char_length("candidate"))
    rows = shaped(common.staged(rows, "candidates"), dictionary(docs.sparkSession, model.vocabulary), model.transitions)
    made = features(F.col("candidate"), F.col("_path"), F.col("before"), F.col("after"))
    wide = rows.select("_id", "nth", "start", "candidate", *[v.alias(k) for k, v in made.items()])
    scored = model.forest.transform(VectorAssembler(inputCols=list(made), outputCol="features").transform(wide))
    score = F.element_at(vector_to_array("probability"), 2)
    return scored.select(F.col("_id").alias(id_col), "nth", F.col("start").cast("long"), "candidate", score.alias("score"), (score >= threshold).alias("is_secret"))
