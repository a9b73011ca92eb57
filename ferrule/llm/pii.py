"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Fixed patterns find the seeds (e-mail, IP, card and phone). The words around a
seed give lexical patterns: the word before it, the two before it, the words
on both sides, the word before it with the string's shape, and the signs and
the line start next to it with its shape. Other identifier-like strings, those
with a digit or an @, are candidates; digits in groups with single spaces,
brackets, dots and dashes are one string. Patterns and strings form a bipartite
graph that is scored in rounds: a pattern's confidence for a kind is the mean
score of the different strings that it meets (seeds count 1 for their kind),
smoothed by one miss. Patterns with a confidence of ``MIN_CONFIDENCE`` or more
and ``MIN_SEEDS`` different seeds are trusted: candidates that they meet and
that look like their kind are seeds of the next round, with the confidence as
their score, and so give new patterns. What is marked after ``ROUNDS`` rounds
joins the first seeds, which all stay.

Positions come from the gaps between matches: splitting by a pattern and
extracting it walk the same matches. Repetition in patterns is possessive or
over single characters, so long runs neither overflow the stack nor are
scanned again and again.

Edge cases: null text counts as empty; repeated rows are treated each on their
own; rows without a doc_id keep a null id; an empty table gives no rows; other
columns are ignored, and survive ``mask``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
MIN_CONFIDENCE, MIN_SEEDS = 0.8, 3
#: Characters of a gap that its neighbouring words are taken from.
NEAR = 80

#: Stands for a separator inside a card number, or a dot inside a domain; such characters of the text become _OTHER.
_MARK, _OTHER = "\x01", "\x02"
_LOCAL = "A-Za-z0-9._%+\\x01-"
_PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]*+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9\x01])[0-9][0-9\x01]++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_SIGNS = "A-Za-z._%+@()\\x01-"
_CANDIDATE = rf"(?<![0-9{_SIGNS}])(?=[A-Za-z._%+()\x01-]*+[0-9@])[0-9{_SIGNS}]*[A-Za-z0-9]"


def _readied(text: Column, kind: str) -> Column:
    """The text with the same length, in which the pattern's repetitions are over single characters."""
    plain = F.translate(text, _MARK, _OTHER)
    if kind == "email":
        return F.regexp_replace(plain, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _MARK)
    if kind == "card":
        return F.regexp_replace(plain, r"(?<=[0-9])[ -](?=[0-9])", _MARK)
    if kind == "other":
        return F.regexp_replace(plain, r"(?<=[0-9)]) (?=[0-9(])", _MARK)
    return text


def _may_have(text: Column, kind: str) -> Column:
    if kind == "email":
        return F.instr(text, "@") > 0
    if kind == "phone":
        return F.instr(text, "+") > 0
    return text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9][0-9 -]{12}")


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    n = F.length(digits)
    return F.when((n >= 14) & (n <= 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


def _valid(value: Column, kind: str) -> Column:
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])?"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


_NO_SPANS = "array<struct<kind:string,start:int,end:int,value:string,left:string,right:string>>"


def _parts(text: Column, kind: str) -> tuple[Column, Column]:
    """The gaps around the matches of a kind's pattern, and the matches."""
    pattern = _PATTERNS.get(kind, _CANDIDATE)
    ready = _readied(text, kind)
    gaps, values = F.split(ready, pattern, -1), F.regexp_extract_all(ready, F.lit(pattern), F.lit(0))
    may = _may_have(text, kind) if kind in _PATTERNS else text.rlike("[0-9@]")
    return F.when(may, gaps).alias(f"gap_{kind}"), F.when(may, values).alias(f"value_{kind}")


def _located(kind: str) -> Column:
    """All matches of a kind with their places and what stands around them, from the columns of ``_parts``."""
    gaps = F.col(f"gap_{kind}")
    around = F.arrays_zip(gaps.alias("gap"), F.col(f"value_{kind}").alias("value"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("next"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_NO_SPANS).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["value"]), F.lit(0))
        one = F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["value"].alias("value"),
            F.right(x["gap"], F.lit(NEAR)).alias("left"), F.left(x["next"], F.lit(NEAR)).alias("right"),
        )
        return F.struct(end.alias("at"), F.when(x["value"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(one))).alias("found"))

    return F.coalesce(F.aggregate(around, begin, step, lambda acc: acc["found"]), F.array().cast(_NO_SPANS)).alias(kind)


def _matched(rows: DataFrame, *kept: str) -> DataFrame:
    """(kept..., seeds, other) of rows with a text: the valid matches, and all candidates: (kind, start, end, value, left, right)."""
    # one step at a time: an expression used within a lambda would be computed for each element
    rows = rows.select(*kept, *(c for k in (*KINDS, "other") for c in _parts(F.col("text"), k)))
    rows = rows.select(*kept, *(_located(k) for k in (*KINDS, "other")))

    def valid(kind: str) -> Column:
        return F.filter(F.col(kind), lambda x: _valid(x["value"], kind))

    return rows.select(*kept, F.concat(*map(valid, KINDS)).alias("seeds"), "other")


def _key(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def find(docs: DataFrame) -> DataFrame:
    """(row_id, doc_id, key, seeds, candidates): stored, so that row_id is fixed from here on; key is a digest of the text."""
    # a null doc_id or a repeated one does not tell rows apart
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = _matched(rows.withColumn("key", _key(F.col("text"))), "row_id", "doc_id", "key")
    candidates = F.filter("other", lambda x: ~F.exists("seeds", lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"])))
    return stored(rows.select("row_id", "doc_id", "key", "seeds", candidates.alias("candidates")))


def _mentions(found: DataFrame) -> DataFrame:
    """(row_id, kind, start, end, value, pattern): each seed (with its kind) and candidate (kind null) under each of its patterns."""
    seeds = F.transform("seeds", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), x["left"].alias("left"), x["right"].alias("right")))
    others = F.transform("candidates", lambda x: F.struct(F.lit(None).cast("string").alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), x["left"].alias("left"), x["right"].alias("right")))
    rows = found.select("row_id", F.inline(F.concat(seeds, others)))
    # marks stand for a dot in an address and for a separator between digits
    rows = rows.withColumn("value", F.when(F.instr("value", "@") > 0, F.translate("value", _MARK, ".")).otherwise(F.translate("value", _MARK, " ")))

    def near(side: str) -> Column:
        return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(side, F.lit(""))), "[0-9]", "0"), r"\s+"), lambda w: w != "")

    shape = F.regexp_replace(F.regexp_replace("value", "[0-9]+", "0"), "[A-Za-z]+", "a")
    before = F.regexp_extract(F.coalesce("left", F.lit("")), r"(^|\n|[^\pL\pN\s])[ \t]*$", 1)
    behind = F.regexp_extract(F.coalesce("right", F.lit("")), r"^($|\n|[^\pL\pN\s])", 1)
    rows = rows.select("row_id", "kind", "start", "end", "value", near("left").alias("l"), near("right").alias("r"), shape.alias("shape"), before.alias("before"), behind.alias("behind"))
    one, two, after = F.try_element_at("l", F.lit(-1)), F.try_element_at("l", F.lit(-2)), F.try_element_at("r", F.lit(1))
    patterns = F.array(F.concat(F.lit("1 "), one), F.concat(F.lit("2 "), two, F.lit(" "), one), F.concat(F.lit("3 "), one, F.lit(" "), after),
        F.concat(F.lit("4 "), one, F.lit(" "), F.col("shape")), F.when(F.col("before") != "", F.concat(F.lit("5 "), "before", F.col("shape"), "behind")))
    return rows.select("row_id", "kind", "start", "end", "value", F.explode(F.filter(patterns, lambda p: p.isNotNull())).alias("pattern"))


def _looks_like(value: Column, kind: Column) -> Column:
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return (
        F.when(kind == "email", value.contains("@"))
        .when(kind == "ip", value.rlike(r"^[0-9]+\.[0-9]+\.[0-9.]+$"))
        .when(kind == "card", (digits >= 12) & value.rlike("^[0-9 -]+$"))
        .when(kind == "phone", digits.between(7, 15) & value.rlike("^[0-9+.() -]+$"))
        .otherwise(False)
    )


def confident_patterns(mentions: DataFrame, rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """(pattern, kind, confidence): patterns to be trusted after scoring the graph in rounds."""
    edges = stored(mentions.groupBy("pattern", "value").agg(F.max("kind").alias("seed")))
    degree = stored(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")))
    first = edges.where("seed is not null").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    seeds = first
    for k in range(rounds):
        met = edges.join(seeds, "value").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n_seeds"), F.sum("score").alias("gain"))
        rated = met.where(F.col("n_seeds") >= min_seeds).join(degree, "pattern").withColumn("confidence", F.col("gain") / (F.col("n") + 1))
        trusted = stored(rated.where(F.col("confidence") >= min_confidence).select("pattern", "kind", "confidence"))
        if k == rounds - 1 or trusted.isEmpty():
            break
        found = edges.where("seed is null").join(trusted, "pattern").where(_looks_like(F.col("value"), F.col("kind")))
        found = found.groupBy("value").agg(F.max(F.struct("confidence", "kind")).alias("best")).select("value", "best.kind", F.col("best.confidence").alias("score"))
        seeds = stored(first.unionByName(found))
    return trusted


def _ranked(x: Column) -> Column:
    order = F.coalesce(*(F.when(x["kind"] == k, F.lit(i)) for i, k in enumerate(KINDS)))
    return F.struct(x["start"].alias("start"), order.alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))


_RANKED = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _discovered(found: DataFrame, rounds: int, min_confidence: float, min_seeds: int) -> DataFrame:
    """(row_id, more): what the trusted patterns add to each row; stored, so that its size is known."""
    mentions = stored(_mentions(found))
    trusted = confident_patterns(mentions, rounds, min_confidence, min_seeds)
    more = mentions.where("kind is null").drop("kind").join(trusted, "pattern").where(_looks_like(F.col("value"), F.col("kind")))
    best = more.groupBy("row_id", "start", "end").agg(F.max(F.struct("confidence", "kind")).alias("best"))
    # spans of one row, bounded by its text
    more = best.groupBy("row_id").agg(F.collect_list(F.struct("start", F.col("best.kind").alias("kind"), "end")).alias("more"))
    return stored(more.select("row_id", F.transform("more", _ranked).alias("more")))


def spans(docs: DataFrame, rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """(row_id, doc_id, base, spans): base spans, and these with what the patterns discovered, by start, then kind."""
    found = find(docs)
    more = _discovered(found, rounds, min_confidence, min_seeds)
    both = found.select("row_id", "doc_id", F.sort_array(F.transform("seeds", _ranked)).alias("base")).join(more, "row_id", "left")
    return both.select("row_id", "doc_id", "base", F.sort_array(F.concat("base", F.coalesce("more", F.array().cast(_RANKED)))).alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its text replaced by ``[KIND]``; overlapping spans by the first's.

    Spans depend on the text alone, so what the patterns added is joined by a digest of the text: rows need no
    numbers that hold from one reading to the next, and only texts with additions are looked up.
    """
    names = docs.columns
    found = find(docs)
    more = _discovered(found, ROUNDS, MIN_CONFIDENCE, MIN_SEEDS)
    more = stored(found.select("row_id", "key").join(more, "row_id").select("key", "more").dropDuplicates(["key"]))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*names).alias("doc"), text.alias("text"), _key(text).alias("key"))
    rows = _matched(rows, "doc", "text", "key").select("doc", "text", "key", F.transform("seeds", _ranked).alias("base"))
    rows = rows.withColumn("more", F.array().cast(_RANKED)) if more.isEmpty() else rows.join(more, "key", "left")
    rows = rows.select("doc", "text", F.sort_array(F.concat("base", F.coalesce("more", F.array().cast(_RANKED)))).alias("spans"))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        before = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        inside = x["start"] < acc["at"]
        return F.struct(F.when(inside, acc["out"]).otherwise(before).alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))

    done = F.aggregate("spans", begin, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    masked = F.when(F.size("spans") == 0, F.col("doc.text")).otherwise(done)
    return rows.select(*(masked.alias("text") if c == "text" else F.col("doc")[c].alias(c) for c in names))


def query(docs: DataFrame) -> DataFrame:
    found = spans(docs)
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(line("base").cast("binary"), 256).alias("base_sha256"), line("spans").alias("spans"))
