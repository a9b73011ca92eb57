"""Text functions as column expressions: nothing here leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions import vocab as V
from ferrule.functions.vocab import ENDINGS, INTENT_STOP, STOP, VARIANTS


def in_list(name: str, values: list[str]) -> Column:
    """Whether a column is one of many fixed values (one expression, not a literal each)."""
    return F.expr(f"{name} IN ({', '.join(repr(v) for v in values)})")


def plain_norm(word: str) -> str:
    """``norm`` of one fixed word, for vocabularies."""
    ending = next((e for e in ENDINGS if len(word) > 4 and word.endswith(e)), "")
    return VARIANTS.get(word) or word[: len(word) - len(ending)]


def norm(name: str) -> Column:
    """The common form of a spelling variant, else the word without the first ending that fits."""
    variants = " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in VARIANTS.items())
    endings = " ".join(f"WHEN length({name}) > 4 AND endswith({name}, {e!r}) THEN left({name}, length({name}) - {len(e)})" for e in ENDINGS)
    return F.expr(f"CASE {name} {variants} ELSE CASE {endings} ELSE {name} END END")


def raw_rows(rows: DataFrame, text: Column, *keys: str) -> DataFrame:
    """(keys..., _w): tokens before they are normalised, a row each, in no order.

    Split at anything but letters, digits and ``+#._-``; stop words and single letters go; compound
    words also give their parts. Works on exploded rows, where expressions are compiled.
    """
    raw = rows.select(*keys, F.explode(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9+#._-]+")).alias("_w"))
    raw = raw.select(*keys, F.btrim("_w", F.lit("._-")).alias("_w")).where((F.length("_w") >= 2) & ~in_list("_w", STOP))
    stop = ", ".join(repr(w) for w in STOP)
    each = F.expr(f"CASE WHEN contains(_w, '-') OR contains(_w, '.') THEN concat(array(_w), filter(split(_w, '[-.]'), p -> length(p) > 2 AND p NOT IN ({stop}))) ELSE array(_w) END")
    return raw.select(*keys, F.explode(each).alias("_w"))


def token_rows(rows: DataFrame, text: Column, *keys: str) -> DataFrame:
    """(keys..., term): normalised tokens, a row each, in no order."""
    return raw_rows(rows, text, *keys).select(*keys, norm("_w").alias("term"))


def term_counts(rows: DataFrame, text: Column) -> DataFrame:
    """(term, n) over all texts: spellings are counted first, and each is normalised once."""
    spelt = raw_rows(rows, text).groupBy("_w").agg(F.count(F.lit(1)).alias("n"))
    return spelt.select(norm("_w").alias("term"), "n").groupBy("term").agg(F.sum("n").alias("n"))


def norm_key(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), F.lit(" "))


def clean_prompt(text: Column) -> Column:
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\[[^\]]*\]\([^)]*\)", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"<[^>]+>", " "), r"^[ \t\n\r]*[*#]+[ \t\n\r]*", "")
    return F.btrim(F.regexp_replace(out, r"[ \t\n\r]+", " "), F.lit(" "))


def split_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r]+"), lambda w: w != "")


def intent_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z][a-z0-9_-]{2,}"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: ~F.array_contains(F.split(F.lit(" ".join(INTENT_STOP)), " "), w)))


def intent_key(tokens: Column) -> Column:
    """Sorted tokens, or a digest of them where there are more than 24."""
    line = F.array_join(F.array_sort(tokens), " ")
    digest = F.concat(F.lit("intent:"), F.substring(F.sha1(line.cast("binary")), 1, 16), F.lit(" ("), F.size(tokens).cast("string"), F.lit(" tokens)"))
    return F.when(F.size(tokens) > 24, digest).otherwise(line)


def flags(text: Column, rules: list[tuple[str, str]]) -> Column:
    r"""Names of the rules whose pattern is found, in the order of the rules; \w, \d and \b are those of Unicode."""
    return F.filter(F.array(*(F.when(text.rlike(f"(?U){p}"), F.lit(n)) for n, p in rules)), lambda x: x.isNotNull())


def found_in(text: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words is in the text; cheaper than a pattern."""
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def item_hash(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts)).cast("binary")), 1, 16)


def ecosystems(tokens: Column) -> Column:
    """The different ecosystems that normalised tokens point to, sorted."""
    known = {plain_norm(t): name for name, ts in V.ECOSYSTEMS.items() for t in ts.split()}
    table = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    return F.array_sort(F.array_distinct(F.filter(F.transform(tokens, lambda t: F.element_at(table, t)), lambda x: x.isNotNull())))


def typed_concepts(text: Column) -> Column:
    """Concepts of what is typed, in order: a word counts once, and neither it nor its concepts come again."""
    table = F.create_map(*(F.lit(x) for kv in V.CONCEPTS.items() for x in kv))
    found = F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9][a-z0-9.+#-]{1,24}"), F.lit(0)), lambda w: F.btrim(w, F.lit(".-+#")))
    none = F.array().cast("array<string>")

    def step(acc: Column, w: Column) -> Column:
        extra = F.split(F.element_at(table, w), " ")
        seen = F.concat(acc["seen"], F.array(w))
        fresh = F.filter(extra, lambda t: ~F.array_contains(seen, t))
        hit = F.struct(F.concat(seen, extra).alias("seen"), F.concat(acc["out"], fresh).alias("out"))
        miss = F.struct(seen.alias("seen"), acc["out"].alias("out"))
        return F.when(F.array_contains(acc["seen"], w) | (w == ""), acc).when(extra.isNull(), miss).otherwise(hit)

    return F.aggregate(found, F.struct(none.alias("seen"), none.alias("out")), step, lambda acc: acc["out"])


def tokenize_array(text: Column) -> Column:
    """Normalised tokens of a text as an array, in order: for short texts, where a row for each is not worth it."""
    stop = F.split(F.lit(" ".join(STOP)), " ")
    variants = F.create_map(*(F.lit(x) for kv in VARIANTS.items() for x in kv))
    kept = lambda w: ~F.array_contains(stop, w)

    def parts(w: Column) -> Column:
        more = F.filter(F.split(w, "[-.]"), lambda p: (F.length(p) > 2) & kept(p))
        return F.when(w.contains("-") | w.contains("."), F.concat(F.array(w), more)).otherwise(F.array(w))

    def stem(w: Column) -> Column:
        cut = F.coalesce(*(F.when((F.length(w) > 4) & w.endswith(e), F.substring(w, F.lit(1), F.length(w) - len(e))) for e in ENDINGS))
        return F.coalesce(F.element_at(variants, w), cut, w)

    words = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9+#._-]+"), lambda x: F.btrim(x, F.lit("._-")))
    return F.transform(F.flatten(F.transform(F.filter(words, lambda x: (F.length(x) >= 2) & kept(x)), parts)), stem)
