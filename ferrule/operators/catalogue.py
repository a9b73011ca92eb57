"""Ranking a catalogue of items for prompts: full score, full fusion, selection with quotas and top-up.

The sides of the term join are postings and query terms; everything that a pair adds to its score
(mention of the name, hints, stack, learnt weights, ecosystems) is looked up on pairs that share a term
or a hint, so prompts and items never meet as a cross product.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions import vocab as V
from ferrule.functions.text import in_list, norm, plain_norm, token_rows, typed_concepts
from ferrule.operators.choose import FLOOR, TAIL
from ferrule.operators.retrieve import ALPHA, B, DENSE_BONUS, DEPTH, GENERIC_DAMP, K1, NAME_BOOST
from ferrule.sources.shared import stored

HINT, HINT_MOST, MENTION, STACK, STACK_MOST, LEARNT, FOREIGN = 0.12, 0.36, 1.0, 0.04, 3, 0.05, 0.14
MAIN_KINDS = ("skill", "plugin-skill")
#: A name must be longer to count as named in a prompt.
LEAST_NAME = 3


def tokens(rows: DataFrame, text: Column, *keys: str) -> DataFrame:
    """(keys..., term): normalised tokens of a text and of the concepts that it stands for."""
    bridged = rows.select(*keys, F.explode(typed_concepts(text)).alias("_w")).where(~in_list("_w", V.STOP)).select(*keys, norm("_w").alias("term"))
    return token_rows(rows, text, *keys).unionByName(bridged)


def _generic(term: Column) -> Column:
    return term.isin([plain_norm(w) for w in V.GENERIC])


def mentioned(prompt: Column, name: Column, bare_generic: Column) -> Column:
    """Whether a prompt names an item. A name that is one generic word must be asked for: ``/name``, or use, run, invoke, skill before it."""
    low = F.lower(prompt)
    asked = low.contains(F.concat(F.lit("/"), name)) | F.regexp_like(low, F.concat(F.lit(r"(?U)\b(?:skill|use|run|invoke)\b[^.\n]{0,20}\Q"), name, F.lit(r"\E")))
    # the pattern is made for generic names only
    return (F.length(name) > LEAST_NAME) & low.contains(name) & F.when(bare_generic, asked).otherwise(True)


def mentions(items: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, item_id): prompts and the items that they name; they meet by the first letters of the name."""
    n = LEAST_NAME + 1
    heads = items.where(F.length("name") >= n).select("item_id", "name", "bare_generic", F.left("name", F.lit(n)).alias("head"))
    low = F.lower("prompt")
    grams = F.when(F.length(low) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda i: F.substring(low, i, F.lit(n)))))
    rows = queries.select("query_id", "prompt", F.explode(grams).alias("head")).join(heads, "head")
    return rows.where(mentioned(F.col("prompt"), F.col("name"), F.col("bare_generic"))).select("query_id", "item_id").distinct()


def _bits(term: Column) -> Column:
    """One bit for each ecosystem that a normalised term points to."""
    names = list(V.ECOSYSTEMS)
    known = {plain_norm(t): 1 << names.index(e) for e, ts in V.ECOSYSTEMS.items() for t in ts.split()}
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), term), F.lit(0))


@dataclass
class Index:
    """A catalogue: ``items`` (item_id, kind, name, about, aliases, terms, identity, length, bare_generic, eco) and ``posted`` (item_id, term, tf, in_name), both stored, and their number."""

    items: DataFrame
    posted: DataFrame
    n_items: DataFrame


@dataclass
class Lexical:
    """Prompts against a catalogue: ``terms`` (query_id, term) and ``asked`` (query_id, eco), ``hinted`` (query_id, item_id, term), ``scored`` (query_id, item_id, score, raw, rank), all stored."""

    terms: DataFrame
    asked: DataFrame
    hinted: DataFrame
    scored: DataFrame


def enriched(items: DataFrame) -> Index:
    """The index of ``items`` (item_id, kind, name, about, aliases). Alias terms that the text already has are not added again."""
    items = stored(items.withColumn("name", F.lower("name")))
    own = tokens(items, F.concat_ws(" ", "name", "about"), "item_id")
    alias = items.select("item_id", F.explode(F.split("aliases", " ")).alias("_w")).where("_w <> ''").select("item_id", norm("_w").alias("term")).distinct()
    every = own.unionByName(alias.join(own.distinct(), ["item_id", "term"], "left_anti"))
    names = tokens(items, F.col("name"), "item_id")
    by_name = names.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.first("term").alias("t"))
    bare = by_name.where((F.col("n") == 1) & _generic(F.col("t"))).select("item_id", F.lit(True).alias("bare_generic"))
    identity = names.unionByName(tokens(items, F.concat_ws(" ", "about", "aliases"), "item_id"))
    sets = every.groupBy("item_id").agg(F.collect_set("term").alias("terms"), F.count(F.lit(1)).alias("length"), F.bit_or(_bits(F.col("term"))).alias("eco"))
    sets = sets.join(identity.groupBy("item_id").agg(F.collect_set("term").alias("identity")), "item_id").join(bare, "item_id", "left")
    full = items.join(stored(sets), "item_id").withColumn("bare_generic", F.coalesce("bare_generic", F.lit(False)))
    posted = every.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("tf")).join(names.distinct().withColumn("in_name", F.lit(True)), ["item_id", "term"], "left")
    posted = posted.withColumn("in_name", F.coalesce("in_name", F.lit(False)))
    return Index(stored(full), stored(posted), stored(items.agg(F.count(F.lit(1)).alias("n"))))


def score(index: Index, queries: DataFrame, hints: DataFrame, learnt: DataFrame, stack: list[str]) -> Lexical:
    """Scores of every pair with a common term or hint.

    ``queries``: (query_id, prompt); ``hints``: (name, text); ``learnt``: (name, weight); ``stack``: normalised
    words of the project at hand. Pairs carry numbers only: what a text adds to them is looked up for the pairs
    that name an item, and terms (``hits``) for the pairs that are left in the end.
    """
    items, posted = index.items, index.posted
    q = stored(tokens(queries, F.col("prompt"), "query_id").distinct())
    corpus = items.agg(F.sum("length").alias("total")).crossJoin(index.n_items).select("n", (F.col("total") / F.col("n")).alias("avg_length"))
    df = posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.coalesce("df", F.lit(0)) + 0.5) / (F.coalesce("df", F.lit(0)) + 0.5))
    terms = q.join(df, "term", "left").crossJoin(F.broadcast(corpus)).withColumn("idf", idf * F.when(_generic(F.col("term")), GENERIC_DAMP).otherwise(1.0))  # one row is broadcast
    asked = stored(terms.groupBy("query_id").agg(F.greatest(F.sum("idf"), F.lit(1e-6)).alias("q_idf"), F.bit_or(_bits(F.col("term"))).alias("eco")))
    f = F.col("tf")
    # what a posting adds but for the query's weight
    weight = f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("avg_length"))) * F.when(F.col("in_name"), NAME_BOOST).otherwise(1.0)
    weighed = posted.join(items.select("item_id", "length"), "item_id").crossJoin(F.broadcast(corpus.select("avg_length"))).select("item_id", "term", weight.alias("part"))  # one row
    found = terms.where("df is not null").select("query_id", "term", "idf").join(weighed, "term")
    found = found.select("query_id", "item_id", (F.col("idf") * F.col("part")).alias("raw"), F.lit(0).alias("hints"))
    hinted = tokens(hints.withColumn("name", F.lower("name")), F.col("text"), "name").distinct().join(q, "term").join(items.select("item_id", "name"), "name")
    hinted = stored(hinted.select("query_id", "item_id", "term"))
    pairs = found.unionByName(hinted.select("query_id", "item_id", F.lit(0.0).alias("raw"), F.lit(1).alias("hints"))).groupBy("query_id", "item_id").agg(F.sum("raw").alias("raw"), F.sum("hints").alias("hints"))
    weights = learnt.groupBy(F.lower("name").alias("name")).agg(F.least(F.max("weight"), F.lit(2.0)).alias("weight"))
    here = posted.where(F.col("term").isin(stack)).groupBy("item_id").agg(F.least(F.count(F.lit(1)), F.lit(STACK_MOST)).alias("here"))
    extra = STACK * F.coalesce("here", F.lit(0)) + LEARNT * F.coalesce("weight", F.lit(0.0))
    extras = items.select("item_id", "name", F.col("eco").alias("item_eco")).join(weights, "name", "left").join(here, "item_id", "left").select("item_id", "item_eco", extra.alias("extra"))
    named = stored(mentions(items, queries)).withColumn("named", F.lit(MENTION))
    pairs = pairs.join(asked, "query_id").join(stored(extras), "item_id").join(named, ["query_id", "item_id"], "left")
    rel = F.col("raw") / F.col("q_idf") + F.least(HINT * F.col("hints"), F.lit(HINT_MOST)) + F.coalesce("named", F.lit(0.0)) + F.col("extra")
    own = sum({1 << list(V.ECOSYSTEMS).index(e) for e, ts in V.ECOSYSTEMS.items() if set(map(plain_norm, ts.split())) & set(stack)})
    ask = F.when(F.col("eco") > 0, F.col("eco")).otherwise(own)
    foreign = (ask > 0) & (F.col("item_eco") > 0) & (ask.bitwiseAND(F.col("item_eco")) == 0)
    scored = pairs.select("query_id", "item_id", F.round(F.when(foreign, rel * FOREIGN).otherwise(rel), 3).alias("score"), F.round("raw", 3).alias("raw"))
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")))
    return Lexical(q, asked.select("query_id", "eco"), hinted, stored(scored))


def hits(index: Index, lexical: Lexical, pairs: DataFrame) -> DataFrame:
    """(query_id, item_id, hits) of some pairs: their common terms, sorted, then up to three of their hints."""
    pairs = pairs.select("query_id", "item_id").distinct()
    common = pairs.join(lexical.terms, "query_id").join(index.posted.select("item_id", "term"), ["item_id", "term"])
    both = common.withColumn("hint", F.lit(False)).unionByName(pairs.join(lexical.hinted, ["query_id", "item_id"]).withColumn("hint", F.lit(True)))
    lists = both.groupBy("query_id", "item_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("hint") == hint, F.col("term")))).alias(n) for n, hint in (("c", False), ("h", True))))
    return lists.select("query_id", "item_id", F.concat("c", F.slice("h", 1, 3)).alias("hits"))


def fuse(index: Index, lexical: Lexical, nearest: DataFrame, queries: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(query_id, item_id, score, fused, dense_rank, wrong_ecosystem, adjective_only, rank): both lanes, all flags.

    ``nearest``: (query_id, item_id, rank). Queries without a nearest row keep their lexical rows, of any rank, as
    they are (fused is null there). Items that the prompt names come first. Half-way values round up.
    """
    alpha, w = min(max(alpha, 0.0), 1.0), Window.partitionBy("query_id")
    n, at = F.count(F.lit(1)).over(w), F.col("rank") - 1
    near = nearest.select("query_id", "item_id", at.alias("dense_rank"), F.when(n > 1, 1 - at / (n - 1)).otherwise(1.0).alias("near"), (DENSE_BONUS * (1 - at / n)).alias("bonus"))
    near = stored(near)
    lanes = near.select("query_id").distinct()
    head = lexical.scored.where(F.col("rank") <= DEPTH).join(lanes, "query_id", "left_semi")
    low, high = F.min("score").over(w), F.max("score").over(w)
    span = F.when(high - low < 1e-9, 1.0).otherwise(high - low)
    head = head.select("query_id", "item_id", F.col("score").alias("base"), ((F.col("score") - low) / span).alias("lex"))
    both = stored(head.join(near, ["query_id", "item_id"], "full_outer"))
    both = both.join(hits(index, lexical, both), ["query_id", "item_id"], "left").join(queries.select("query_id", "prompt"), "query_id").join(lexical.asked, "query_id", "left")
    both = both.join(index.items.select("item_id", "name", "bare_generic", "identity", F.col("eco").alias("item_eco")), "item_id")
    zero = F.lit(0.0)
    foreign = (F.col("eco") > 0) & (F.col("item_eco") > 0) & (F.col("eco").bitwiseAND(F.col("item_eco")) == 0)
    base = F.round(F.coalesce("base", zero) + F.coalesce("bonus", zero), 3)
    topical = F.exists("hits", lambda h: ~h.isin([plain_norm(x) for x in V.MANNER]) & F.array_contains("identity", h))
    rows = both.select(
        "query_id", "item_id", F.round(F.when(foreign, F.round(base * FOREIGN, 3)).otherwise(base), 3).alias("score"),
        F.round(alpha * F.coalesce("near", zero) + (1 - alpha) * F.coalesce("lex", zero) + 1e-9, 5).alias("fused"), F.col("dense_rank").cast("long").alias("dense_rank"),
        F.coalesce(foreign, F.lit(False)).alias("wrong_ecosystem"), F.coalesce((F.size("hits") > 0) & ~topical, F.lit(False)).alias("adjective_only"),
        mentioned(F.col("prompt"), F.col("name"), F.col("bare_generic")).alias("exact"), F.coalesce("bonus", zero).alias("bonus"),
    )
    place = F.row_number().over(w.orderBy(F.desc("exact"), F.desc("fused"), F.desc("bonus"), "item_id"))
    rows = rows.withColumn("rank", place).drop("exact", "bonus")
    bare = lexical.scored.join(lanes, "query_id", "left_anti").select(
        "query_id", "item_id", "score", F.lit(None).cast("double").alias("fused"), F.lit(None).cast("long").alias("dense_rank"), F.lit(False).alias("wrong_ecosystem"), F.lit(False).alias("adjective_only"), "rank")
    return rows.unionByName(bare)


def select(rows: DataFrame, main: int = 4, others: int = 3) -> DataFrame:
    """Rows above the floor and near the first of these, at most so many of the main kinds and of the others; adds pick.

    ``rows``: (query_id, kind, score, rank, ...).
    """
    w = Window.partitionBy("query_id")
    kept = rows.where(F.col("score") >= FLOOR).withColumn("lead", F.first("score").over(w.orderBy("rank"))).where(F.col("score") >= F.col("lead") * TAIL)
    is_main = F.col("kind").isin(*MAIN_KINDS)
    pick = F.row_number().over(Window.partitionBy("query_id", is_main).orderBy("rank"))
    return kept.withColumn("pick", pick).where(F.col("pick") <= F.when(is_main, main).otherwise(others)).drop("lead")


def combined(rows: DataFrame, counts: DataFrame, quota: int = 2) -> DataFrame:
    """n rows a query: quota rows of each other kind first, one place left to the main kinds, then main kinds, then the rest.

    ``rows``: (query_id, item_id, kind, score, rank); ``counts``: (query_id, n, topup). Where a number was asked for
    (topup), rows below the floor fill up what is missing. The order is by score in the end.
    """
    w = Window.partitionBy("query_id")
    rows = rows.join(counts, "query_id")
    above = F.col("score") >= FLOOR
    rows = rows.withColumn("lead", F.max(F.when(above, F.struct(-F.col("rank"), "score"))).over(w)["score"])
    is_main = F.col("kind").isin(*MAIN_KINDS)
    rows = rows.withColumn("main", above & is_main & (F.col("score") >= F.col("lead") * TAIL)).withColumn("other", above & ~is_main)
    kinds = Window.partitionBy("query_id", "kind", "other")
    rows = rows.withColumn("k", F.row_number().over(kinds.orderBy("rank"))).withColumn("first", F.min("rank").over(kinds)).withColumn("has", F.max(F.col("main").cast("int")).over(w))
    inside = F.col("other") & (F.col("k") <= quota)
    number = F.sum(inside.cast("int")).over(w.orderBy("first", "k", "rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("class", F.when(inside & (number <= F.col("n") - F.col("has")), 0).when(F.col("main"), 1).when(above, 2).when(F.col("topup"), 3))
    taken = rows.where("class is not null").withColumn("at", F.row_number().over(w.orderBy("class", F.when(F.col("class") == 0, F.col("first")), "rank"))).where("at <= n")
    return taken.withColumn("pick", F.row_number().over(w.orderBy(F.desc("score"), "rank"))).select("query_id", "item_id", "kind", "score", "rank", "pick")
