"""The best rows of a BM25 ranking without scoring every pair that shares a term.

The postings of a term are cut into blocks of items of like length, and each
block keeps the greatest part that the term adds to a score in it. From these
maxima follows, for a query and a block, the most that the terms after any term
can still add. With a threshold, a score that the wanted rows reach:

* terms, greatest bound first, are *open* in a block while they and all later
  ones can reach the threshold together; an item with none of the open terms
  cannot, so only the postings of open terms are read, and a block without any
  is skipped;
* the sums over open terms, plus the bound of the others, leave few pairs,
  whose other terms are then looked up by item.

The threshold of a top k is the k-th best score of the items with the best sums
over the rarest terms, which reads few postings, and then the k-th best sum over
the open terms. All of it is
joins and groupings of stored tables; no query and no term is gathered. Results
are those of the full ranking, ties included: scores are compared with a slack
for their rounding.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions import words
from ferrule.functions.text import token_rows
from ferrule.operators.retrieve import B, BROADCAST_ROWS, K1, NAME_BOOST, idf, ranked
from ferrule.sources.shared import stored

#: Blocks for each doubling of an item's length.
BLOCKS = 2
#: Postings of a query's rarest terms that give the first threshold.
SEEDS = 1000
#: Terms stay open below the threshold, down to this share of it: more postings are read, and fewer pairs are left.
OPEN = 0.5
#: Scores are rounded to four places of the share of a perfect match.
SLACK = 1.01e-4


@dataclass
class Corpus:
    """Postings (item_id, term, part, block) and query terms (query_id, term, idf, df), both stored, and (query_id, q_idf)."""

    posted: DataFrame
    terms: DataFrame
    totals: DataFrame


def counted(items: DataFrame, text: Column, terms: DataFrame) -> DataFrame:
    """(item_id, term, tf, length) of the given terms, stored; the null term holds the number of all terms of an item. The texts are read once.

    ``length`` is that number too; it is there only if items come once, since no task knows it of others.
    """
    asked = stored(terms.withColumnRenamed("term", "asked"))
    near = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    found = words.term_counts(items, text, "item_id", lengths=True).join(near, F.col("term") == F.col("asked"), "left")
    found = found.where("asked is not null or term is null").select("item_id", "term", F.col("n").alias("tf"), "length")
    return stored(found if words.comes_once(items, "item_id") else found.groupBy("item_id", "term").agg(F.sum("tf").alias("tf")))


def over_texts(items: DataFrame, text: Column, queries: DataFrame) -> Corpus:
    """The corpus of ``items`` (item_id, ...) for ``queries`` (query_id, text)."""
    asked = stored(token_rows(queries, F.col("text"), "query_id").distinct())
    counts = counted(items, text, asked.select("term").distinct())
    posted = counts.where("term is not null").withColumn("in_name", F.lit(False))
    return corpus(asked, posted, counts.where("term is null and tf > 0").select("item_id", F.col("tf").alias("length")), items.agg(F.count(F.lit(1)).alias("n")))


def corpus(asked: DataFrame, posted: DataFrame, lengths: DataFrame, n_items: DataFrame) -> Corpus:
    """From query terms (query_id, term), postings (item_id, term, tf, in_name), (item_id, length) and one row (n).

    Postings that hold the ``length`` of their item are not joined with the lengths.
    """
    size = lengths.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("total")).crossJoin(n_items).select("n", (F.col("total") / F.greatest("n", F.lit(1))).alias("avg_length"))
    f = F.col("tf")
    part = f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("avg_length"))) * F.when(F.col("in_name"), NAME_BOOST).otherwise(1.0)
    held = posted.where("item_id is not null") if "length" in posted.columns else posted.join(lengths, "item_id")
    rows = held.crossJoin(F.broadcast(size.select("avg_length")))  # one row
    rows = stored(rows.select("item_id", "term", part.alias("part"), F.floor(BLOCKS * F.log2(F.col("length").cast("double"))).cast("int").alias("block")))
    stats = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = asked.join(stats, "term", "left").crossJoin(F.broadcast(size.select("n")))  # one row
    terms = terms.withColumn("df", F.coalesce("df", F.lit(0)))
    terms = stored(terms.select("query_id", "term", "df", idf(F.col("n"), F.col("df"), F.col("term")).alias("idf")))
    return Corpus(rows, terms.where("df > 0"), terms.groupBy("query_id").agg(F.greatest(F.sum("idf"), F.lit(1e-6)).alias("q_idf")))


def bounds(c: Corpus) -> DataFrame:
    """(query_id, block, term, idf, n, bound, after): the most a term adds in a block, and the terms of lesser bound after it together."""
    most = c.posted.groupBy("term", "block").agg(F.max("part").alias("most"), F.count(F.lit(1)).alias("n"))
    rows = c.terms.join(most, "term").select("query_id", "block", "term", "idf", "n", (F.col("idf") * F.col("most")).alias("bound"))
    later = Window.partitionBy("query_id", "block").orderBy(F.desc("bound"), "term").rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn("after", F.coalesce(F.sum("bound").over(later), F.lit(0.0)))


def seeds(c: Corpus, k: int) -> DataFrame:
    """(query_id, least): a score that k items reach; queries whose rarest terms have fewer items have no row."""
    before = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    rare = c.terms.withColumn("before", F.coalesce(F.sum("df").over(before), F.lit(0))).where(F.col("before") < max(SEEDS, 4 * k))
    sums = rare.join(c.posted, "term").groupBy("query_id", "item_id").agg(F.sum(F.col("idf") * F.col("part")).alias("sum"))
    # the whole scores of a few good items
    return _kth(_raw(c, ranked(sums, 2 * k, "sum").select("query_id", "item_id")).withColumnRenamed("raw", "sum"), k)


def _raw(c: Corpus, pairs: DataFrame) -> DataFrame:
    rows = pairs.join(c.terms, "query_id").join(c.posted.select("item_id", "term", "part"), ["item_id", "term"])
    return rows.groupBy("query_id", "item_id").agg(F.sum(F.col("idf") * F.col("part")).alias("raw"))


def _kth(sums: DataFrame, k: int) -> DataFrame:
    best = ranked(sums.select("query_id", "item_id", "sum"), k, "sum")
    return best.where(F.col("rank") == k).select("query_id", F.col("sum").alias("least"))


def opened(c: Corpus, held: DataFrame, least: DataFrame) -> DataFrame:
    """The rows of ``bounds`` with ``open`` and ``enough``, the score to reach less the slack."""
    aim = c.totals.join(least, "query_id", "left").select("query_id", (F.coalesce("least", F.lit(0.0)) - SLACK * F.col("q_idf")).alias("enough"))
    return held.join(aim, "query_id").withColumn("open", F.col("bound") + F.col("after") >= OPEN * F.col("enough"))


def at_least(c: Corpus, least: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, item_id, score) of the pairs that reach a query's score ``least`` (query_id, least), not yet a share of the perfect match.

    Queries without a row take every pair. With k, only what can be among the k best need be there.
    """
    parts = stored(opened(c, bounds(c), least))
    here = parts.where("open").select("query_id", "block", "term", "idf").join(c.posted, ["term", "block"])
    sums = here.groupBy("query_id", "block", "item_id").agg(F.sum(F.col("idf") * F.col("part")).alias("sum"))
    closed = parts.where("not open")
    more = closed.groupBy("query_id", "block").agg(F.sum("bound").alias("more"))
    aims = parts.groupBy("query_id").agg(F.max("enough").alias("enough"))
    if k is not None:
        sums = stored(sums)
        kth = _kth(sums, k).join(c.totals, "query_id").select("query_id", (F.col("least") - SLACK * F.col("q_idf")).alias("kth"))
        aims = aims.join(kth, "query_id", "left").select("query_id", F.greatest("enough", "kth").alias("enough"))
    left = sums.join(more, ["query_id", "block"], "left").join(aims, "query_id")
    left = stored(left.where(F.col("sum") + F.coalesce("more", F.lit(0.0)) >= F.col("enough")).select("query_id", "block", "item_id", "sum"))
    # only the postings of items that are left
    theirs = c.posted.join(left.select("item_id").distinct(), "item_id", "left_semi").select("item_id", "term", "part")
    rest = left.select("query_id", "block", "item_id").join(closed.select("query_id", "block", "term", "idf"), ["query_id", "block"]).join(theirs, ["item_id", "term"])
    both = left.select("query_id", "item_id", "sum").unionByName(rest.select("query_id", "item_id", (F.col("idf") * F.col("part")).alias("sum")))
    raw = both.groupBy("query_id", "item_id").agg(F.sum("sum").alias("raw"))
    return raw.join(c.totals, "query_id").select("query_id", "item_id", F.round(F.col("raw") / F.col("q_idf"), 4).alias("score"))


def top(c: Corpus, k: int) -> DataFrame:
    """(query_id, item_id, score, rank): the k best items of each query, ties by item_id."""
    return ranked(at_least(c, seeds(c, k), k), k)


def of_pairs(c: Corpus, pairs: DataFrame) -> DataFrame:
    """(query_id, item_id, score) of given pairs (query_id, item_id); those without a common term are not there."""
    raw = _raw(c, pairs).join(c.totals, "query_id")
    return raw.select("query_id", "item_id", F.round(F.col("raw") / F.col("q_idf"), 4).alias("score"))


def first_ranks(c: Corpus, gold: DataFrame) -> DataFrame:
    """(query_id, item_id, score, rank): of a query's given pairs (query_id, item_id) the best, with its rank in the whole ranking.

    The ranking is not made: the rank is one more than the number of rows that come before, counted within tasks first,
    and rows that score less than the pair are not looked at.
    """
    order = F.struct((-F.col("score")).alias("s"), F.col("item_id").alias("i"))
    best = of_pairs(c, gold.select("query_id", "item_id").distinct()).groupBy("query_id").agg(F.min(order).alias("best"))
    best = stored(best.select("query_id", F.col("best.i").alias("item_id"), (-F.col("best.s")).alias("score")))
    least = best.join(c.totals, "query_id").select("query_id", (F.col("score") * F.col("q_idf")).alias("least"))
    above = at_least(Corpus(c.posted, c.terms.join(least, "query_id", "left_semi"), c.totals), least)
    own = best.select("query_id", F.struct((-F.col("score")).alias("s"), F.col("item_id").alias("i")).alias("own"))
    before = above.join(own, "query_id").groupBy("query_id").agg(F.count_if(order < F.col("own")).alias("n"))
    return best.join(before, "query_id", "left").select("query_id", "item_id", "score", (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("rank"))
