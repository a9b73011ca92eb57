"""Ranking: postings, BM25 with name boost, cosine lane, fusion.

All queries are ranked in one plan. ``bm25`` scores every pair with a common
term, for postings of small catalogues; ``search`` finds the best ones of large
ones. The cosine lane is that of ``knn``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions import words
from ferrule.functions.text import plain_norm, token_rows
from ferrule.functions.vocab import GENERIC
from ferrule.operators import knn

K1, B, NAME_BOOST, GENERIC_DAMP = 1.2, 0.6, 2.5, 0.4
DEPTH, ALPHA, DENSE_BONUS = 50, 0.5, 0.35
#: Spellings of query terms that may be broadcast, about 50 MB.
BROADCAST_ROWS = 1_000_000


def postings(items: DataFrame, text: Column, name: Column | None = None) -> DataFrame:
    """(item_id, term, tf, in_name)."""
    counts = words.term_counts(items, text, "item_id").groupBy("item_id", "term").agg(F.sum("n").alias("tf"))
    if name is None:
        return counts.withColumn("in_name", F.lit(False))
    names = token_rows(items, name, "item_id").distinct().withColumn("in_name", F.lit(True))
    return counts.join(names, ["item_id", "term"], "left").withColumn("in_name", F.coalesce("in_name", F.lit(False)))


def idf(n: Column, df: Column, term: Column) -> Column:
    generic = F.array_contains(F.split(F.lit(" ".join(map(plain_norm, GENERIC))), " "), term)
    value = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return F.when(generic, value * GENERIC_DAMP).otherwise(value)


def bm25(posted: DataFrame, queries: DataFrame, n_items: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """(query_id, item_id, score): relative to a perfect match, unknown query terms included.

    ``queries``: (query_id, text). ``n_items``: one row (n), the number of items with or without tokens.
    ``copies``: (item_id, copies) where an item stands for several.
    """
    lengths = posted.groupBy("item_id").agg(F.sum("tf").alias("length"))
    if copies is None:
        stats = posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        lengths = lengths.withColumn("copies", F.lit(1))
    else:
        stats = posted.join(copies, "item_id").groupBy("term").agg(F.sum("copies").alias("df"))
        lengths = lengths.join(copies, "item_id")
    q = token_rows(queries, F.col("text"), "query_id").distinct()
    return _scored(q, posted, stats, lengths, n_items)


def _scored(q: DataFrame, posted: DataFrame, stats: DataFrame, lengths: DataFrame, n_items: DataFrame) -> DataFrame:
    corpus = lengths.agg(F.sum(F.col("length") * F.col("copies")).alias("total")).crossJoin(n_items).select("n", (F.col("total") / F.col("n")).alias("avg_length"))
    terms = q.join(stats, "term", "left").crossJoin(F.broadcast(corpus))  # one row
    terms = terms.withColumn("idf", idf(F.col("n"), F.coalesce("df", F.lit(0)), F.col("term")))
    total = terms.groupBy("query_id").agg(F.sum("idf").alias("q_idf"))
    found = terms.where("df is not null").join(posted, "term").join(lengths, "item_id")
    f = F.col("tf")
    part = F.col("idf") * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("length") / F.col("avg_length"))) * F.when(F.col("in_name"), NAME_BOOST).otherwise(1.0)
    raw = found.groupBy("query_id", "item_id").agg(F.sum(part).alias("raw"))
    return raw.join(total, "query_id").select("query_id", "item_id", F.round(F.col("raw") / F.greatest("q_idf", F.lit(1e-6)), 4).alias("score"))


def ranked(rows: DataFrame, k: int | None = None, score: str = "score") -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "item_id"))
    out = rows.withColumn("rank", place)
    return out if k is None else out.where(F.col("rank") <= k)


def unit(v: Column) -> Column:
    v = F.transform(v, lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(v)


def dense(vectors: DataFrame, queries: DataFrame, k: int = DEPTH) -> DataFrame:
    """(query_id, item_id, cosine, rank): the k nearest items (item_id, vector) of each query (query_id, vector), ties by item_id."""
    return knn.nearest(vectors, queries, k)[0]


def fuse(lexical: DataFrame, nearest: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(query_id, item_id, fused, score, rank) of the union of both lanes' top rows.

    ``lexical``: (query_id, item_id, score, rank); ``nearest``: (query_id, item_id, rank). Scores of the
    lexical lane are scaled to [0, 1] by query; the other lane counts by rank.
    """
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    span = F.when(high - low < 1e-9, 1.0).otherwise(high - low)
    a = lexical.select("query_id", "item_id", F.col("score").alias("base"), ((F.col("score") - low) / span).alias("lex"))
    n = F.count(F.lit(1)).over(w)
    at = F.col("rank") - 1
    b = nearest.select("query_id", "item_id", F.when(n > 1, 1 - at / (n - 1)).otherwise(1.0).alias("near"), (DENSE_BONUS * (1 - at / n)).alias("bonus"))
    both = a.join(b, ["query_id", "item_id"], "full_outer")
    zero = F.lit(0.0)
    fused = F.round(alpha * F.coalesce("near", zero) + (1 - alpha) * F.coalesce("lex", zero), 5)
    score = F.round(F.coalesce("base", zero) + F.coalesce("bonus", zero), 4)
    return ranked(both.select("query_id", "item_id", fused.alias("fused"), score.alias("score")), None, "fused")
