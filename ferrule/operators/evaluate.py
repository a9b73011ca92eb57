"""Quality of rankings: recall, reciprocal rank, nDCG, abstention, spread over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 10)


def per_query(queries: DataFrame, gold: DataFrame, ranking: DataFrame, picks: DataFrame) -> DataFrame:
    """(query_id, n_labels, ranks, abstained): ranks of a query's labels in its whole ranking."""
    labels = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_labels"))
    found = gold.join(ranking.select("query_id", "item_id", "rank"), ["query_id", "item_id"]).groupBy("query_id").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    picked = picks.select("query_id").distinct().withColumn("picked", F.lit(True))
    rows = queries.select("query_id").join(labels, "query_id", "left").join(found, "query_id", "left").join(picked, "query_id", "left")
    return rows.select("query_id", F.coalesce("n_labels", F.lit(0)).alias("n_labels"), F.coalesce("ranks", F.array().cast("array<int>")).alias("ranks"), F.col("picked").isNull().alias("abstained"))


def ranks(rows: DataFrame, gold: DataFrame, *by: str) -> DataFrame:
    """(by..., query_id, rank): ranks of gold pairs (query_id, item_id) in rows (by..., query_id, item_id, rank).

    Kept are ranks up to the last cut and each query's first: no more enters a score, however many pairs there are.
    """
    found = rows.join(gold, ["query_id", "item_id"]).select(*by, "query_id", "rank")
    first = found.groupBy(*by, "query_id").agg(F.min("rank").alias("rank")).where(F.col("rank") > CUTS[-1])
    return found.where(F.col("rank") <= CUTS[-1]).unionByName(first)


def scores(rows: DataFrame, by: str | None = None, *more: Column) -> DataFrame:
    """A row of means (for each value of ``by``): over queries with labels for ranks, over those without for abstention."""
    positive = F.col("n_labels") > 0
    first = F.try_element_at("ranks", F.lit(1))
    dcg = F.aggregate(F.filter("ranks", lambda r: r <= 10), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest("n_labels", F.lit(1)), F.lit(10)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    mean = lambda x: F.round(F.avg(F.when(positive, x)), 4)
    hit = lambda k: F.coalesce((first <= k).cast("double"), F.lit(0.0))
    return (rows.groupBy(by) if by else rows.groupBy()).agg(
        *(mean(hit(k)).alias(f"recall_{k}") for k in CUTS), mean(F.coalesce(1 / first, F.lit(0.0))).alias("mrr"), mean(dcg / ideal).alias("ndcg_10"),
        F.round(F.avg(F.when(~positive, F.col("abstained").cast("double"))), 4).alias("abstain_precision"),
        F.count_if(positive).alias("n_positive"), F.count_if(~positive).alias("n_negative"), *more,
    )
