"""Choosing results from a ranking: floor, tail ratio, score cliff, quota, diversity, rerank gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FLOOR, TAIL, DROP, CLIFF_ROWS = 0.28, 0.55, 0.35, 15
#: Rerank gate: a lead that is not questioned, odds enough alone, odds and margin enough together, score a pick must have.
LEAD, SURE, MARGIN, FAIR, LEAST = 1.6, 0.75, 0.02, 1.2, 0.6


def _by_rank():
    return Window.partitionBy("query_id").orderBy("rank")


def floor_and_tail(rows: DataFrame, floor: float = FLOOR, tail: float = TAIL) -> DataFrame:
    """Rows at or above the floor and at or above a share of the leader's score."""
    led = rows.withColumn("leader", F.max("score").over(Window.partitionBy("query_id")))
    return led.where((F.col("score") >= floor) & (F.col("score") >= F.col("leader") * tail)).drop("leader")


def cliff(rows: DataFrame) -> DataFrame:
    """Rows down to the first after the largest relative drop above ``DROP`` among the first rows; all without one."""
    before = F.lag("score").over(_by_rank())
    drop = F.when((F.col("rank") <= CLIFF_ROWS) & (before > 0), (before - F.col("score")) / before)
    seen = rows.withColumn("drop", drop)
    by_query = seen.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("score", F.struct("drop", -F.col("rank"))).alias("edge"), F.max("drop").alias("most"))
    cut = by_query.select("query_id", F.when((F.col("n") >= 3) & (F.col("most") > DROP), F.col("edge")).alias("edge"))
    return rows.join(cut, "query_id").where(F.col("edge").isNull() | (F.col("score") >= F.col("edge"))).drop("edge")


def quota(rows: DataFrame, each: int = 2, n: int = 10, main_kind: str = "main") -> DataFrame:
    """n rows a query: first up to ``each`` of every kind but the main one (one place is left to it if it
    has rows), then the main kind, then others; by score in the end."""
    w = Window.partitionBy("query_id")
    place = F.row_number().over(Window.partitionBy("query_id", "kind").orderBy(F.desc("score"), "rank"))
    first = F.min("rank").over(Window.partitionBy("query_id", "kind"))
    has_main = F.max((F.col("kind") == main_kind).cast("int")).over(w)
    rows = rows.select("*", place.alias("_place"), first.alias("_first"), has_main.alias("_main"))
    in_quota = (F.col("kind") != main_kind) & (F.col("_place") <= each)
    number = F.sum(in_quota.cast("int")).over(w.orderBy("_first", "_place", "rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_class", F.when(in_quota & (number <= n - F.col("_main")), 0).when(F.col("kind") == main_kind, 1).otherwise(2))
    taken = rows.withColumn("_n", F.row_number().over(w.orderBy("_class", F.desc("score"), "rank"))).where(F.col("_n") <= n)
    return taken.withColumn("pick", F.row_number().over(w.orderBy(F.desc("score"), "rank"))).drop("_place", "_first", "_main", "_class", "_n")


def diversify(rows: DataFrame, most: float = 0.85, keep: int = 2) -> DataFrame:
    """Greedy by rank: a row goes if its tokens overlap too much with a kept row's; of up to ``keep`` rows all stay, of more at least so many.

    ``rows``: (query_id, item_id, rank, tokens), few for each query.
    """
    listed = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "item_id", "tokens"))).alias("rows"))

    def close(a, b):
        return (F.size(F.array_union(a, b)) > 0) & (F.size(F.array_intersect(a, b)) >= most * F.size(F.array_union(a, b)))

    def step(kept, row):
        near = F.exists(kept, lambda k: close(k["tokens"], row["tokens"]))
        return F.when(near, kept).otherwise(F.concat(kept, F.array(row)))

    start = F.filter("rows", lambda r: F.lit(False))
    chosen = listed.select("query_id", "rows", F.aggregate("rows", start, step).alias("kept"))
    enough = F.when(F.size("rows") <= keep, F.col("rows")).when(F.size("kept") < keep, F.slice("rows", 1, keep)).otherwise(F.col("kept"))
    return chosen.select("query_id", F.inline(enough)).select("query_id", "item_id", "rank")


def rerank(rows: DataFrame, odds: DataFrame, n: int = 5) -> DataFrame:
    """``rows`` with gate and place: the pick of an outside model goes first if its odds and its own score allow.

    ``rows``: (query_id, item_id, score, rank); ``odds``: (query_id, item_id, p), a row each; missing odds
    are 0. Only the first n rows of a query are in question. Gates: clear (the leader is far ahead, or
    alone), unsure (the odds are too even), weak (the pick scores too low), moved.
    """
    head = rows.where(F.col("rank") <= n).join(odds, ["query_id", "item_id"], "left")
    p = F.coalesce("p", F.lit(0.0))
    # at most n rows a query are gathered
    g = head.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct((-p).alias("p"), "rank", "score"))).alias("l"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s0"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s1"),
    )
    g = g.select("query_id", "s0", "s1", F.size("l").alias("n"), F.get("l", F.lit(0)).alias("a"), F.get("l", F.lit(1)).alias("b"))
    best = -F.col("a.p")
    sure = (best >= SURE) | ((best + F.col("b.p") >= MARGIN) & (best >= FAIR / F.greatest(F.col("n"), F.lit(2))))
    gate = F.when((F.col("n") < 2) | (F.col("s0") >= LEAD * F.col("s1")), "clear").when(~sure, "unsure").when(F.col("a.score") < LEAST * F.col("s0"), "weak").otherwise("moved")
    g = g.select("query_id", gate.alias("gate"), F.col("a.rank").alias("_pick"))
    rank = F.col("rank")
    place = F.when(F.col("gate") != "moved", rank).when(rank == F.col("_pick"), 1).when(rank < F.col("_pick"), rank + 1).otherwise(rank)
    return rows.join(g, "query_id").withColumn("place", place).drop("_pick")
