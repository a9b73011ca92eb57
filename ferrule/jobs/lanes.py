"""Four ways of ranking the catalogue, scored on the gold set: words, vectors, both, and both with a second look."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.jobs import catalogue, derived, lifecycle
from ferrule.operators import catalogue as C
from ferrule.operators import choose, evaluate
from ferrule.sources.shared import stored

LANES = ("bm25", "dense", "fused", "fused_rerank")
PICKS, RERANKED = 10, 5


def _lanes(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gold prompts (query_id, prompt, labels), items, and (lane, query_id, item_id, kind, score, rank) with (lane, query_id, degraded)."""
    gold = stored(lifecycle._gold(spark, d).where("label_status <> 'stale'").select(F.col("ord").alias("query_id"), "prompt", "labels"))
    own, hints, _ = catalogue.index(spark, d)
    queries = gold.select("query_id", "prompt")
    none = spark.createDataFrame([], "name string, weight double")  # what was learnt does not count
    lexical = C.score(own, queries, hints, none, [])
    near = stored(catalogue.nearest(spark, d, own, queries))
    fused = stored(C.fuse(own, lexical, near, queries))
    w = Window.partitionBy("query_id")
    dense = near.select("query_id", "item_id", F.round(1 - (F.col("rank") - 1) / F.count(F.lit(1)).over(w), 4).alias("score"), "rank")
    # the second look: shares of the cosines of the first rows
    head = fused.where(F.col("rank") <= RERANKED).join(near.select("query_id", "item_id", F.greatest("cosine", F.lit(0.0)).alias("c")), ["query_id", "item_id"])
    total = F.sum("c").over(w)
    odds = head.select("query_id", "item_id", F.round(F.when(total > 0, F.col("c") / total).otherwise(0.0), 4).alias("p"))
    again = choose.rerank(fused.select("query_id", "item_id", "score", "rank"), odds, RERANKED)
    rows = None
    for lane, found in (("bm25", lexical.scored), ("dense", dense), ("fused", fused), ("fused_rerank", again.drop("rank").withColumnRenamed("place", "rank"))):
        found = found.select(F.lit(lane).alias("lane"), "query_id", "item_id", "score", F.col("rank").cast("int").alias("rank"))
        rows = found if rows is None else rows.unionByName(found)
    return gold, own.items, stored(rows), stored(near.select("query_id").distinct())


def score_lanes(spark, d):
    """Each lane's quality, and whether it answered for itself: a query without a vector leaves the others to the words."""
    gold, items, rows, answered = _lanes(spark, d)
    labels = gold.select("query_id", F.explode("labels").alias("name")).join(items.select("item_id", "name"), "name").select("query_id", "item_id").distinct()
    ranks = evaluate.ranks(rows, labels, "lane")
    counts = gold.select("query_id", F.lit(PICKS).alias("n"), F.lit(False).alias("topup"))
    # a lane's queries stand side by side
    key = F.struct("lane", "query_id")
    kinds = rows.join(items.select("item_id", "kind"), "item_id").select(key.alias("query_id"), "item_id", "kind", "score", "rank")
    lanes = spark.createDataFrame([(x,) for x in LANES], "lane string")
    asked = gold.select("query_id", F.size("labels").alias("n_labels")).crossJoin(F.broadcast(lanes))  # four rows
    picks = C.combined(kinds, counts.crossJoin(F.broadcast(lanes)).select(key.alias("query_id"), "n", "topup")).select("query_id.*").distinct().withColumn("picked", F.lit(True))
    found = ranks.groupBy("lane", "query_id").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    each = asked.join(found, ["lane", "query_id"], "left").join(picks, ["lane", "query_id"], "left").join(answered.withColumn("near", F.lit(True)), "query_id", "left")
    each = each.select("lane", "n_labels", F.coalesce("ranks", F.array().cast("array<int>")).alias("ranks"), F.col("picked").isNull().alias("abstained"), ((F.col("lane") != "bm25") & F.col("near").isNull()).alias("degraded"))
    scored = evaluate.scores(stored(each), "lane", F.count_if("degraded").alias("lane_degraded"), (F.count_if("degraded") == 0).alias("lane_healthy"))
    return scored.withColumn("false_pick_rate", F.round(1 - F.col("abstain_precision"), 4))


_GOLD = lifecycle._G.replace("WITH gr AS", "gr AS").replace("nm AS (", "gnm AS (").replace("FROM nm", "FROM gnm").strip()
_SQL = catalogue._FUSE.replace(f"queries AS ({derived.QUERIES})", _GOLD + ", queries AS (SELECT ord AS query_id, prompt FROM gf WHERE label_status <> 'stale')").replace("list_contains(st", "list_contains(st")
# nothing learnt, no project
_SQL = _SQL.replace("lt AS (SELECT name,", "lt AS (SELECT name, 0.0::DOUBLE AS weight FROM items WHERE false), lt0 AS (SELECT name,").replace("WHERE term IN ('react', 'docker', 'fix')", "WHERE false").replace("coalesce(qe, ['javascript']) AS ask", "qe AS ask")
_SQL += """, dq AS (SELECT DISTINCT query_id FROM nr), nd AS (SELECT query_id, count(*) AS n FROM nr GROUP BY query_id),
h5 AS (SELECT fz.query_id, fz.item_id, fz.rank, fz.score, greatest(cosine, 0) AS c FROM fz LEFT JOIN (SELECT nr.query_id, nr.item_id, cosine FROM nr JOIN dc USING (query_id, item_id)) USING (query_id, item_id) WHERE rank <= 5),
p5 AS (SELECT *, CASE WHEN sum(c) OVER (PARTITION BY query_id) > 0 THEN coalesce(round(c / sum(c) OVER (PARTITION BY query_id), 4), 0) ELSE 0 END AS p FROM h5),
ga AS (SELECT query_id, count(*) AS n, max(score) FILTER (rank = 1) AS s0, max(score) FILTER (rank = 2) AS s1, list(struct_pack(p := p, rank := rank, score := score) ORDER BY p DESC, rank) AS l FROM p5 GROUP BY query_id),
gt AS (SELECT query_id, l[1].rank AS pick, CASE WHEN n < 2 OR s0 >= 1.6::DOUBLE * s1 THEN 'clear' WHEN NOT (l[1].p >= 0.75::DOUBLE OR (l[1].p - l[2].p >= 0.02::DOUBLE AND l[1].p >= 1.2::DOUBLE / greatest(n, 2))) THEN 'unsure' WHEN l[1].score < 0.6::DOUBLE * s0 THEN 'weak' ELSE 'moved' END AS gate FROM ga),
la AS MATERIALIZED (SELECT 'bm25' AS lane, query_id, item_id, score, rank FROM scr UNION ALL SELECT 'dense', query_id, item_id, round(1 - dense_rank::DOUBLE / n, 4), dense_rank + 1 FROM nr JOIN nd USING (query_id) UNION ALL SELECT 'fused', query_id, item_id, score, rank FROM fz
  UNION ALL SELECT 'fused_rerank', query_id, item_id, score, CASE WHEN gate <> 'moved' THEN rank WHEN rank = pick THEN 1 WHEN rank < pick THEN rank + 1 ELSE rank END FROM fz JOIN gt USING (query_id)),
gi AS (SELECT DISTINCT query_id, item_id FROM (SELECT ord AS query_id, unnest(labels) AS name FROM gf WHERE label_status <> 'stale') JOIN items USING (name)),
rk AS (SELECT lane, query_id, min(rank) AS r1, sum(1 / log2(rank + 1.0::DOUBLE)) FILTER (rank <= 10) AS dcg FROM la JOIN gi USING (query_id, item_id) GROUP BY ALL),
r0 AS (SELECT lane, query_id, item_id, kind, score, rank, score >= 0.28::DOUBLE AS above FROM la JOIN items USING (item_id)),
pk AS (SELECT DISTINCT lane, query_id FROM r0 WHERE above),
ln4 AS (SELECT unnest(['bm25', 'dense', 'fused', 'fused_rerank']) AS lane),
pq AS (SELECT ln4.lane, g.ord AS query_id, len(labels) AS n, r1, coalesce(dcg, 0) AS dcg, list_sum(list_transform(range(1, least(greatest(len(labels), 1), 10) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE))) AS ideal, pk.query_id IS NULL AS abstained, ln4.lane <> 'bm25' AND dq.query_id IS NULL AS degraded
  FROM ln4 JOIN gf g ON label_status <> 'stale' LEFT JOIN rk ON rk.lane = ln4.lane AND rk.query_id = g.ord LEFT JOIN pk ON pk.lane = ln4.lane AND pk.query_id = g.ord LEFT JOIN dq ON dq.query_id = g.ord)
SELECT lane, round(avg(coalesce((r1 <= 1)::INT, 0)) FILTER (n > 0), 4) AS recall_1, round(avg(coalesce((r1 <= 3)::INT, 0)) FILTER (n > 0), 4) AS recall_3, round(avg(coalesce((r1 <= 5)::INT, 0)) FILTER (n > 0), 4) AS recall_5,
  round(avg(coalesce((r1 <= 10)::INT, 0)) FILTER (n > 0), 4) AS recall_10, round(avg(coalesce(1.0::DOUBLE / r1, 0)) FILTER (n > 0), 4) AS mrr, round(avg(dcg / ideal) FILTER (n > 0), 4) AS ndcg_10,
  round(avg(abstained::INT) FILTER (n = 0), 4) AS abstain_precision, count(*) FILTER (n > 0) AS n_positive, count(*) FILTER (n = 0) AS n_negative,
  count(*) FILTER (degraded) AS lane_degraded, count(*) FILTER (degraded) = 0 AS lane_healthy, round(1 - round(avg(abstained::INT) FILTER (n = 0), 4), 4) AS false_pick_rate FROM pq GROUP BY lane"""

QUERIES = {"score_lanes": (score_lanes, _SQL)}
