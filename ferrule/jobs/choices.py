"""Jobs on decisions: rerank gate, open questions, replies, preferences, merged and re-keyed rows, expiry, links."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ferrule.functions import text as X
from ferrule.functions import vocab as V
from ferrule.jobs import ranking
from ferrule.operators import choose, retrieve
from ferrule.sources.shared import stored
from ferrule.sources.tables import table

KEPT_SECONDS = 12 * 3600


def rerank_gate(spark, d):
    """The ranking with a second lane's pick at the front where the gate lets it: shares of the cosines are the odds."""
    found = ranking.topk(spark, d, 10)
    vectors = table(spark, d, "embeddings").select("vec_id", retrieve.unit(F.col("embedding")).alias("v"))
    near = found.where("rank <= 5").join(vectors.select(F.col("vec_id").alias("item_id"), "v"), "item_id")
    near = near.join(vectors.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    cosine = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    near = near.select("query_id", "item_id", F.greatest(F.round(cosine, 4), F.lit(0.0)).alias("c"))
    total = F.sum("c").over(Window.partitionBy("query_id"))
    odds = near.select("query_id", "item_id", F.round(F.when(total > 0, F.col("c") / total).otherwise(0.0), 4).alias("p"))
    return choose.rerank(found, odds).select("query_id", "item_id", "score", "rank", "gate", "place")


def open_questions(spark, d, gap=0.15):
    """Queries to ask about: both lanes lead with different items, or the first two scores are close, and nobody judged the leader."""
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    found = stored(ranking.topk(spark, d, 50))  # of both lanes
    lexical = found.where("rank <= 2").groupBy("query_id").agg(at(1, "item_id").alias("bm25_top"), at(1, "score").alias("s0"), at(2, "score").alias("s1"))
    offered = ranking.fused(spark, d, found).where("rank <= 3").groupBy("query_id").agg(at(1, "item_id").alias("fused_top"), F.sort_array(F.collect_list(F.struct("rank", "item_id"))).alias("l"))
    judged = table(spark, d, "labels").select(F.col("doc_id").alias("bm25_top")).distinct()
    rows = lexical.where("s0 > 0").join(offered, "query_id").join(judged, "bm25_top", "left_anti")
    rows = rows.withColumn("gap", F.round((F.col("s0") - F.coalesce("s1", F.lit(0.0))) / F.col("s0"), 4))
    rows = rows.where((F.col("bm25_top") != F.col("fused_top")) | (F.col("gap") < gap))
    return rows.select("query_id", "bm25_top", "fused_top", "gap", F.array_join(F.transform("l", lambda x: x["item_id"].cast("string")), ",").alias("offered"))


def replies(spark, d):
    """What a user's reply chooses of the first three long words that the assistant's turn before it offers.

    A name in the reply wins, the first offered of several; yes without no takes the first offer; else null.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    rows = rows.withColumn("reply", F.lead("text").over(w)).withColumn("who", F.lead("role").over(w)).where("role = 'assistant' and who = 'user'")
    names = F.slice(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]{6,}"), F.lit(0))), 1, 3)
    rows = rows.select("conv_id", "turn", names.alias("names"), "reply", F.concat(F.lit(" "), F.regexp_replace("reply", r"[^\p{L}\p{N}_]+", " "), F.lit(" ")).alias("words"))
    named = F.filter("names", lambda n: F.contains(F.col("words"), F.concat(F.lit(" "), n, F.lit(" "))))
    first = F.when(F.col("reply").rlike(f"(?U){V.YES}") & ~F.col("reply").rlike(f"(?U){V.NO}"), F.get("names", F.lit(0)))
    return rows.select("conv_id", "turn", F.array_join("names", ",").alias("offered"), F.coalesce(F.get(named, F.lit(0)), first).alias("preferred"))


def preferred_pairs(spark, d):
    """The best-ranked item of good quality and each item ranked above it, with the weight of its place (0 is the first)."""
    found = ranking.topk(spark, d, 10)
    good = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("item_id")).distinct()
    liked = found.join(good, "item_id").groupBy("query_id").agg(F.min(F.struct("rank", "item_id")).alias("m"))
    liked = liked.select("query_id", F.col("m.item_id").alias("preferred"), (F.col("m.rank") - 1).alias("led_by")).where("led_by > 0")
    above = found.join(liked, "query_id").where("rank <= led_by")
    weight = F.round(1 / (1 + F.log2(1 + F.col("led_by").cast("double"))), 4)
    return above.select("query_id", "preferred", "led_by", F.col("item_id").alias("dispreferred"), weight.alias("weight"))


def merged_candidates(spark, d):
    """One row per identifier: of the first source that has it, that source's last row."""
    rows = table(spark, d, "part").select(F.concat_ws("/", "p_type", "p_size").alias("identifier"), F.col("p_brand").alias("source"), "p_partkey", F.col("p_size").alias("installs"))
    best = rows.groupBy("identifier").agg(F.min_by(F.struct("source", "p_partkey", "installs"), F.struct("source", -F.col("p_partkey"))).alias("b"), F.count_distinct("source").alias("sources"))
    return best.select("identifier", "b.source", "b.p_partkey", "b.installs", "sources")


def rekeyed(spark, d):
    """Rows merged under a new key: counts add up, the latest stays, the first value that is there stays."""
    rows = table(spark, d, "part").select(X.norm_key(F.col("p_type")).alias("key"), "p_partkey", "p_size", F.when(F.col("p_size") > 25, F.col("p_brand")).alias("served"))
    return rows.groupBy("key").agg(
        F.sum("p_size").alias("count"), F.max("p_partkey").alias("last"), F.min_by("served", F.when(F.col("served").isNotNull(), F.col("p_partkey"))).alias("served"))


def live_users(spark, d):
    """Users whose last event is no older than the time kept, seen from the latest event of all."""
    e = table(spark, d, "events").select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    users = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    latest = users.agg(F.max("last").alias("now"))
    return users.crossJoin(F.broadcast(latest)).where(F.col("last") >= F.col("now") - KEPT_SECONDS).select("user_id", "n", "first", "last")  # one row is broadcast


def nudged_depth(spark, d, depth=7):
    """Each user's result depth, moved one step by how often views lead to purchases; none within the first day."""
    e = table(spark, d, "events").select("user_id", "event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    g = e.groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "purchase").alias("buys"), (F.max("at") - F.min("at")).alias("span"))
    rate = F.when(F.col("views") > 0, F.col("buys") / F.col("views"))
    moved = F.when((F.col("span") < 86400) | rate.isNull(), depth).when(rate >= 0.5, min(depth + 1, 12)).when(rate < 0.2, max(depth - 1, 3)).otherwise(depth)
    return g.select("user_id", "span", F.round(rate, 4).alias("rate"), moved.alias("depth"))


def page_links(spark, d):
    """Links of each page, how many differ, and the hosts they name."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('(?:href|src)="([^"]+)"'), F.lit(1))
    rows = table(spark, d, "pages").select("page_id", F.array_distinct(links).alias("links"), F.size(links).alias("n_links"))
    hosts = F.filter(F.transform("links", lambda x: F.regexp_extract(x, "^https?://([^/]+)", 1)), lambda x: x != "")
    return rows.select("page_id", "n_links", F.size("links").alias("n_distinct"), F.array_join(F.array_sort(F.array_distinct(hosts)), ",").alias("hosts"))


_E = "WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000000 AS at0 FROM events)"

QUERIES = {
    "rerank_gate": (rerank_gate, ranking.BM + """, x AS (SELECT * FROM bmr WHERE rank <= 10), e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
cs AS (SELECT query_id, item_id, greatest(round(list_cosine_similarity(a.v, b.v), 4), 0) AS c FROM x JOIN e a ON a.vec_id = item_id JOIN e b ON b.vec_id = query_id WHERE rank <= 5),
o AS (SELECT query_id, item_id, round(CASE WHEN s > 0 THEN c / s ELSE 0 END, 4) AS p FROM (SELECT *, sum(c) OVER (PARTITION BY query_id) AS s FROM cs)),
h AS (SELECT query_id, rank, score, coalesce(p, 0) AS p FROM x LEFT JOIN o USING (query_id, item_id) WHERE rank <= 5),
ga AS (SELECT query_id, count(*) AS n, max(score) FILTER (rank = 1) AS s0, max(score) FILTER (rank = 2) AS s1, list(struct_pack(p := p, rank := rank, score := score) ORDER BY p DESC, rank) AS l FROM h GROUP BY query_id),
y AS (SELECT query_id, l[1].rank AS pick, CASE WHEN n < 2 OR s0 >= 1.6::DOUBLE * s1 THEN 'clear' WHEN NOT (l[1].p >= 0.75::DOUBLE OR (l[1].p - l[2].p >= 0.02::DOUBLE AND l[1].p >= 1.2::DOUBLE / greatest(n, 2))) THEN 'unsure' WHEN l[1].score < 0.6::DOUBLE * s0 THEN 'weak' ELSE 'moved' END AS gate FROM ga)
SELECT query_id, item_id, score, rank, gate, CASE WHEN gate <> 'moved' THEN rank WHEN rank = pick THEN 1 WHEN rank < pick THEN rank + 1 ELSE rank END AS place FROM x JOIN y USING (query_id)"""),
    "open_questions": (open_questions, ranking.FUSED + """, lq AS (SELECT query_id, max(item_id) FILTER (rank = 1) AS bm25_top, max(score) FILTER (rank = 1) AS s0, max(score) FILTER (rank = 2) AS s1 FROM bmr WHERE rank <= 2 GROUP BY query_id),
oq AS (SELECT query_id, max(item_id) FILTER (rank = 1) AS fused_top, string_agg(item_id::VARCHAR, ',' ORDER BY rank) AS offered FROM z WHERE rank <= 3 GROUP BY query_id),
rq AS (SELECT query_id, bm25_top, fused_top, round((s0 - coalesce(s1, 0)) / s0, 4) AS gap, offered FROM lq JOIN oq USING (query_id) WHERE s0 > 0)
SELECT * FROM rq WHERE (bm25_top <> fused_top OR gap < 0.15::DOUBLE) AND bm25_top NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)"""),
    "reply_choices": (replies, r"""WITH t AS (SELECT conv_id, turn, role, lower(coalesce(text, '')) AS text FROM conversations), n AS (SELECT *, lead(text) OVER w AS reply, lead(role) OVER w AS who FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
m AS (SELECT conv_id, turn, regexp_extract_all(text, '[a-z]{6,}') AS a, ' ' || regexp_replace(reply, '[^\p{L}\p{N}_]+', ' ', 'g') || ' ' AS p, regexp_replace(reply, '[^\x00-\x7F]', 'x', 'g') AS q FROM n WHERE role = 'assistant' AND who = 'user'),
o AS (SELECT *, list_filter(a, lambda x, i: list_position(a, x) = i)[1:3] AS names FROM m)
SELECT conv_id, turn, array_to_string(names, ',') AS offered, coalesce(list_filter(names, lambda x: contains(p, ' ' || x || ' '))[1],
  CASE WHEN regexp_matches(q, '\b(?:yes|yep|yeah|correct|right|that''?s (?:it|right)|works?)\b') AND NOT regexp_matches(q, '\b(?:no|nope|wrong|not that|incorrect)\b') THEN names[1] END) AS preferred FROM o"""),
    "preferred_pairs": (preferred_pairs, ranking.BM + """, x AS (SELECT * FROM bmr WHERE rank <= 10), kq AS (SELECT query_id, min(rank) - 1 AS led_by, arg_min(item_id, rank) AS preferred FROM x WHERE item_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY query_id)
SELECT query_id, preferred, led_by, item_id AS dispreferred, round(1 / (1 + log2(1 + led_by::DOUBLE)), 4) AS weight FROM x JOIN kq USING (query_id) WHERE rank <= led_by"""),
    "merged_candidates": (merged_candidates, "WITH r AS (SELECT p_type || '/' || p_size AS identifier, p_brand AS source, p_partkey, p_size AS installs FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY source, p_partkey DESC) AS k FROM r), c AS (SELECT identifier, count(DISTINCT source) AS sources FROM r GROUP BY 1) SELECT identifier, source, p_partkey, installs, sources FROM k JOIN c USING (identifier) WHERE k = 1"),
    "rekeyed_rows": (rekeyed, "SELECT trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g'), ' ') AS key, sum(p_size)::BIGINT AS count, max(p_partkey) AS last, arg_min(p_brand, p_partkey) FILTER (p_size > 25) AS served FROM part GROUP BY 1"),
    "live_users": (live_users, _E + f", u AS (SELECT user_id, count(*) AS n, min(at0) AS first, max(at0) AS last FROM e GROUP BY user_id) SELECT user_id, n, first, last FROM u WHERE last >= (SELECT max(last) FROM u) - {KEPT_SECONDS}"),
    "nudged_depth": (nudged_depth, _E + ", g AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'purchase') AS b, max(at0) - min(at0) AS span FROM e GROUP BY user_id), r AS (SELECT user_id, span, CASE WHEN v > 0 THEN b::DOUBLE / v END AS rate FROM g) SELECT user_id, span, round(rate, 4) AS rate, CASE WHEN span < 86400 OR rate IS NULL THEN 7 WHEN rate >= 0.5::DOUBLE THEN 8 WHEN rate < 0.2::DOUBLE THEN 6 ELSE 7 END AS depth FROM r"),
    "page_links": (page_links, "WITH l AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '(?:href|src)=\"([^\"]+)\"', 1) AS l FROM pages) SELECT page_id, len(l) AS n_links, len(list_distinct(l)) AS n_distinct, array_to_string(list_sort(list_filter(list_distinct(list_transform(l, lambda x: regexp_extract(x, '^https?://([^/]+)', 1))), lambda x: x <> '')), ',') AS hosts FROM l"),
}
