"""The composed route: from a prompt to the items offered for it, in a batch and as a stream.

Admission, both lanes, fusion, the depth that the prompt asks for or seems to
need, selection with quotas, the cut at a cliff of scores, and diversity beyond
the prompt's own words. Prompts that are not admitted, and those that nothing
answers, have a row without picks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions.text import plain_norm
from ferrule.jobs import catalogue, derived, scaffold, sqltext
from ferrule.jobs.prompts import skip_reason
from ferrule.operators import catalogue as C
from ferrule.operators import choose
from ferrule.sources.shared import new_folder, stored

#: Depth is moved by one where offers are taken up often or seldom.
OFTEN, SELDOM, LEAST, MOST = 0.5, 0.2, 3, 12


def nudged(depth, rate: float | None):
    """A depth moved by the share of offers that were taken up; null: not known yet."""
    if rate is None or SELDOM <= rate < OFTEN:
        return depth
    return F.least(depth + 1, F.lit(MOST)) if rate >= OFTEN else F.greatest(depth - 1, F.lit(LEAST))


def route(own: C.Index, queries: DataFrame, near: DataFrame, hints: DataFrame, learnt: DataFrame, stack: list[str], rate: float | None = None) -> DataFrame:
    """(query_id, reason, n, abstained, picks) of queries (query_id, prompt, source); ``near``: (query_id, item_id, rank) of the cosine lane."""
    asked = stored(queries.withColumn("reason", skip_reason(F.col("prompt"), F.col("source"))))
    admitted = asked.where("reason is null").select("query_id", "prompt")
    lexical = C.score(own, admitted, hints, learnt, stack)
    rows = C.fuse(own, lexical, near.join(admitted.select("query_id"), "query_id", "left_semi"), admitted)
    wanted = scaffold.features(admitted.select(F.col("query_id").alias("prompt_id"), "prompt")).select(F.col("prompt_id").alias("query_id"), "depth", "requested")
    counts = stored(wanted.select("query_id", F.coalesce("requested", nudged(F.col("depth"), rate)).alias("n"), F.col("requested").isNotNull().alias("topup")))
    picked = C.combined(rows.join(own.items.select("item_id", "kind"), "item_id").select("query_id", "item_id", "kind", "score", "rank"), counts)
    picked = stored(picked.drop("rank").withColumnRenamed("pick", "rank").join(counts.select("query_id", "topup"), "query_id"))
    # who asks for a number gets it; the others get what stands out and differs
    free = stored(choose.cliff(picked.where("not topup").drop("topup")))
    terms = own.posted.join(free.select("item_id").distinct(), "item_id", "left_semi").select("item_id", "term").distinct()
    rest = free.select("query_id", "item_id").join(terms, "item_id").join(lexical.terms, ["query_id", "term"], "left_anti").groupBy("query_id", "item_id").agg(F.collect_set("term").alias("tokens"))
    spread = free.join(rest, ["query_id", "item_id"], "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    kept = choose.diversify(spread.select("query_id", "item_id", "rank", "tokens"))
    offered = free.join(kept.select("query_id", "item_id"), ["query_id", "item_id"], "left_semi").unionByName(picked.where("topup").drop("topup"))
    # at most MOST_ASKED rows a query
    named = offered.join(own.items.select("item_id", "name"), "item_id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.concat_ws(":", "kind", "name").alias("name")))).alias("l"))
    lists = named.select("query_id", F.array_join(F.transform("l", lambda x: x["name"]), ", ").alias("picks"))
    return asked.join(counts, "query_id", "left").join(lists, "query_id", "left").select("query_id", "reason", "n", F.col("picks").isNull().alias("abstained"), F.coalesce("picks", F.lit("")).alias("picks"))


#: (query_id, prompt, source): prompts of all kinds, also those that no one typed.
ASKED = f"""
SELECT query_id, CASE WHEN query_id % 17 = 0 THEN concat('* ', prompt) WHEN query_id % 19 = 0 THEN concat(prompt, ' <system-reminder>') ELSE prompt END AS prompt,
  CASE WHEN query_id % 23 = 0 THEN 'poll_event' ELSE 'user' END AS source FROM ({derived.QUERIES}) q"""


def _rate(spark, d) -> float | None:
    row = derived.rows(spark, d, "SELECT count_if(event_type = 'view') AS v, count_if(event_type = 'purchase') AS b FROM events").first()
    return row["b"] / row["v"] if row["v"] else None


def routed(spark, d):
    own, hints, learnt = catalogue.index(spark, d)
    queries = stored(derived.rows(spark, d, ASKED))
    return route(own, queries, catalogue.nearest(spark, d, own, queries.select("query_id")), hints, learnt, [plain_norm(w) for w in catalogue.PROJECT], _rate(spark, d))


class Router:
    """Sink for ``foreachBatch``: routes each batch of prompts against the stored catalogue.

    A batch writes the folder of its number, so one that is run again after a failure replaces itself.
    """

    def __init__(self, folder: str, own: C.Index, near: DataFrame, hints: DataFrame, learnt: DataFrame, stack: list[str], rate: float | None) -> None:
        self.folder, self.given = folder, (own, near, hints, learnt, stack, rate)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        own, near, hints, learnt, stack, rate = self.given
        route(own, stored(batch), near, hints, learnt, stack, rate).write.mode("overwrite").parquet(f"{self.folder}/rows/batch={batch_id}")


ROUTED = "query_id long, reason string, n int, abstained boolean, picks string"


def stream(spark: SparkSession, prompts: DataFrame, folder: str, router: Router) -> DataFrame:
    """All routes of a stream of prompts (query_id, prompt, source), up to what there is now."""
    prompts.writeStream.foreachBatch(router).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    empty = spark.createDataFrame([], ROUTED)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return empty
    return spark.read.schema(ROUTED).parquet(f"{folder}/rows").select(empty.columns)


def routed_stream(spark, d, batches: int = 2):
    """The same routes from prompts that come in as a stream of several batches; catalogue, vectors and weights are stored once."""
    folder = new_folder(spark, "route")
    queries = stored(derived.rows(spark, d, ASKED))
    queries.repartitionByRange(batches, "query_id").write.parquet(f"{folder}/asked")
    own, hints, learnt = catalogue.index(spark, d)
    near = stored(catalogue.nearest(spark, d, own, queries.select("query_id")))
    router = Router(folder, own, near, hints, learnt, [plain_norm(w) for w in catalogue.PROJECT], _rate(spark, d))
    prompts = spark.readStream.schema(queries.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/asked")
    return stream(spark, prompts, folder, router)


_ASKED = f"""aq AS ({ASKED.replace(derived.QUERIES, "SELECT * FROM qall")}),
rs AS (SELECT query_id, CASE WHEN source IN ('system', 'loop_wakeup', 'schedule_wakeup', 'poll_event') THEN 'source=' || source WHEN trim(prompt, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'empty'
  WHEN regexp_matches(trim(prompt, ' ' || chr(9) || chr(10) || chr(13)), '^[*#]') THEN 'bypass prefix' WHEN contains(prompt, '<system-reminder>') THEN 'machine-generated content'
  WHEN prompt LIKE '/%' AND len(list_filter(regexp_split_to_array(prompt, '[ \\t\\n\\r]+'), lambda x: x <> '')) < 4 THEN 'slash command' END AS reason FROM aq)"""
# the catalogue's SQL, over the prompts that are admitted
_BASE = catalogue._FUSE.replace(f"queries AS ({derived.QUERIES})", f"qall AS ({derived.QUERIES}), {_ASKED}, queries AS (SELECT query_id, prompt FROM aq JOIN rs USING (query_id) WHERE reason IS NULL)")
_ROUTE = _BASE + ", sf AS (" + scaffold.SCAFFOLD.replace("@PROMPTS@", "SELECT query_id AS prompt_id, prompt FROM queries") + r"""),
ev0 AS (SELECT count(*) FILTER (event_type = 'purchase') / count(*) FILTER (event_type = 'view') AS rate FROM events),
cn AS (SELECT prompt_id AS query_id, requested AS asked, CASE WHEN requested IS NOT NULL THEN requested WHEN rate >= 0.5::DOUBLE THEN least(depth + 1, 12) WHEN rate < 0.2::DOUBLE THEN greatest(depth - 1, 3) ELSE depth END AS n FROM sf, ev0),
r0 AS (SELECT query_id, item_id, kind, score, rank, n, asked IS NOT NULL AS topup, score >= 0.28::DOUBLE AS above, kind IN ('skill', 'plugin-skill') AS ismain FROM fz JOIN items USING (item_id) JOIN cn USING (query_id)),
r1 AS (SELECT *, arg_min(score, rank) FILTER (above) OVER (PARTITION BY query_id) AS lead FROM r0),
r2 AS (SELECT *, above AND ismain AND score >= lead * 0.55::DOUBLE AS main, above AND NOT ismain AS other FROM r1),
r3 AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind, other ORDER BY rank) AS k, min(rank) OVER (PARTITION BY query_id, kind, other) AS first, max(coalesce(main, false)::INT) OVER (PARTITION BY query_id) AS has FROM r2),
r4 AS (SELECT *, sum((other AND k <= 2)::INT) OVER (PARTITION BY query_id ORDER BY first, k, rank ROWS UNBOUNDED PRECEDING) AS number FROM r3),
r5 AS (SELECT *, CASE WHEN other AND k <= 2 AND number <= n - has THEN 0 WHEN main THEN 1 WHEN above THEN 2 WHEN topup THEN 3 END AS class FROM r4),
r6 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY class, CASE WHEN class = 0 THEN first END, rank) AS slot FROM r5 WHERE class IS NOT NULL),
r7 AS (SELECT query_id, item_id, kind, score, topup, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS pick FROM r6 WHERE slot <= n),
c1 AS (SELECT *, lag(score) OVER (PARTITION BY query_id ORDER BY pick) AS b, count(*) OVER (PARTITION BY query_id) AS nn FROM r7 WHERE NOT topup),
c2 AS (SELECT *, CASE WHEN pick <= 15 AND b > 0 THEN (b - score) / b END AS drp FROM c1),
c3 AS (SELECT query_id, arg_max(score, (drp, -pick)) FILTER (drp IS NOT NULL) AS edge FROM c2 WHERE nn >= 3 GROUP BY query_id HAVING max(drp) > 0.35::DOUBLE),
c4 AS (SELECT c2.* FROM c2 LEFT JOIN c3 USING (query_id) WHERE edge IS NULL OR score >= edge),
ct AS (SELECT query_id, item_id, list(term) AS tokens FROM c4 JOIN p USING (item_id) WHERE (query_id, term) NOT IN (SELECT query_id, term FROM q) GROUP BY ALL),""" + sqltext.DIVERSE.replace(
    "@ROWS@", "SELECT query_id, item_id, pick AS rank, coalesce(tokens, []) AS tokens FROM c4 LEFT JOIN ct USING (query_id, item_id)"
) + """,
of AS (SELECT query_id, item_id, kind, pick FROM c4 WHERE (query_id, item_id) IN (SELECT query_id, item_id FROM kept) UNION ALL SELECT query_id, item_id, kind, pick FROM r7 WHERE topup),
ol AS (SELECT query_id, string_agg(kind || ':' || lower(name), ', ' ORDER BY pick) AS picks FROM of JOIN (SELECT item_id, name FROM items) USING (item_id) GROUP BY query_id)
SELECT rs.query_id, reason, n, picks IS NULL AS abstained, coalesce(picks, '') AS picks FROM rs LEFT JOIN cn USING (query_id) LEFT JOIN ol USING (query_id)"""

QUERIES = {"route": (routed, _ROUTE), "route_stream": (routed_stream, _ROUTE)}
