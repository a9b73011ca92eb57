"""Candidates, gaps, gold sets and runs: screening, upserts, labels, health and comparison of lanes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ferrule.functions import text as X
from ferrule.functions import vocab as V
from ferrule.jobs import derived, ranking, sqltext
from ferrule.jobs.signals import INDICATORS_SQL, PAID_SQL, guarded
from ferrule.operators import retrieve
from ferrule.sources.shared import stored
from ferrule.sources.tables import front_matter, table

DAY = 86400


def _candidates(spark, d):
    """Candidates with owner, paid, installs and signs of harm."""
    rows = derived.rows(spark, d, derived.CANDIDATES)
    parts = F.split("identifier", "/")
    owner = F.when((F.get(parts, F.lit(0)) == "skills-sh") & (F.size(parts) > 1), F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))
    installs = F.regexp_extract("listing", r"(?i)([\d,]+)\s*installs", 1)
    screened = F.concat_ws("\n", "listing", "script")
    return rows.select(
        "*", owner.alias("owner"), (~F.col("listing").rlike(f"(?U){V.PAID}")).alias("free"),
        F.nullif(F.replace(installs, F.lit(","), F.lit("")), F.lit("")).try_cast("bigint").alias("installs"),
        F.array_join(guarded(screened), ",").alias("signs"),
    )


def _squats(rows, publishers=V.PUBLISHERS):
    """(owner, known, distance): different owners within two edits of a known publisher, the first in the list of names."""
    names = rows.sparkSession.createDataFrame(list(enumerate(publishers)), "k int, known string")
    low = F.lower(F.btrim("owner"))
    pairs = rows.select("owner").distinct().join(F.broadcast(names), F.levenshtein(low, "known", 2).between(1, 2))
    return pairs.groupBy("owner").agg(F.min(F.struct("k", "known")).alias("m")).select("owner", F.col("m.known").alias("known"), F.levenshtein(F.lower(F.btrim("owner")), F.col("m.known")).alias("distance"))


def publisher_squats(spark, d):
    return _squats(_candidates(spark, d).select("owner"))


def candidate_features(spark, d):
    return _candidates(spark, d).select("candidate_id", "owner", "free", "installs", "signs")


def candidate_gates(spark, d):
    """First reason against a candidate, by the cheap gate and by the one for unattended use.

    The screen's verdict is an input; here it is safe but for every eleventh candidate, and missing for every thirteenth.
    """
    rows = _candidates(spark, d)
    rows = rows.join(_squats(rows).select("owner", "known"), "owner", "left")
    screen = F.when(F.col("candidate_id") % 13 == 0, None).when(F.col("candidate_id") % 11 == 0, "unsafe").otherwise("safe")
    cheap = F.when(F.col("kind") != "skill", "kind").when(~F.col("free"), "not free").when(F.coalesce("installs", F.lit(0)) < 1000, "few installs")
    auto = F.coalesce(cheap, F.when(F.col("script").isNull(), "no body").when(~F.coalesce(screen == "safe", F.lit(False)), "screen").when(F.col("signs") != "", "signs").when(F.col("known").isNotNull(), "name"))
    return rows.select("candidate_id", "identifier", "name", "source", "installs", cheap.alias("cheap"), auto.alias("auto"))


def sourced(spark, d):
    """The first candidate of each source that passes all gates, by installs and name; one row per identifier, the first source's last row."""
    rows = candidate_gates(spark, d)
    own = rows.groupBy("identifier").agg(F.min_by(F.struct("source", "candidate_id", "name", "installs", "auto"), F.struct("source", -F.col("candidate_id"))).alias("b")).select("identifier", "b.*")
    order = F.struct((-F.coalesce("installs", F.lit(0))).alias("i"), "name", "identifier")
    best = own.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("auto").isNull()).alias("passing"), F.min_by("identifier", F.when(F.col("auto").isNull(), order)).alias("chosen"))
    return best


def _sightings(spark, d):
    """(at, key, tokens): instructions as they came in, an hour apart, by their keys."""
    rows = derived.rows(spark, d, derived.PROMPTS).where("prompt_id LIKE 'p%'").withColumn("n", F.substring("prompt_id", 2, 20).cast("long"))
    rows = rows.withColumn("t", X.intent_tokens(F.col("prompt")))
    return rows.select((F.col("n") * 3600).alias("at"), "n", "prompt", X.intent_key(F.col("t")).alias("key"), "t")


def gap_states(spark, d, kept=30 * DAY):
    """What was asked for, by key: first, last, count, the last five different examples; those not seen for 30 days go. Eligible are those served, seen three times and not installed."""
    rows = _sightings(spark, d).where("key <> ''")
    examples = rows.groupBy("key", "prompt").agg(F.max("n").alias("n"))
    recent = examples.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n")))).where("k <= 5")
    recent = recent.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "prompt"))), lambda x: x["prompt"]), " | ").alias("examples"))
    states = rows.groupBy("key").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("count"))
    now = rows.agg(F.max("at").alias("now"))
    served = F.when(F.col("last") % 3 == 0, True).when(F.col("count") % 2 == 0, False)  # a judge's verdict, null where there is none
    alive = states.crossJoin(F.broadcast(now)).where(F.col("last") >= F.col("now") - kept).drop("now")  # one row is broadcast
    alive = alive.withColumn("served", served).withColumn("eligible", F.coalesce(served & (F.col("count") >= 3), F.lit(False)))
    return alive.join(recent, "key").select("key", "first", "last", "count", "examples", "served", "eligible")


def fresh_searches(spark, d, kept=7 * DAY):
    """Whether a search of each source is still fresh, seen from the latest: 0 to 7 days old."""
    rows = derived.rows(spark, d, derived.CANDIDATES).groupBy("source").agg(F.max(F.col("candidate_id") * 1800).alias("at"))
    now = rows.agg(F.max("at").alias("now"))
    return rows.crossJoin(F.broadcast(now)).select("source", "at", (F.col("now") - F.col("at")).alias("age"), (F.col("now") - F.col("at")).between(0, kept).alias("fresh"))


#: (ord, prompt, label, source): labelled prompts from three sources, as they come in.
_GOLD = """
SELECT p_partkey * 3 AS ord, concat('Use ', p_name, CASE WHEN p_size % 2 = 0 THEN '!' ELSE '' END) AS prompt,
  CASE p_size % 6 WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN concat('pack/', replace(p_name, ' ', '-')) WHEN 2 THEN concat('ns:', replace(p_name, ' ', '-')) WHEN 3 THEN concat('gone-', lower(p_type)) WHEN 4 THEN replace(p_name, ' ', '_') END AS label, 'log' AS source FROM part
UNION ALL SELECT p_partkey * 3 + 1, concat('need ', lower(p_type), ' and ', p_name), CASE WHEN p_partkey % 4 = 0 THEN lower(p_type) END, 'gaps' FROM part
UNION ALL SELECT p_partkey * 3 + 2, CASE WHEN p_size = 1 THEN '  ' ELSE concat('no tool for ', p_brand) END, CAST(NULL AS STRING), 'adversarial' FROM part"""


def _gold(spark, d, most=3):
    raw = derived.rows(spark, d, _GOLD).withColumn("key", X.norm_key(F.col("prompt"))).where("key <> ''")
    names = derived.rows(spark, d, derived.ITEMS).select("name").distinct()
    labels = raw.where("label is not null").select("label").distinct().withColumn("clean", F.btrim("label"))
    tails = labels.select("label", F.inline(F.array(*(
        F.struct(F.lit(k).alias("k"), c.alias("name")) for k, c in enumerate((F.col("clean"), F.when(F.col("clean").contains(":"), F.btrim(F.regexp_extract("clean", "([^:]*)$", 1))), F.when(F.col("clean").contains("/"), F.btrim(F.regexp_extract("clean", "([^/]*)$", 1)))))
    )))).where("name <> ''")
    resolved = tails.join(names, "name").groupBy("label").agg(F.min_by("name", "k").alias("resolved"))
    live = names.select(F.col("name").alias("label"), F.lit(True).alias("live"))
    marked = raw.join(resolved, "label", "left").join(live, "label", "left")
    g = marked.groupBy("key").agg(
        F.min("ord").alias("ord"), F.min_by("prompt", "ord").alias("prompt"), F.min_by("source", "ord").alias("source"), F.array_sort(F.collect_set("resolved")).alias("labels"), F.count("label").alias("n_raw"),
        F.array_sort(F.collect_set(F.when(F.col("live").isNull(), F.col("label")))).alias("stale_labels"), F.count(F.lit(1)).alias("seen"))
    first = marked.groupBy("key", "source").agg(F.min("ord").alias("ord")).groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "source"))), lambda x: x["source"]), ",").alias("sources"))
    status = F.when((F.col("n_raw") > 0) & (F.size("labels") == 0), "stale").when(F.size("labels") > 0, "positive").otherwise("negative")
    return g.join(first, "key").select("ord", "key", "prompt", "source", "sources", F.slice("labels", 1, most).alias("labels"), "stale_labels", "seen", status.alias("label_status"))


def gold_build(spark, d):
    """One row for each different prompt: labels resolved to names in the catalogue, what is gone, and its status."""
    rows = _gold(spark, d)
    return rows.select("key", "prompt", "source", "sources", F.array_join("labels", ",").alias("labels"), F.array_join("stale_labels", ",").alias("stale_labels"), "seen", "label_status", (F.size("labels") > 0).alias("resolvable"))


def gold_stats(spark, d):
    """Rows of the gold set by source and status, with totals."""
    return _gold(spark, d).rollup("source", "label_status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("labels")).alias("n_labels"))


def gold_verify(spark, d):
    """Names of the gold set, how many rows name them, and whether the catalogue still has them."""
    rows = _gold(spark, d).select(F.explode(F.concat("labels", "stale_labels")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    names = derived.rows(spark, d, derived.ITEMS).select("name").distinct().withColumn("live", F.lit(True))
    return rows.join(names, "name", "left").select("name", "n", F.coalesce("live", F.lit(False)).alias("live"))


def _lanes(spark, d):
    """(lane, query_id, item_id, rank): the lanes' first ten. Lanes without a row for a query were not healthy there."""
    found = stored(ranking.topk(spark, d, 50))
    lexical, fused = found.where("rank <= 10"), stored(ranking.fused(spark, d, found))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    asked = table(spark, d, "benchmark").select("item_id").join(vectors, "item_id").select(F.col("item_id").alias("query_id"), "vector")
    near = retrieve.dense(vectors, asked, 10)
    cols = ("query_id", "item_id", "rank")
    out = None
    for name, rows in (("bm25", lexical), ("dense", near), ("fused", fused)):
        rows = rows.select(F.lit(name).alias("lane"), *cols)
        out = rows if out is None else out.unionByName(rows)
    return out


def lane_health(spark, d):
    """For each lane: queries answered, not answered, rows, and a mark of its whole outcome."""
    n = table(spark, d, "benchmark").agg(F.count(F.lit(1)).alias("n_queries"))
    g = _lanes(spark, d).groupBy("lane", "query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"].cast("string")), " ").alias("l"), F.count(F.lit(1)).alias("n"))
    # the digest of a query's list, in four parts of 40 bits whose sums do not depend on the order
    digest = F.sha1(F.concat_ws(":", "query_id", "l"))
    parts = [F.sum(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"x{k}") for k in range(4)]
    g = g.groupBy("lane").agg(F.count(F.lit(1)).alias("answered"), F.sum("n").alias("n_rows"), *parts)
    # one row of counts is broadcast
    return g.crossJoin(F.broadcast(n)).select("lane", "answered", (F.col("n_queries") - F.col("answered")).alias("degraded"), "n_rows", (F.col("answered") == F.col("n_queries")).alias("healthy"), F.substring(F.sha1(F.concat_ws("|", "lane", "answered", "n_rows", "x0", "x1", "x2", "x3")), 1, 12).alias("sig"))


def run_compare(spark, d, drop=0.01):
    """Each lane's share of queries whose own passage is found, against the first lane: what fell by more than allowed."""
    gold = ranking._gold(spark, d)
    hits = _lanes(spark, d).join(gold, ["query_id", "item_id"])
    best = hits.groupBy("lane", "query_id").agg(F.min("rank").alias("r"))
    n = gold.select("query_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    lanes = spark.createDataFrame([("bm25",), ("dense",), ("fused",)], "lane string")
    m = best.groupBy("lane").agg(*(F.count_if(F.col("r") <= k).alias(f"h{k}") for k in (1, 5, 10)), F.sum(1 / F.col("r")).alias("rr"))
    m = lanes.join(m, "lane", "left").crossJoin(F.broadcast(n))  # one row is broadcast
    long = m.select("lane", F.inline(F.array(*(F.struct(F.lit(name).alias("metric"), F.round(F.coalesce(F.col(c), F.lit(0)) / F.col("n"), 4).alias("value")) for name, c in (("recall_1", "h1"), ("recall_5", "h5"), ("recall_10", "h10"), ("mrr", "rr"))))))
    base = long.where("lane = 'bm25'").select("metric", F.col("value").alias("baseline"))
    delta = F.round(F.col("value") - F.col("baseline"), 4)
    return long.join(base, "metric").select("lane", "metric", "value", "baseline", delta.alias("delta"), (delta < -drop).alias("regressed"))


def run_medians(spark, d):
    """The middle of several runs of each lane, a run being a tenth of the queries by their number: mean, spread, and the run that stands for all."""
    found = ranking.topk(spark, d, 10).withColumn("run", F.col("query_id") % 10)
    runs = found.groupBy("run").agg(F.round(F.avg("score"), 4).alias("value"))
    w = Window.orderBy("value", "run")  # ten rows
    runs = runs.withColumn("k", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    return runs.agg(F.max(F.when(F.col("k") == F.floor(F.col("n") / 2) + 1, F.col("run"))).alias("median_run"), F.round(F.avg("value"), 3).alias("mean"), F.round(F.stddev_pop("value"), 3).alias("spread"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n"))


#: (item_id, doc): a note with front matter for each part.
_NOTES = r"""
SELECT p_partkey AS item_id, concat(CASE WHEN p_size % 11 = 0 THEN 'no front matter' ELSE concat('---', chr(10), 'Name: "', p_name, '"', chr(10), '# a comment', chr(10), 'description: ',
  CASE p_size % 4 WHEN 0 THEN concat('>-', chr(10), '  Helps with ', p_name, '.', chr(10), chr(10), '  Use when: the ', lower(p_type), ' part of ', p_brand, ' is slow.', chr(10)) WHEN 1 THEN concat('''Use this for ', lower(p_type), ' work on "flaky tests" and more''', chr(10))
    WHEN 2 THEN concat('plain: with colon "', p_name, '"', chr(10)) ELSE concat('|', chr(10), '  line one', chr(10), '  triggers when "', p_name, '" fails badly', chr(10)) END,
  'nested:', chr(10), '  skipped: yes', chr(10), 'name: ', p_name, CASE WHEN p_size % 13 = 0 THEN '' ELSE concat(chr(10), '---', chr(10)) END) END,
  '# Title of ', p_name, chr(10), '```', chr(10), 'code here', chr(10), '```', chr(10), 'Body *words* for ', lower(p_type), ' <!-- hidden --> end') AS doc FROM part"""


def note_facts(spark, d):
    """Front matter, body, when-clause, triggers and the text to embed of every note."""
    rows = derived.rows(spark, d, _NOTES).withColumn("m", front_matter(F.col("doc"))).withColumn("desc", F.coalesce(F.col("m")["description"], F.lit("")))
    end = r"(?s)^---.*?\n---[ \t]*(?:\n|$)"
    body = F.when(F.col("doc").rlike(end), F.regexp_replace("doc", end, "")).otherwise(F.col("doc"))
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"(?s)```.*?```", " "), r"(?s)<!--.*?-->", " "), r"[#*_`>|]", " ")
    body = F.array_join(F.slice(F.regexp_extract_all(body, F.lit(r"[A-Za-z][A-Za-z0-9+#._-]*"), F.lit(0)), 1, 120), " ")
    when = F.substring(F.btrim(F.regexp_extract("desc", r"(?i)(?:use (?:this )?(?:when|whenever|for)|triggers? when|invoke (?:when|if))[:\s].{10,240}", 0)), 1, 240)
    rows = rows.select("item_id", F.coalesce(F.col("m")["name"], F.lit("")).alias("name"), "desc", F.map_keys("m").alias("keys"), body.alias("body"), when.alias("when"))
    quoted = F.regexp_extract_all("desc", F.lit(r"""["']([a-z][a-z0-9 +#./-]{3,60})["']"""), F.lit(1))
    triggers = F.substring(F.array_join(F.concat(quoted, F.when(F.col("when") != "", F.array("when")).otherwise(F.array().cast("array<string>"))), " "), 1, 240)
    rows = rows.withColumn("triggers", triggers)
    some = lambda c: F.when(F.col(c) != "", F.concat(F.lit(" "), c)).otherwise("")
    embed = F.concat(F.lit("skill: "), "name", F.lit(". "), "desc", some("body"), some("when"), some("triggers"))
    return rows.select("item_id", "name", "desc", F.array_join(F.array_sort("keys"), ",").alias("keys"), "body", "when", "triggers", F.substring(F.sha1(embed), 1, 16).alias("embed_hash"))


def learnt_uses(spark, d):
    """Weight of each item after being used: 0.25 a use, 2 at most; the uses count once for each prompt."""
    rows = table(spark, d, "events").where("event_type = 'purchase'").select("user_id", F.get_json_object("props", "$.k").alias("name")).where("name is not null")
    uses = rows.distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return uses.select("name", "n", F.least(F.lit(2.0), 0.25 * F.col("n")).alias("weight"))


def answered_questions(spark, d):
    """Answers matched to questions by their place in the conversation: the k-th user turn answers the k-th assistant turn. The id is that of the question."""
    t = table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    t = t.withColumn("k", place)
    q = t.where("role = 'assistant'").select("conv_id", "k", F.col("turn").alias("question_turn"), F.col("text").alias("question"))
    a = t.where("role = 'user'").select("conv_id", "k", F.col("turn").alias("answer_turn"), F.col("text").alias("answer"))
    return q.join(a, ["conv_id", "k"]).select("conv_id", "k", "question_turn", "answer_turn", F.substring(F.sha1(X.norm_key(F.col("question"))), 1, 12).alias("id"), F.substring(F.sha1("answer"), 1, 16).alias("answer_key"))


def config_servers(spark, d):
    """Servers named in JSON settings, at the top and under projects: one row for each name, the first place's; the note, else the hint."""
    rows = table(spark, d, "part").select("p_partkey", F.concat(
        F.lit('{"servers": {"'), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit('": {"command": "run", "url": "http://'), F.lower("p_type"), F.lit('", "args": ["-v", "'), F.col("p_brand"),
        F.lit('"]}}, "projects": {"/x": {"servers": {"'), F.lower("p_type"), F.lit('": {"type": "http"}}}}'), F.when(F.col("p_size") % 9 == 0, "").otherwise("}")).alias("config"))
    kind = "map<string,struct<command:string,url:string,type:string,args:array<string>>>"
    parsed = rows.select("p_partkey", F.from_json("config", f"servers {kind}, projects map<string,struct<servers:{kind}>>, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("c")).where("c._bad is null")
    top = parsed.select("p_partkey", F.lit(0).alias("place"), F.explode("c.servers").alias("name", "s"))
    nested = parsed.select("p_partkey", F.explode("c.projects").alias("path", "p")).select("p_partkey", F.lit(1).alias("place"), F.explode("p.servers").alias("name", "s"))
    both = top.unionByName(nested).select("name", "place", "p_partkey", F.concat_ws(" ", "s.command", "s.url", "s.type", F.array_join("s.args", " ")).alias("hint"))
    first = both.groupBy("name").agg(F.min(F.struct("place", "p_partkey", "hint")).alias("m")).select("name", "m.*")
    notes = table(spark, d, "part").where("p_size % 5 = 0").select(F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("key"), "p_partkey", F.concat(F.lit("note of "), "p_brand").alias("note"))
    notes = notes.groupBy("key").agg(F.min_by("note", "p_partkey").alias("note"))
    return first.join(notes, F.lower("name") == F.col("key"), "left").select("name", "place", "p_partkey", F.coalesce("note", F.substring("hint", 1, 200)).alias("about"))


_C = f"""
WITH {INDICATORS_SQL}, cd AS ({derived.CANDIDATES}),
cf AS (SELECT *, CASE WHEN identifier LIKE 'skills-sh/%' THEN split_part(identifier, '/', 2) ELSE split_part(identifier, '/', 1) END AS owner,
  NOT regexp_matches(listing, {PAID_SQL}, 'i') AS free, TRY_CAST(nullif(replace(regexp_extract(listing, '([\\d,]+)\\s*installs', 1, 'i'), ',', ''), '') AS BIGINT) AS installs FROM cd),
ch AS (SELECT candidate_id, string_agg(ind.name, ',' ORDER BY k) AS signs FROM cf, ind WHERE regexp_matches(concat_ws(chr(10), listing, script), rx, 'i') GROUP BY candidate_id),
cs AS (SELECT cf.*, coalesce(signs, '') AS signs FROM cf LEFT JOIN ch USING (candidate_id)),
kp(k, known) AS (VALUES (0, 'anthropics'), (1, 'vercel-labs'), (2, 'vercel'), (3, 'microsoft'), (4, 'openai'), (5, 'google'), (6, 'supabase'), (7, 'prisma'), (8, 'sentry'), (9, 'remotion-dev'), (10, 'larksuite'), (11, 'obra'), (12, 'mattpocock'), (13, 'nextlevelbuilder'), (14, 'hermes')),
sq AS (SELECT owner, arg_min(known, k) AS known, levenshtein(lower(owner), arg_min(known, k)) AS distance FROM (SELECT DISTINCT owner FROM cf), kp WHERE levenshtein(lower(owner), known) BETWEEN 1 AND 2 GROUP BY owner),
ga AS (SELECT candidate_id, identifier, name, source, installs, CASE WHEN kind <> 'skill' THEN 'kind' WHEN NOT free THEN 'not free' WHEN coalesce(installs, 0) < 1000 THEN 'few installs' END AS cheap,
  CASE WHEN script IS NULL THEN 'no body' WHEN candidate_id % 13 = 0 OR candidate_id % 11 = 0 THEN 'screen' WHEN signs <> '' THEN 'signs' WHEN known IS NOT NULL THEN 'name' END AS late FROM cs LEFT JOIN sq USING (owner))"""
_G = f"""
WITH gr AS ({_GOLD}), gk AS (SELECT *, trim(regexp_replace(lower(prompt), '[^a-z0-9]+', ' ', 'g'), ' ') AS key FROM gr), nm AS (SELECT DISTINCT name FROM ({derived.ITEMS})),
gl AS (SELECT *, CASE WHEN label IN (SELECT name FROM nm) THEN label WHEN contains(label, ':') AND trim(regexp_extract(label, '([^:]*)$', 1)) IN (SELECT name FROM nm) THEN trim(regexp_extract(label, '([^:]*)$', 1))
  WHEN contains(label, '/') AND trim(regexp_extract(label, '([^/]*)$', 1)) IN (SELECT name FROM nm) THEN trim(regexp_extract(label, '([^/]*)$', 1)) END AS resolved FROM gk WHERE key <> ''),
gs AS (SELECT key, string_agg(source, ',' ORDER BY o) AS sources FROM (SELECT key, source, min(ord) AS o FROM gl GROUP BY ALL) GROUP BY key),
gg AS (SELECT key, min(ord) AS ord, arg_min(prompt, ord) AS prompt, arg_min(source, ord) AS source, coalesce(list_sort(list(DISTINCT resolved) FILTER (resolved IS NOT NULL)), []) AS l, count(label) AS n_raw,
  coalesce(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL AND label NOT IN (SELECT name FROM nm))), []) AS stale, count(*) AS seen FROM gl GROUP BY key),
gf AS (SELECT gg.*, sources, l[1:3] AS labels, CASE WHEN n_raw > 0 AND len(l) = 0 THEN 'stale' WHEN len(l) > 0 THEN 'positive' ELSE 'negative' END AS label_status FROM gg JOIN gs USING (key))"""
_L = ranking.FUSED + """, la AS (SELECT 'bm25' AS lane, query_id, item_id, rank FROM bmr WHERE rank <= 10 UNION ALL SELECT 'dense', query_id, item_id, rank FROM dn WHERE rank <= 10 UNION ALL SELECT 'fused', query_id, item_id, rank FROM z WHERE rank <= 10)"""
_STOPS = ", ".join(repr(w) for w in sqltext.INTENT_STOP)

QUERIES = {
    "publisher_squats": (publisher_squats, _C + " SELECT owner, known, distance FROM sq"),
    "candidate_features": (candidate_features, _C + " SELECT candidate_id, owner, free, installs, signs FROM cs"),
    "candidate_gates": (candidate_gates, _C + " SELECT candidate_id, identifier, name, source, installs, cheap, coalesce(cheap, late) AS auto FROM ga"),
    "sourced_candidates": (sourced, _C + """, ow AS (SELECT *, coalesce(cheap, late) AS auto, row_number() OVER (PARTITION BY identifier ORDER BY source, candidate_id DESC) AS w FROM ga)
SELECT source, count(*) AS n, count(*) FILTER (auto IS NULL) AS passing, arg_min(identifier, (-coalesce(installs, 0), name, identifier)) FILTER (auto IS NULL) AS chosen FROM ow WHERE w = 1 GROUP BY source"""),
    "gap_states": (gap_states, f"""WITH pr AS ({derived.PROMPTS}), s0 AS (SELECT CAST(prompt_id[2:] AS BIGINT) AS n, prompt, list_sort(list_filter(list_distinct(regexp_extract_all(lower(prompt), '[a-z][a-z0-9_-]{{2,}}')), lambda w: w NOT IN ({_STOPS}))) AS t FROM pr WHERE prompt_id LIKE 'p%'),
s AS (SELECT n, n * 3600 AS moment, prompt, CASE WHEN len(t) > 24 THEN 'intent:' || left(sha1(array_to_string(t, ' ')), 16) || ' (' || len(t) || ' tokens)' ELSE array_to_string(t, ' ') END AS key FROM s0),
e AS (SELECT key, prompt, max(n) AS n FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC) AS k FROM e), x AS (SELECT key, string_agg(prompt, ' | ' ORDER BY n) AS examples FROM r WHERE k <= 5 GROUP BY key),
g AS (SELECT key, min(moment) AS first, max(moment) AS last, count(*) AS count FROM s WHERE key <> '' GROUP BY key), v AS (SELECT *, CASE WHEN last % 3 = 0 THEN true WHEN count % 2 = 0 THEN false END AS served FROM g WHERE last >= (SELECT max(moment) FROM s WHERE key <> '') - 2592000)
SELECT key, first, last, count, examples, served, coalesce(served AND count >= 3, false) AS eligible FROM v JOIN x USING (key)"""),
    "fresh_searches": (fresh_searches, f"WITH g AS (SELECT source, max(candidate_id * 1800) AS moment FROM ({derived.CANDIDATES}) GROUP BY source), w AS (SELECT source, moment, max(moment) OVER () - moment AS age FROM g) SELECT source, moment AS at, age, age BETWEEN 0 AND 604800 AS fresh FROM w"),
    "gold_build": (gold_build, _G + " SELECT key, prompt, source, sources, array_to_string(labels, ',') AS labels, array_to_string(stale, ',') AS stale_labels, seen, label_status, len(labels) > 0 AS resolvable FROM gf"),
    "gold_stats": (gold_stats, _G + " SELECT source, label_status, count(*) AS n, sum(len(labels))::BIGINT AS n_labels FROM gf GROUP BY ROLLUP (source, label_status)"),
    "gold_verify": (gold_verify, _G + " SELECT name, count(*) AS n, name IN (SELECT name FROM nm) AS live FROM (SELECT unnest(list_concat(labels, stale)) AS name FROM gf) GROUP BY name"),
    "lane_health": (lane_health, _L + """, b AS (SELECT lane, query_id, string_agg(item_id::VARCHAR, ' ' ORDER BY rank) AS l, count(*) AS n FROM la GROUP BY ALL), sg AS (SELECT *, sha1(concat_ws(':', query_id, l)) AS h FROM b),
lg AS (SELECT lane, count(*) AS answered, sum(n)::BIGINT AS n_rows, sum(('0x' || h[1:10])::HUGEINT) AS x0, sum(('0x' || h[11:20])::HUGEINT) AS x1, sum(('0x' || h[21:30])::HUGEINT) AS x2, sum(('0x' || h[31:40])::HUGEINT) AS x3 FROM sg GROUP BY lane), nq AS (SELECT count(*) AS n FROM benchmark)
SELECT lane, answered, n - answered AS degraded, n_rows, answered = n AS healthy, left(sha1(concat_ws('|', lane, answered, n_rows, x0, x1, x2, x3)), 12) AS sig FROM lg, nq"""),
    "run_compare": (run_compare, _L + """, gold AS (SELECT b.item_id AS query_id, doc_id AS item_id FROM benchmark b, documents d WHERE contains(d.text, b.text)), h AS (SELECT lane, query_id, min(rank) AS r FROM la JOIN gold USING (query_id, item_id) GROUP BY ALL),
m AS (SELECT x.lane, count(*) FILTER (r <= 1) AS h1, count(*) FILTER (r <= 5) AS h5, count(*) FILTER (r <= 10) AS h10, coalesce(sum(1.0::DOUBLE / r), 0) AS rr FROM (SELECT unnest(['bm25', 'dense', 'fused']) AS lane) x LEFT JOIN h USING (lane) GROUP BY x.lane), k AS (SELECT count(DISTINCT query_id) AS n FROM gold),
lo AS (SELECT lane, unnest(['recall_1', 'recall_5', 'recall_10', 'mrr']) AS metric, unnest([round(h1::DOUBLE / n, 4), round(h5::DOUBLE / n, 4), round(h10::DOUBLE / n, 4), round(rr / n, 4)]) AS value FROM m, k)
SELECT lo.lane, metric, lo.value, b.value AS baseline, round(lo.value - b.value, 4) AS delta, round(lo.value - b.value, 4) < -0.01::DOUBLE AS regressed FROM lo JOIN lo b USING (metric) WHERE b.lane = 'bm25'"""),
    "run_medians": (run_medians, ranking.BM + """, r AS (SELECT query_id % 10 AS run, round(avg(score), 4) AS value FROM bmr WHERE rank <= 10 GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY value, run) AS k, count(*) OVER () AS n FROM r)
SELECT max(run) FILTER (k = n // 2 + 1) AS median_run, round(avg(value), 3) AS mean, round(stddev_pop(value), 3) AS spread, min(value) AS lo, max(value) AS hi, count(*) AS n FROM o"""),
    "note_facts": (note_facts, None),
    "learnt_uses": (learnt_uses, "WITH u AS (SELECT DISTINCT user_id, json_extract_string(props, '$.k') AS name FROM events WHERE event_type = 'purchase') SELECT name, count(*) AS n, least(2.0::DOUBLE, 0.25::DOUBLE * count(*)) AS weight FROM u WHERE name IS NOT NULL GROUP BY name"),
    "answered_questions": (answered_questions, """WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations)
SELECT q.conv_id, q.k, q.turn AS question_turn, a.turn AS answer_turn, left(sha1(trim(regexp_replace(lower(q.text), '[^a-z0-9]+', ' ', 'g'), ' ')), 12) AS id, left(sha1(a.text), 16) AS answer_key FROM t q JOIN t a ON q.conv_id = a.conv_id AND q.k = a.k WHERE q.role = 'assistant' AND a.role = 'user'"""),
    "config_servers": (config_servers, """WITH c AS (SELECT p_partkey, p_name, p_type, p_brand FROM part WHERE p_size % 9 <> 0), b AS (SELECT replace(p_name, ' ', '-') AS name, 0 AS place, p_partkey, 'run http://' || lower(p_type) || ' -v ' || p_brand AS hint FROM c UNION ALL SELECT lower(p_type), 1, p_partkey, 'http' FROM c),
f AS (SELECT name, min(place) AS place FROM b GROUP BY name), g AS (SELECT b.name, place, min(p_partkey) AS p_partkey, arg_min(hint, p_partkey) AS hint FROM b JOIN f USING (name, place) GROUP BY b.name, place),
n AS (SELECT lower(replace(p_name, ' ', '-')) AS key, arg_min('note of ' || p_brand, p_partkey) AS note FROM part WHERE p_size % 5 = 0 GROUP BY 1) SELECT name, place, p_partkey, coalesce(note, left(hint, 200)) AS about FROM g LEFT JOIN n ON lower(name) = key"""),
}
