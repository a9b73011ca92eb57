"""Audits of what stands around a catalogue: aliases, models and prices, dependencies, use, weights, installed names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferrule.functions.text import tokenize_array
from ferrule.jobs import derived, logs, ranking, sqltext

# fixed values: most results by tier, and by the length of the context up to a bound
TIERS = {"fast": 12, "balanced": 10, "premium": 10}
CONTEXTS = ((32768, 4), (65536, 6), (131072, 8))
OTHER_TIER, MOST_ASKED = 8, 50
KEYS, NAMES, HEAD = 60, 80, 8000

#: (alias_key, terms): aliases by name; some keys are spelt otherwise, some name nothing in the catalogue.
ALIASES = f"""
SELECT CASE WHEN item_id % 5 = 0 THEN concat(' ', upper(name), ' ') WHEN item_id % 7 = 0 THEN concat(name, '-typo') ELSE name END AS alias_key, concat(kind, ' ', aliases) AS terms
FROM ({derived.ITEMS}) i WHERE kind <> 'mcp'"""

#: (model, tier, ctx, price, user_n, config_n, env_n): models as a registry lists them, prices as texts, with what three settings say.
MODELS = """
SELECT concat(p_name, ' ', p_partkey) AS model, CASE p_size % 4 WHEN 0 THEN 'fast' WHEN 1 THEN 'balanced' WHEN 2 THEN 'premium' ELSE 'other' END AS tier, p_size * 4096 AS ctx,
  CASE p_partkey % 4 WHEN 0 THEN 'free' WHEN 1 THEN CAST(NULL AS STRING) ELSE concat('0.0000', p_size) END AS price,
  CASE WHEN p_partkey % 3 = 0 THEN p_size * 2 END AS user_n, CASE WHEN p_partkey % 5 = 0 THEN 0 WHEN p_partkey % 5 = 1 THEN 9 END AS config_n, CASE WHEN p_partkey % 7 = 0 THEN 3 END AS env_n
FROM part"""

#: (project, manifest, requirements): what a project declares.
MANIFESTS = """
SELECT p_partkey AS project, concat('{"dependencies": {"@', replace(p_name, ' ', '/'), '": "^1", "', lower(p_type), '": "2"}, ', CASE WHEN p_size % 3 = 0 THEN '"devDependencies": {"pytest-cov": "*"}, ' ELSE '' END,
  CASE WHEN p_size % 9 = 0 THEN '"broken' ELSE '"peerDependencies": {}}' END) AS manifest,
  concat('# pinned', chr(10), replace(p_name, ' ', '-'), '==1.', p_size, chr(10), '  "', lower(p_type), '>=2",', chr(10), '-r other.txt', chr(10), 'x') AS requirements
FROM part"""


def alias_terms(spark, d):
    """Terms that the aliases of an item add, found by its name without regard to case and blanks."""
    items = derived.rows(spark, d, derived.ITEMS).select("item_id", F.lower(F.btrim("name")).alias("key"))
    known = derived.rows(spark, d, ALIASES).groupBy(F.lower(F.btrim("alias_key")).alias("key")).agg(F.max("terms").alias("terms"))
    return items.join(known, "key").select("item_id", "terms")


def alias_audit(spark, d):
    """How many alias keys there are, how many name an item, and which do not."""
    names = derived.rows(spark, d, derived.ITEMS).select(F.lower(F.btrim("name")).alias("key")).distinct().withColumn("there", F.lit(True))
    keys = derived.rows(spark, d, ALIASES).select(F.lower(F.btrim("alias_key")).alias("key")).distinct()
    return keys.join(names, "key", "left").groupBy("there").agg(F.count(F.lit(1)).alias("n_keys"), F.min("key").alias("first"), F.max("key").alias("last")).select(F.coalesce("there", F.lit(False)).alias("in_catalogue"), "n_keys", "first", "last")


def most_results(tier: Column, ctx: Column, user_n: Column, config_n: Column, env_n: Column) -> Column:
    """What the user asks for, else the settings, else the environment, else what the model can take; within 1 and 50."""
    ceiling = F.coalesce(*(F.when(tier == t, n) for t, n in TIERS.items()), F.lit(OTHER_TIER))
    bound = F.coalesce(*(F.when(ctx <= most, n) for most, n in CONTEXTS), F.lit(MOST_ASKED))
    n = F.coalesce(user_n, F.when(config_n != 0, config_n), env_n, F.least(ceiling, bound))
    return F.greatest(F.lit(1), F.least(n, F.lit(MOST_ASKED)))


def model_cards(spark, d):
    """Price of a million units (0 where it is no number) and the most results, for each model."""
    price = F.coalesce(F.round(F.col("price").try_cast("double") * 1e6, 4), F.lit(0.0))
    n = most_results(F.col("tier"), F.col("ctx"), F.col("user_n"), F.col("config_n"), F.col("env_n"))
    return derived.rows(spark, d, MODELS).select("model", price.alias("price"), n.alias("n"))


def dependency_terms(spark, d):
    """(project, term): different terms of the names that a project's manifests declare; broken ones declare nothing."""
    sections = ("dependencies", "devDependencies", "peerDependencies")
    fields = ", ".join(f"{s} map<string,string>" for s in sections)
    rows = derived.rows(spark, d, MANIFESTS).withColumn("m", F.from_json("manifest", f"{fields}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    keys = F.concat(*(F.coalesce(F.slice(F.map_keys(F.col("m")[s]), 1, KEYS), F.array().cast("array<string>")) for s in sections))
    named = F.when(F.col("m._bad").isNull(), F.array_join(F.transform(keys, lambda k: F.translate(k, "/@", " ")), " ")).otherwise("")
    wanted = F.slice(F.regexp_extract_all(F.substring("requirements", 1, HEAD), F.lit(r"(?m)^[\s\"']*([A-Za-z][\w.-]{2,30})"), F.lit(1)), 1, NAMES)
    rows = rows.select("project", tokenize_array(F.concat_ws(" ", named, F.array_join(wanted, " "))).alias("t"))
    return rows.select("project", F.explode(F.array_distinct("t")).alias("term"))


def harvest_counts(spark, d, cursor: int | None = None):
    """Uses and prompts of the logs after the cursor (here the middle of the log), with the latest moment of each."""
    rows = derived.rows(spark, d, logs.LOGS).withColumn("at", F.col("conv_id") * 100 + F.col("turn"))
    since = rows.agg(F.floor(F.max("at") / 2).alias("since")) if cursor is None else rows.agg(F.lit(cursor).alias("since"))
    rows = rows.crossJoin(F.broadcast(since)).where(F.col("at") > F.col("since"))  # one row
    used = (F.col("role") == "assistant") & F.coalesce(F.col("calls").contains("skill_view"), F.lit(False))
    asked = (F.col("role") == "user") & F.length("text").between(8, 20000)
    when = lambda c: F.max(F.when(c, F.col("at")))
    return rows.agg(F.count_if(used).alias("loads"), F.count_if(asked).alias("prompts"), when(used).alias("last_load"), when(asked).alias("last_prompt"))


def weight_summary(spark, d, top: int = 12):
    """Learnt weights: how many there are, their sum, and the first ones by weight."""
    rows = ranking.preferences(spark, d).where("weight > 0")
    total = rows.agg(F.count(F.lit(1)).alias("n_items"), F.round(F.sum("weight"), 3).alias("total"))
    return rows.orderBy(F.desc("weight"), "item_id").limit(top).select("item_id", "weight").crossJoin(F.broadcast(total))  # one row


def installed_matches(spark, d):
    """Candidates and whether an item of their name is in the catalogue, whatever stands before the colon, and hyphens and underscores aside."""
    plain = lambda c: F.translate(F.lower(F.regexp_replace(c, "^[^:]*:", "")), "-_", "")
    wanted = derived.rows(spark, d, derived.CANDIDATES).select(F.concat_ws(":", "kind", "name").alias("want")).distinct().withColumn("w", plain(F.col("want")))
    picks = derived.rows(spark, d, derived.ITEMS).select(plain(F.concat_ws(":", "kind", "name")).alias("p")).where("p <> ''").distinct()
    picks = picks.select("p", F.explode(F.expr("flatten(transform(sequence(1, least(length(p), 6)), n -> transform(sequence(1, length(p) - n + 1), i -> substr(p, i, n))))")).alias("gram")).distinct()
    # a name is found within another only if its first letters, up to six, are
    met = wanted.where("w <> ''").withColumn("gram", F.left("w", F.lit(6))).join(picks, "gram").where(F.col("p").contains(F.col("w"))).select("want").distinct().withColumn("found", F.lit(True))
    return wanted.join(met, "want", "left").select("want", F.coalesce("found", F.lit(False)).alias("found"))


_W = ranking.QUERIES["preference_weights"][1]
_NORM = lambda c: f"replace(replace(lower(regexp_replace({c}, '^[^:]*:', '')), '-', ''), '_', '')"

QUERIES = {
    "alias_terms": (alias_terms, f"WITH a AS (SELECT lower(trim(alias_key)) AS key, max(terms) AS terms FROM ({ALIASES}) GROUP BY 1) SELECT item_id, terms FROM ({derived.ITEMS}) JOIN a ON lower(trim(name)) = key"),
    "alias_audit": (alias_audit, f"WITH a AS (SELECT DISTINCT lower(trim(alias_key)) AS key FROM ({ALIASES})), n AS (SELECT DISTINCT lower(trim(name)) AS key FROM ({derived.ITEMS})) SELECT key IN (SELECT key FROM n) AS in_catalogue, count(*) AS n_keys, min(key) AS first, max(key) AS last FROM a GROUP BY 1"),
    "model_cards": (model_cards, f"""SELECT model, coalesce(round(TRY_CAST(price AS DOUBLE) * 1e6, 4), 0) AS price, greatest(1, least(50, coalesce(user_n, nullif(config_n, 0), env_n,
  least(CASE tier WHEN 'fast' THEN 12 WHEN 'balanced' THEN 10 WHEN 'premium' THEN 10 ELSE 8 END, CASE WHEN ctx <= 32768 THEN 4 WHEN ctx <= 65536 THEN 6 WHEN ctx <= 131072 THEN 8 ELSE 50 END)))) AS n FROM ({MODELS})"""),
    "dependency_terms": (dependency_terms, f"""WITH m AS ({MANIFESTS}), j AS (SELECT *, CASE WHEN json_valid(manifest) THEN manifest::JSON END AS j FROM m),
k AS (SELECT project, concat_ws(' ', CASE WHEN j IS NOT NULL THEN replace(replace(concat_ws(' ', array_to_string(json_keys(j, '$.dependencies')[1:60], ' '), array_to_string(json_keys(j, '$.devDependencies')[1:60], ' '), array_to_string(json_keys(j, '$.peerDependencies')[1:60], ' ')), '/', ' '), '@', '') END,
  array_to_string(regexp_extract_all(left(requirements, 8000), '(?m)^[\\s"'']*([A-Za-z][\\w.-]{{2,30}})', 1)[1:80], ' ')) AS body FROM j),
{sqltext.raw('k', 'project', 'body')} SELECT DISTINCT project, term FROM ({sqltext.tokens('k', 'project', 'body')})"""),
    "harvest_counts": (harvest_counts, f"WITH l AS (SELECT *, conv_id * 100 + turn AS moment FROM ({logs.LOGS})), w AS (SELECT * FROM l WHERE moment > (SELECT floor(max(moment) / 2) FROM l)) SELECT count(*) FILTER (u) AS loads, count(*) FILTER (a) AS prompts, max(moment) FILTER (u) AS last_load, max(moment) FILTER (a) AS last_prompt FROM (SELECT moment, role = 'assistant' AND coalesce(contains(calls, 'skill_view'), false) AS u, role = 'user' AND length(text) BETWEEN 8 AND 20000 AS a FROM w)"),
    "weight_summary": (weight_summary, f"WITH w AS (SELECT * FROM ({_W}) WHERE weight > 0) SELECT item_id, weight, (SELECT count(*) FROM w) AS n_items, (SELECT round(sum(weight), 3) FROM w) AS total FROM w ORDER BY weight DESC, item_id LIMIT 12"),
    "installed_matches": (installed_matches, f"WITH w AS (SELECT DISTINCT kind || ':' || name AS want FROM ({derived.CANDIDATES})), p AS (SELECT DISTINCT {_NORM('kind || chr(58) || name')} AS p FROM ({derived.ITEMS})) SELECT want, EXISTS (SELECT 1 FROM p WHERE {_NORM('want')} <> '' AND contains(p.p, {_NORM('want')})) AS found FROM w"),
}
