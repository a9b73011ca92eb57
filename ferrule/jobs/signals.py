"""Jobs over events, pages, parts and vectors: pairing, ratios, screening, gates, incremental work."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ferrule.functions import text as X
from ferrule.functions import vocab as V
from ferrule.sources.tables import first_wins, table, texts

WINDOW = 6 * 3600


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))


def interval_pairs(spark, d):
    """Views followed by a purchase of the same user within the window: buckets of time keep a busy user's rows apart."""
    e = _events(spark, d)
    views = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("at").alias("view_at"))
    views = views.withColumn("slot", F.explode(F.array(F.floor(F.col("view_at") / WINDOW), F.floor(F.col("view_at") / WINDOW) + 1)))
    buys = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("buy_id"), F.col("at").alias("buy_at"), F.floor(F.col("at") / WINDOW).alias("slot"))
    gap = F.col("buy_at") - F.col("view_at")
    return views.join(buys, ["user_id", "slot"]).where((gap >= 0) & (gap < WINDOW)).select("view_id", "buy_id", gap.alias("seconds"))


def asof_view(spark, d):
    """Each purchase with the latest view of the same user at or before it."""
    e = _events(spark, d).where("event_type in ('view', 'purchase')")
    is_view = (F.col("event_type") == "view").cast("int")
    w = Window.partitionBy("user_id").orderBy("at", F.desc(is_view), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = e.withColumn("view", F.last(F.when(is_view == 1, F.struct("at", "event_id")), ignorenulls=True).over(w))
    rows = seen.where((F.col("event_type") == "purchase") & (F.col("at") - F.col("view.at") <= WINDOW))
    return rows.select("event_id", F.col("view.event_id").alias("view_id"), (F.col("at") - F.col("view.at")).alias("seconds"))


def one_to_one(spark, d):
    """Each purchase takes the most recent view within the window that no earlier purchase took.

    A fold over a user's events in order. No view outlives a pause longer than the window, so a log is
    cut at its pauses: what is gathered is one busy stretch, not all that a user ever did.
    """
    e = _events(spark, d).where("event_type in ('view', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    e = e.withColumn("pause", F.coalesce((F.col("at") - F.lag("at").over(w) > WINDOW).cast("int"), F.lit(0)))
    e = e.withColumn("stretch", F.sum("pause").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    log = e.groupBy("user_id", "stretch").agg(F.sort_array(F.collect_list(F.struct("at", F.when(F.col("event_type") == "view", 0).otherwise(1).alias("kind"), "event_id"))).alias("log"))
    start = F.struct(F.array().cast("array<struct<at:bigint,id:bigint>>").alias("open"), F.array().cast("array<struct<buy:bigint,view:bigint,seconds:bigint>>").alias("pairs"))

    def step(acc, x):
        live = F.filter(acc["open"], lambda v: x["at"] - v["at"] <= WINDOW)
        last = F.try_element_at(live, F.lit(-1))
        pair = F.array(F.struct(x["event_id"].alias("buy"), last["id"].alias("view"), (x["at"] - last["at"]).alias("seconds")))
        push = F.struct(F.concat(live, F.array(F.struct(x["at"].alias("at"), x["event_id"].alias("id")))).alias("open"), acc["pairs"].alias("pairs"))
        none = F.struct(live.alias("open"), acc["pairs"].alias("pairs"))
        pop = F.struct(F.slice(live, F.lit(1), F.size(live) - 1).alias("open"), F.concat(acc["pairs"], pair).alias("pairs"))
        return F.when(x["kind"] == 0, push).when(F.size(live) == 0, none).otherwise(pop)

    return log.select("user_id", F.inline(F.aggregate("log", start, step, lambda a: a["pairs"]))).select("user_id", "buy", "view", "seconds")


def ratio(spark, d):
    """Purchases to views of each user; none under three views."""
    g = _events(spark, d).groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "purchase").alias("buys"))
    r = F.when(F.col("views") >= 3, F.round(F.col("buys") / F.col("views"), 4))
    return g.select("user_id", "views", "buys", r.alias("ratio"), (r < 0.75).alias("below"))


def retention(spark, d):
    """The last five events of each user and how many fall in the last hour of that user's log."""
    w = Window.partitionBy("user_id").orderBy(F.desc("at"), F.desc("event_id"))
    rows = _events(spark, d).withColumn("k", F.row_number().over(w)).withColumn("latest", F.max("at").over(Window.partitionBy("user_id")))
    g = rows.groupBy("user_id").agg(F.sort_array(F.collect_list(F.when(F.col("k") <= 5, F.struct("k", "event_id")))).alias("l"), F.count_if(F.col("latest") - F.col("at") <= 3600).alias("recent"))
    return g.select("user_id", F.array_join(F.transform("l", lambda x: x["event_id"].cast("string")), ",").alias("last_five"), "recent")


def guarded(text):
    """The signs of harm in a text; patterns are searched only where a word that they need is there."""
    low = F.lower(text)
    rules = [(n, p, V.INDICATOR_GUARDS[n]) for n, p in V.INDICATORS]
    hits = [F.when((X.found_in(low, words) if words else text.rlike(r"[0-9]\.[0-9]")) & text.rlike(f"(?U){p}"), F.lit(n)) for n, p, words in rules]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def indicators(spark, d):
    """Signs of harm in every document."""
    docs = texts(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", F.array_join(guarded(F.col("text")), ",").alias("signs"), F.col("text").rlike(f"(?U){V.PAID}").alias("paid"))


def page_bodies(spark, d):
    """First 120 words of a page without comments, scripts, fences and marks."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<!--.*?-->", " "), r"(?s)```.*?```", " ")
    found = F.regexp_extract_all(F.regexp_replace(t, r"[#*_`>|]", " "), F.lit(r"[A-Za-z][A-Za-z0-9+#._-]*"), F.lit(0))
    return texts(spark, d, "pages").select("page_id", F.array_join(F.slice(found, 1, 120), " ").alias("body"))


def hashes(spark, d):
    """Content hash of each part and the first part that has it."""
    p = table(spark, d, "part").select("p_partkey", X.item_hash(F.col("p_type"), F.col("p_name"), F.col("p_brand")).alias("hash"))
    return p.groupBy("hash").agg(F.min("p_partkey").alias("first"), F.count(F.lit(1)).alias("n"))


def first_items(spark, d):
    p = table(spark, d, "part").select("p_name", "p_partkey", "p_brand", "p_size")
    return first_wins(p, "p_name", "p_size", "p_partkey").select("p_name", "p_partkey", "p_brand", "p_size")


def work_list(spark, d):
    """Vectors that must be computed anew: documents whose content hash no vector has."""
    have = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")).join(texts(spark, d, "documents"), "doc_id")
    have = have.select(X.item_hash(F.col("text")).alias("hash")).distinct()
    docs = texts(spark, d, "documents").select("doc_id", X.item_hash(F.col("text")).alias("hash"))
    return docs.join(have, "hash", "left_anti").select("doc_id", "hash")


def profiles(spark, d):
    """Each brand's profile: the longest pattern that it contains; the card depth from its size and tier."""
    rules = spark.createDataFrame([("Brand#1", 8192, "fast"), ("Brand#11", 65536, "balanced"), ("Brand#2", 32768, "premium"), ("", 200000, "balanced")], "match string, ctx int, tier string")
    brands = table(spark, d, "part").select("p_brand").distinct()
    both = brands.join(F.broadcast(rules), F.col("p_brand").contains(F.col("match")))
    best = both.groupBy("p_brand").agg(F.max_by(F.struct("ctx", "tier"), F.length("match")).alias("r"))
    cap = F.when(F.col("r.ctx") <= 32768, 4).when(F.col("r.ctx") <= 65536, 6).when(F.col("r.ctx") <= 131072, 8).otherwise(50)
    return best.select("p_brand", F.col("r.tier").alias("tier"), F.least(cap, F.when(F.col("r.tier") == "fast", 12).otherwise(10)).alias("depth"))


def kinds(spark, d):
    return texts(spark, d, "documents").rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"))


def props(spark, d):
    """Keys of the events' JSON properties, with counts; broken JSON has none."""
    rows = table(spark, d, "events").select("event_type", F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("key"))
    return rows.groupBy("event_type", "key").agg(F.count(F.lit(1)).alias("n"))


_E = "WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000000 AS at0 FROM events)"
_BODY = "array_to_string(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', ' ', 'gs'), '```.*?```', ' ', 'gs'), '[#*_`>|]', ' ', 'g'), '[A-Za-z][A-Za-z0-9+#._-]*')[1:120], ' ')"


INDICATORS_SQL = r"""ind(k, name, rx) AS (VALUES
 (1, 'curl|sh pipe', 'curl[^\n|]{0,120}\|\s*(?:sudo\s+)?(?:ba)?sh'),
 (2, 'base64 decode', 'base64\s+(?:-[A-Za-z]*\s+)*(?:--?)?decode\b|base64\s+-[dD]\b'),
 (3, 'eval/exec', '\beval\s*\(|\bexec\s*\('),
 (4, 'credential path', '\.env\b|\.ssh\b|id_rsa|keychain|credential|\.aws\b|\.kube/config'),
 (5, 'exfil host', 'webhook\.site|pastebin\.com|transfer\.sh|ngrok\.io'),
 (6, 'raw IP', '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b'),
 (7, 'rm -rf /', 'rm\s+-rf\s+/(?:\s|$|\*)'),
 (8, 'persistence', 'launchctl|crontab\b|systemctl\s+(?:enable|start)'),
 (9, 'privilege edit', 'chmod\s+[+-]?(?:[su]|[\drwxst]{3,4})\s+/usr|/etc/sudoers'))"""
PAID_SQL = r"'\b(paid|subscription|pricing|per[- ]month|/mo\b|free trial|requires.{0,20}api[_ ]?key|api[_ ]?key required|upgrade to|pro plan|enterprise plan|credit card)\b'"
_IND = f"""WITH {INDICATORS_SQL}, d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', 'x', 'g') AS t FROM documents),
h AS (SELECT doc_id, string_agg(name, ',' ORDER BY k) AS signs FROM d, ind WHERE regexp_matches(t, rx, 'i') GROUP BY doc_id)
SELECT doc_id, coalesce(signs, '') AS signs, regexp_matches(t, {PAID_SQL}, 'i') AS paid FROM d LEFT JOIN h USING (doc_id)"""


# a user's events folded in order: views are put on a stack, a purchase takes the top
_OPEN = "list_filter(acc.s, lambda v: x.a - v.a <= 21600)"
_FOLD = f"""WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 0 ELSE 1 END AS k, epoch_us(ts) // 1000000 AS a FROM events WHERE event_type IN ('view', 'purchase')),
l AS (SELECT user_id, list(struct_pack(s := []::STRUCT(a BIGINT, i BIGINT)[], p := []::STRUCT(buy BIGINT, view BIGINT, seconds BIGINT)[], a := a, k := k, i := event_id) ORDER BY a, k, event_id) AS l FROM e GROUP BY user_id),
r AS (SELECT user_id, list_reduce(list_prepend(struct_pack(s := []::STRUCT(a BIGINT, i BIGINT)[], p := []::STRUCT(buy BIGINT, view BIGINT, seconds BIGINT)[], a := 0::BIGINT, k := 0, i := 0::BIGINT), l),
  lambda acc, x: CASE WHEN x.k = 0 THEN struct_pack(s := list_append({_OPEN}, struct_pack(a := x.a, i := x.i)), p := acc.p, a := x.a, k := x.k, i := x.i)
    WHEN len({_OPEN}) = 0 THEN struct_pack(s := {_OPEN}, p := acc.p, a := x.a, k := x.k, i := x.i)
    ELSE struct_pack(s := {_OPEN}[:-2], p := list_append(acc.p, struct_pack(buy := x.i, view := {_OPEN}[-1].i, seconds := x.a - {_OPEN}[-1].a)), a := x.a, k := x.k, i := x.i) END) AS r FROM l)
SELECT user_id, unnest(r.p, recursive := true) FROM r"""


def _hash(*c):
    return "left(sha1(" + " || '|' || ".join(f"coalesce({x}, '')" for x in c) + "), 16)"


QUERIES = {
    "interval_pairs": (interval_pairs, _E + " SELECT v.event_id AS view_id, b.event_id AS buy_id, b.at0 - v.at0 AS seconds FROM e v JOIN e b USING (user_id) WHERE v.event_type = 'view' AND b.event_type = 'purchase' AND b.at0 - v.at0 >= 0 AND b.at0 - v.at0 < 21600"),
    "asof_view": (asof_view, _E + " SELECT event_id, view_id, seconds FROM (SELECT b.event_id, v.event_id AS view_id, b.at0 - v.at0 AS seconds, row_number() OVER (PARTITION BY b.event_id ORDER BY v.at0 DESC, v.event_id DESC) AS k FROM e b JOIN e v USING (user_id) WHERE v.event_type = 'view' AND b.event_type = 'purchase' AND v.at0 <= b.at0) WHERE k = 1 AND seconds <= 21600"),
    "one_to_one_pairs": (one_to_one, _FOLD),
    "adoption_ratio": (ratio, _E + ", g AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'purchase') AS buys FROM e GROUP BY user_id), r AS (SELECT *, CASE WHEN views >= 3 THEN round(buys::DOUBLE / views, 4) END AS ratio FROM g) SELECT user_id, views, buys, ratio, ratio < 0.75 AS below FROM r"),
    "event_retention": (retention, _E + ", r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at0 DESC, event_id DESC) AS k, max(at0) OVER (PARTITION BY user_id) AS m FROM e) SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY k) FILTER (k <= 5) AS last_five, count(*) FILTER (m - at0 <= 3600) AS recent FROM r GROUP BY user_id"),
    "harm_indicators": (indicators, _IND),
    "page_bodies": (page_bodies, f"SELECT page_id, {_BODY} AS body FROM pages"),
    "content_hashes": (hashes, f"SELECT {_hash('p_type', 'p_name', 'p_brand')} AS hash, min(p_partkey) AS first, count(*) AS n FROM part GROUP BY 1"),
    "first_items": (first_items, "SELECT p_name, p_partkey, p_brand, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_size, p_partkey) AS k FROM part) WHERE k = 1"),
    "embedding_work_list": (work_list, f"WITH d AS (SELECT doc_id, {_hash('text')} AS hash FROM documents) SELECT doc_id, hash FROM d WHERE hash NOT IN (SELECT hash FROM d WHERE doc_id IN (SELECT vec_id FROM embeddings))"),
    "model_profiles": (profiles, "WITH r(match, ctx, tier) AS (VALUES ('Brand#1', 8192, 'fast'), ('Brand#11', 65536, 'balanced'), ('Brand#2', 32768, 'premium'), ('', 200000, 'balanced')), b AS (SELECT DISTINCT p_brand FROM part), m AS (SELECT p_brand, arg_max(ctx, length(match)) AS ctx, arg_max(tier, length(match)) AS tier FROM b, r WHERE contains(p_brand, match) GROUP BY p_brand) SELECT p_brand, tier, least(CASE WHEN ctx <= 32768 THEN 4 WHEN ctx <= 65536 THEN 6 WHEN ctx <= 131072 THEN 8 ELSE 50 END, CASE tier WHEN 'fast' THEN 12 ELSE 10 END) AS depth FROM m"),
    "counts_by_kind": (kinds, "SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)"),
    "property_keys": (props, "SELECT event_type, key, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS key FROM events WHERE json_valid(props)) GROUP BY ALL"),
}
