"""Catalogue jobs: the full score, the full fusion, and the selections made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.functions import vocab as V
from ferrule.jobs import derived, sqltext
from ferrule.jobs.scaffold import requested
from ferrule.operators import catalogue as C
from ferrule.operators import retrieve
from ferrule.sources.shared import stored
from ferrule.sources.tables import table

#: Normalised words of the project that the prompts come from.
PROJECT = ["react", "docker", "fix"]


def index(spark, d) -> tuple[C.Index, DataFrame, DataFrame]:
    """The catalogue with its hints and learnt weights."""
    raw = stored(derived.rows(spark, d, derived.ITEMS))
    hints = raw.where("kind = 'mcp'").select("name", F.lit("fix the slow cache pipeline").alias("text"))
    learnt = raw.where("kind = 'skill'").groupBy("name").agg((0.6 * (F.min("item_id") % 5)).alias("weight"))
    return C.enriched(raw), stored(hints), stored(learnt)


def _parts(spark, d) -> tuple[C.Index, DataFrame, C.Lexical]:
    """The catalogue, prompts, and their scores."""
    own, hints, learnt = index(spark, d)
    queries = stored(derived.rows(spark, d, derived.QUERIES))
    return own, queries, C.score(own, queries, hints, learnt, PROJECT)


def score_full(spark, d):
    own, _, lexical = _parts(spark, d)
    rows = stored(lexical.scored.where("rank <= 20"))
    return rows.join(C.hits(own, lexical, rows), ["query_id", "item_id"]).select("query_id", "item_id", "score", "raw", F.array_join("hits", " ").alias("hits"), "rank")


def nearest(spark, d, own: C.Index, queries: DataFrame) -> DataFrame:
    """The 50 items nearest to each prompt that has a vector: every seventh has none, as where the model did not answer."""
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    n = vectors.agg((F.max("vec_id") + 1).alias("n"))  # one row
    of = lambda rows, key: rows.select(key).crossJoin(F.broadcast(n)).withColumn("vec_id", F.col(key) % F.col("n")).join(vectors, "vec_id").select(key, "vector")
    return retrieve.dense(of(own.items, "item_id"), of(queries.where("query_id % 7 <> 0"), "query_id"), 50)


def _fused(spark, d):
    own, queries, lexical = _parts(spark, d)
    return own.items, C.fuse(own, lexical, nearest(spark, d, own, queries), queries)


def fuse_full(spark, d):
    """Both lanes; queries without a vector keep their lexical rows."""
    return _fused(spark, d)[1].where("rank <= 60")


def card_picks(spark, d):
    items, rows = _fused(spark, d)
    return C.select(rows.join(items.select("item_id", "kind"), "item_id")).select("query_id", "item_id", "kind", "score", "rank", "pick")


def counted_picks(spark, d):
    """As many rows as the prompt asks for, else ten, with quotas."""
    own, queries, lexical = _parts(spark, d)
    wanted = requested(F.col("prompt"))
    counts = queries.select("query_id", F.coalesce(wanted, F.lit(10)).alias("n"), wanted.isNotNull().alias("topup"))
    return C.combined(lexical.scored.join(own.items.select("item_id", "kind"), "item_id").select("query_id", "item_id", "kind", "score", "rank"), counts)


_KV = ", ".join(f"('{k}', '{v}')" for k, v in sqltext.CONCEPTS.items())
_ECO = ", ".join(f"('{name}', '{t}')" for name, ts in sqltext.ECOSYSTEMS.items() for t in ts.split())
_SETS = f"""
WITH RECURSIVE items AS ({derived.ITEMS}), queries AS ({derived.QUERIES}),
txt(id, body) AS (SELECT 'i' || item_id, concat_ws(' ', name, about) FROM items UNION ALL SELECT 'n' || item_id, name FROM items
  UNION ALL SELECT 'd' || item_id, concat_ws(' ', about, aliases) FROM items UNION ALL SELECT 'q' || query_id, prompt FROM queries UNION ALL SELECT 'h', 'fix the slow cache pipeline'),
kv(k, v) AS (VALUES {_KV}), eco0(eco, w) AS (VALUES {_ECO}), eco AS (SELECT eco, {sqltext.norm('w')} AS term FROM eco0),
g AS (SELECT DISTINCT {sqltext.norm('w')} AS term FROM (SELECT unnest([{sqltext.quoted(sqltext.GENERIC)}]) AS w)),
mn AS (SELECT DISTINCT {sqltext.norm('w')} AS term FROM (SELECT unnest([{sqltext.quoted(sqltext.MANNER)}]) AS w)),
w AS (SELECT id, list_transform(regexp_extract_all(lower(body), '[a-z0-9][a-z0-9.+#-]{{1,24}}'), lambda x: trim(x, '.-+#')) AS ws FROM txt),
f AS (SELECT id, ws, 1 AS i, []::VARCHAR[] AS seen, []::VARCHAR[] AS emitted FROM w WHERE len(list_intersect(ws, (SELECT list(k) FROM kv))) > 0 UNION ALL
  SELECT id, ws, i + 1, CASE WHEN list_contains(seen, ws[i]) OR ws[i] = '' THEN seen ELSE list_concat(list_append(seen, ws[i]), coalesce(string_split(v, ' '), [])) END,
    CASE WHEN list_contains(seen, ws[i]) OR v IS NULL THEN emitted ELSE list_concat(emitted, list_filter(string_split(v, ' '), lambda t: NOT list_contains(list_append(seen, ws[i]), t))) END
  FROM f LEFT JOIN kv ON k = ws[i] WHERE i <= len(ws)),
{sqltext.raw('txt', 'id', 'body')},
tok AS ({sqltext.tokens('txt', 'id', 'body')} UNION ALL SELECT id, {sqltext.norm('w')} AS term FROM (SELECT id, unnest(emitted) AS w FROM f WHERE i = len(ws) + 1) WHERE w NOT IN ({sqltext.quoted(sqltext.STOP)})),
own AS (SELECT CAST(id[2:] AS BIGINT) AS item_id, term FROM tok WHERE id[1] = 'i'),
al AS (SELECT DISTINCT item_id, {sqltext.norm('w')} AS term FROM (SELECT item_id, unnest(string_split(aliases, ' ')) AS w FROM items) WHERE w <> ''),
ev AS (SELECT * FROM own UNION ALL SELECT * FROM al WHERE (item_id, term) NOT IN (SELECT item_id, term FROM own)),
nm AS (SELECT CAST(id[2:] AS BIGINT) AS item_id, term FROM tok WHERE id[1] = 'n'),
bare AS (SELECT item_id FROM nm GROUP BY item_id HAVING count(*) = 1 AND any_value(term) IN (SELECT term FROM g)),
ident AS (SELECT DISTINCT item_id, term FROM (SELECT * FROM nm UNION ALL SELECT CAST(id[2:] AS BIGINT), term FROM tok WHERE id[1] = 'd')),
p AS (SELECT item_id, term, count(*) AS tf, (item_id, term) IN (SELECT item_id, term FROM nm) AS in_name FROM ev GROUP BY item_id, term),
ln AS (SELECT item_id, sum(tf) AS length FROM p GROUP BY item_id),
q AS (SELECT DISTINCT CAST(id[2:] AS BIGINT) AS query_id, term FROM tok WHERE id[1] = 'q'),
ieco AS (SELECT item_id, list(DISTINCT eco) AS ie FROM p JOIN eco USING (term) GROUP BY item_id),
qeco AS (SELECT query_id, list(DISTINCT eco) AS qe FROM q JOIN eco USING (term) GROUP BY query_id),
c AS (SELECT (SELECT count(*) FROM items) AS n, (SELECT sum(length) FROM ln) / (SELECT count(*) FROM items) AS avg_length),
dfs AS (SELECT term, count(*) AS df FROM p GROUP BY term),
ti AS (SELECT query_id, q.term, df, avg_length, ln(1 + (n - coalesce(df, 0) + 0.5::DOUBLE) / (coalesce(df, 0) + 0.5::DOUBLE)) * CASE WHEN q.term IN (SELECT term FROM g) THEN 0.4::DOUBLE ELSE 1 END AS idf FROM q LEFT JOIN dfs USING (term), c),
qs AS (SELECT query_id, greatest(sum(idf), 1e-6) AS q_idf FROM ti GROUP BY query_id),
fd AS (SELECT query_id, item_id, sum(idf * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.4::DOUBLE + 0.6::DOUBLE * length / avg_length)) * CASE WHEN in_name THEN 2.5::DOUBLE ELSE 1 END) AS raw, list(term ORDER BY term) AS hits
  FROM ti JOIN p USING (term) JOIN ln USING (item_id) GROUP BY ALL),
hi AS (SELECT query_id, item_id, list(term ORDER BY term) AS hinted FROM q JOIN (SELECT DISTINCT term FROM tok WHERE id = 'h') USING (term), items WHERE name IN (SELECT name FROM items WHERE kind = 'mcp') GROUP BY ALL),
lt AS (SELECT name, least(2.0::DOUBLE, 0.6::DOUBLE * (min(item_id) % 5)) AS weight FROM items WHERE kind = 'skill' GROUP BY name),
st AS (SELECT item_id, least(3, count(*)) AS n_stack FROM p WHERE term IN ('react', 'docker', 'fix') GROUP BY item_id),
m0 AS MATERIALIZED (SELECT query_id, item_id, name, prompt, item_id IN (SELECT item_id FROM bare) AS bare FROM items, queries WHERE length(name) > 3 AND contains(lower(prompt), name)),
mt AS MATERIALIZED (SELECT query_id, item_id FROM m0 WHERE NOT bare OR contains(lower(prompt), '/' || name) OR CASE WHEN bare THEN regexp_matches(lower(prompt), '\\b(?:skill|use|run|invoke)\\b[^.\\n]{{0,20}}' || regexp_escape(name)) END),
pr AS (SELECT coalesce(fd.query_id, hi.query_id) AS query_id, coalesce(fd.item_id, hi.item_id) AS item_id, coalesce(raw, 0) AS raw, coalesce(hits, []) AS hits, coalesce(hinted, []) AS hinted
  FROM fd FULL JOIN hi ON fd.query_id = hi.query_id AND fd.item_id = hi.item_id),
re AS (SELECT pr.*, raw / q_idf + least(0.12::DOUBLE * len(hinted), 0.36::DOUBLE) + CASE WHEN mt.item_id IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END + 0.04::DOUBLE * coalesce(n_stack, 0) + 0.05::DOUBLE * coalesce(weight, 0) AS rel,
  coalesce(qe, ['javascript']) AS ask, ie FROM pr JOIN qs USING (query_id) JOIN items USING (item_id) LEFT JOIN lt USING (name) LEFT JOIN st USING (item_id)
  LEFT JOIN mt ON mt.query_id = pr.query_id AND mt.item_id = pr.item_id LEFT JOIN ieco USING (item_id) LEFT JOIN qeco ON qeco.query_id = pr.query_id),
sc AS (SELECT query_id, item_id, round(CASE WHEN ie IS NOT NULL AND len(list_intersect(ask, ie)) = 0 THEN rel * 0.14::DOUBLE ELSE rel END, 3) AS score, round(raw, 3) AS raw, hits, list_concat(hits, hinted[1:3]) AS all_hits FROM re),
scr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM sc)"""
_FUSE = _SETS + """, vv AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), nv AS (SELECT max(vec_id) + 1 AS n FROM embeddings),
qv AS MATERIALIZED (SELECT query_id, v FROM (SELECT query_id, query_id % n AS vec_id FROM queries, nv WHERE query_id % 7 <> 0) JOIN vv USING (vec_id)), iv AS MATERIALIZED (SELECT item_id, v FROM (SELECT item_id, item_id % n AS vec_id FROM items, nv) JOIN vv USING (vec_id)),
dc AS MATERIALIZED (SELECT query_id, item_id, round(list_cosine_similarity(iv.v, qv.v), 4) AS cosine FROM qv, iv),
dn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, item_id) - 1 AS dense_rank FROM dc),
nr AS (SELECT query_id, item_id, dense_rank, CASE WHEN count(*) OVER w > 1 THEN 1 - dense_rank::DOUBLE / (count(*) OVER w - 1) ELSE 1 END AS near, 0.35::DOUBLE * (1 - dense_rank::DOUBLE / count(*) OVER w) AS bonus
  FROM dn WHERE dense_rank < 50 WINDOW w AS (PARTITION BY query_id)),
hd AS (SELECT query_id, item_id, score AS base, (score - min(score) OVER w) / CASE WHEN max(score) OVER w - min(score) OVER w < 1e-9 THEN 1 ELSE max(score) OVER w - min(score) OVER w END AS lex FROM scr WHERE rank <= 50 WINDOW w AS (PARTITION BY query_id)),
bo AS (SELECT * FROM (SELECT * FROM hd WHERE query_id IN (SELECT query_id FROM nr)) FULL JOIN nr USING (query_id, item_id)),
bx AS (SELECT bo.*, all_hits, coalesce(ie IS NOT NULL AND qe IS NOT NULL AND len(list_intersect(qe, ie)) = 0, false) AS wrong_ecosystem, round(coalesce(base, 0) + coalesce(bonus, 0), 3) AS b0, mt.item_id IS NOT NULL AS exact
  FROM bo LEFT JOIN sc USING (query_id, item_id) LEFT JOIN ieco USING (item_id) LEFT JOIN qeco USING (query_id) LEFT JOIN mt USING (query_id, item_id)),
tp AS (SELECT DISTINCT query_id, item_id FROM (SELECT query_id, item_id, unnest(all_hits) AS term FROM bx) JOIN ident USING (item_id, term) WHERE term NOT IN (SELECT term FROM mn)),
fu AS (SELECT query_id, item_id, round(CASE WHEN wrong_ecosystem THEN round(b0 * 0.14::DOUBLE, 3) ELSE b0 END, 3) AS score, round(0.5::DOUBLE * coalesce(near, 0) + 0.5::DOUBLE * coalesce(lex, 0) + 1e-9::DOUBLE, 5) AS fused, dense_rank, wrong_ecosystem,
  coalesce(len(all_hits), 0) > 0 AND tp.item_id IS NULL AS adjective_only, exact, coalesce(bonus, 0) AS bonus FROM bx LEFT JOIN tp USING (query_id, item_id)),
fz AS (SELECT query_id, item_id, score, fused, dense_rank, wrong_ecosystem, adjective_only, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, fused DESC, bonus DESC, item_id) AS rank FROM fu
  UNION ALL SELECT query_id, item_id, score, NULL, NULL, false, false, rank FROM scr WHERE query_id NOT IN (SELECT query_id FROM nr))"""

QUERIES = {
    "score_full": (score_full, _SETS + " SELECT query_id, item_id, score, raw, array_to_string(all_hits, ' ') AS hits, rank FROM scr WHERE rank <= 20"),
    "fuse_full": (fuse_full, _FUSE + " SELECT * FROM fz WHERE rank <= 60"),
    "card_picks": (card_picks, _FUSE + """, ab AS (SELECT fz.*, kind, kind IN ('skill', 'plugin-skill') AS m FROM fz JOIN items USING (item_id) WHERE score >= 0.28::DOUBLE),
ld AS (SELECT *, first_value(score) OVER (PARTITION BY query_id ORDER BY rank) AS lead FROM ab), pk AS (SELECT *, row_number() OVER (PARTITION BY query_id, m ORDER BY rank) AS pick FROM ld WHERE score >= lead * 0.55::DOUBLE)
SELECT query_id, item_id, kind, score, rank, pick FROM pk WHERE pick <= CASE WHEN m THEN 4 ELSE 3 END"""),
    "counted_picks": (counted_picks, _SETS + r""", ct AS (SELECT query_id, regexp_extract(prompt, '\btop[- ]?(\d{1,3})\b|\b(\d{1,3})\s+(?:top\s+)?(?:skills|tools|mcp|mcps|plugins|agents|commands)', ['a', 'b'], 'i') AS x FROM queries),
cn AS (SELECT query_id, CASE WHEN x.a <> '' OR x.b <> '' THEN greatest(1, least(50, coalesce(TRY_CAST(x.a AS INT), TRY_CAST(x.b AS INT)))) END AS asked FROM ct),
r0 AS (SELECT query_id, item_id, kind, score, rank, coalesce(asked, 10) AS n, asked IS NOT NULL AS topup, score >= 0.28::DOUBLE AS above, kind IN ('skill', 'plugin-skill') AS ismain FROM scr JOIN items USING (item_id) JOIN cn USING (query_id)),
r1 AS (SELECT *, arg_min(score, rank) FILTER (above) OVER (PARTITION BY query_id) AS lead FROM r0),
r2 AS (SELECT *, above AND ismain AND score >= lead * 0.55::DOUBLE AS main, above AND NOT ismain AS other FROM r1),
r3 AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind, other ORDER BY rank) AS k, min(rank) OVER (PARTITION BY query_id, kind, other) AS first, max(coalesce(main, false)::INT) OVER (PARTITION BY query_id) AS has FROM r2),
r4 AS (SELECT *, sum((other AND k <= 2)::INT) OVER (PARTITION BY query_id ORDER BY first, k, rank ROWS UNBOUNDED PRECEDING) AS number FROM r3),
r5 AS (SELECT *, CASE WHEN other AND k <= 2 AND number <= n - has THEN 0 WHEN main THEN 1 WHEN above THEN 2 WHEN topup THEN 3 END AS class FROM r4),
r6 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY class, CASE WHEN class = 0 THEN first END, rank) AS slot FROM r5 WHERE class IS NOT NULL)
SELECT query_id, item_id, kind, score, rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS pick FROM r6 WHERE slot <= n"""),
}
