"""DuckDB SQL for the text functions, used by the expected results."""

from ferrule.jobs import sqlvalues

ENDINGS = ("ing", "ers", "ed", "es", "s")


def listed(lines: str) -> dict[str, str]:
    return dict(line.split(": ") for line in lines.split("\n") if line)


STOP, GENERIC, MANNER, INTENT_STOP = sqlvalues.STOP.split(), sqlvalues.GENERIC.split(), sqlvalues.MANNER.split(), sqlvalues.INTENT_STOP.split()
VARIANTS, ECOSYSTEMS, CONCEPTS = listed(sqlvalues.VARIANTS), listed(sqlvalues.ECOSYSTEMS), listed(sqlvalues.CONCEPTS)


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def stem(w: str) -> str:
    cases = " ".join(f"WHEN length({w}) > 4 AND ends_with({w}, '{e}') THEN left({w}, length({w}) - {len(e)})" for e in ENDINGS)
    return f"CASE {cases} ELSE {w} END"


def norm(w: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in VARIANTS.items())
    return f"CASE {w} {cases} ELSE {stem(w)} END"


def tokens(source: str, key: str, text: str) -> str:
    """SELECT of (key, term), one row for each token."""
    return f"""
SELECT {key}, {norm('w')} AS term FROM (
  SELECT {key}, w FROM raw_{source} UNION ALL
  SELECT {key}, p AS w FROM (SELECT {key}, unnest(regexp_split_to_array(w, '[-.]')) AS p FROM raw_{source} WHERE regexp_matches(w, '[-.]'))
  WHERE length(p) > 2 AND p NOT IN ({quoted(STOP)}))"""


def raw(source: str, key: str, text: str) -> str:
    return f"""raw_{source} AS (SELECT {key}, w FROM (
  SELECT {key}, trim(unnest(regexp_split_to_array(lower(coalesce({text}, '')), '[^a-z0-9+#._-]+')), '._-') AS w FROM {source})
  WHERE length(w) >= 2 AND w NOT IN ({quoted(STOP)}))"""


def bm25() -> str:
    """CTEs up to bm(query_id, item_id, score): benchmark items against documents."""
    damp = ", ".join(f"'{w}'" for w in GENERIC)
    return f"""
WITH {raw('documents', 'doc_id', 'text')}, {raw('benchmark', 'item_id', 'text')},
t AS ({tokens('documents', 'doc_id', 'text')}),
q AS (SELECT DISTINCT item_id AS query_id, term FROM ({tokens('benchmark', 'item_id', 'text')})),
g AS (SELECT DISTINCT {norm('w')} AS term FROM (SELECT unnest([{damp}]) AS w)),
len AS (SELECT doc_id, count(*) AS length FROM t GROUP BY doc_id),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
c AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(length) FROM len) / (SELECT count(*) FROM documents) AS avg_length),
i AS (SELECT query_id, q.term, df, ln(1 + (n - coalesce(df, 0) + 0.5::DOUBLE) / (coalesce(df, 0) + 0.5::DOUBLE))
  * CASE WHEN q.term IN (SELECT term FROM g) THEN 0.4::DOUBLE ELSE 1 END AS idf, avg_length FROM q LEFT JOIN df USING (term), c),
s AS (SELECT query_id, sum(idf) AS q_idf FROM i GROUP BY query_id),
bm AS (SELECT query_id, doc_id AS item_id, round(sum(idf * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.4::DOUBLE + 0.6::DOUBLE * length / avg_length))) / greatest(any_value(q_idf), 1e-6), 4) AS score
  FROM i JOIN p USING (term) JOIN len USING (doc_id) JOIN s USING (query_id) GROUP BY ALL),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM bm)"""


#: CTEs up to kept(query_id, item_id, rank, ...): greedy by rank, a row goes if its tokens overlap by 0.85 with those of a kept one; two stay.
DIVERSE = """
dv AS (SELECT query_id, list(struct_pack(rank := rank, item_id := item_id, tokens := tokens) ORDER BY rank) AS l FROM (@ROWS@) GROUP BY query_id),
dk AS (SELECT query_id, l, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda y: len(list_intersect(y.tokens, x[1].tokens)) > 0
  AND len(list_intersect(y.tokens, x[1].tokens)) >= 0.85::DOUBLE * len(list_distinct(list_concat(y.tokens, x[1].tokens))))) > 0 THEN a ELSE list_concat(a, x) END) AS k FROM dv),
kept AS (SELECT query_id, unnest(CASE WHEN len(l) <= 2 THEN l WHEN len(k) < 2 THEN l[1:2] ELSE k END, recursive := true) FROM dk)"""
