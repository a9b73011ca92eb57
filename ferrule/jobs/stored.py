"""Jobs on the stored catalogue: an update in place of a rebuild, what it read, and a ranking from what is stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.jobs import derived, sqltext
from ferrule.operators import search
from ferrule.operators.store import Catalogue, named
from ferrule.sources.tables import table

#: (item_id, text): the documents as they stood before: one language was not there yet, another was in draft, and pages stood among them.
BEFORE = """
SELECT doc_id AS item_id, CASE WHEN lang = 'de' THEN concat('draft notes: ', text) ELSE text END AS text FROM documents WHERE lang IS NULL OR lang <> 'fr'
UNION ALL SELECT -1 - page_id AS item_id, html AS text FROM pages"""
NOW = "SELECT doc_id AS item_id, text FROM documents"


def _updated(spark, d) -> Catalogue:
    """The catalogue after two versions; vectors are made (here: taken from the hash) for the first only."""
    kept = Catalogue(spark)
    first = kept.update(named(derived.rows(spark, d, BEFORE)))
    made = kept.without_vector(first).select("hash").distinct()
    kept.put_vectors(made.select("hash", F.array(F.conv(F.substring("hash", 1, 4), 16, 10).cast("double")).alias("vector")), first)
    kept.update(named(derived.rows(spark, d, NOW)))
    return kept


def update(spark, d):
    """Document frequencies of all terms after the update."""
    kept = _updated(spark, d)
    return kept.terms(kept.latest())


def changes(spark, d):
    """What the update found, and how many items it tokenised; items whose content has a vector keep it."""
    kept = _updated(spark, d)
    return kept.counts(kept.latest())


def topk(spark, d, k=10):
    """The ranking of ``bm25_topk``, from the stored postings after the update."""
    kept = _updated(spark, d)
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.top(kept.corpus(queries), k)


def live_vectors(spark, d):
    """Items of the last version that have a vector, all from the first."""
    kept = _updated(spark, d)
    return kept.vectors(kept.latest()).select("item_id", F.element_at("vector", 1).cast("long").alias("value"))


_HASH = "left(sha1('' || '|' || coalesce(text, '')), 16)"
_V = f"WITH o AS (SELECT *, {_HASH} AS h FROM ({BEFORE})), n AS (SELECT *, {_HASH} AS h FROM ({NOW}))"

QUERIES = {
    "catalogue_update": (update, sqltext.bm25() + " SELECT term, df FROM df"),
    "catalogue_changes": (changes, _V + f""", {sqltext.raw('n', 'item_id', 'text')}, tk AS (SELECT DISTINCT item_id FROM raw_n),
s AS (SELECT n.item_id AS i, o.item_id AS j, n.h, o.h AS had FROM n FULL JOIN o ON n.item_id = o.item_id)
SELECT count(i) AS items, count(*) FILTER (h = had) AS same, count(*) FILTER (h <> had) AS changed, count(*) FILTER (j IS NULL) AS new, count(*) FILTER (i IS NULL) AS lost,
  count(*) FILTER (i IN (SELECT item_id FROM tk) AND (j IS NULL OR h <> had)) AS tokenised, count(DISTINCT h) FILTER (i IS NOT NULL AND h NOT IN (SELECT h FROM o)) AS vectors_missing FROM s"""),
    "catalogue_topk": (topk, sqltext.bm25() + " SELECT query_id, item_id, score, rank FROM bmr WHERE rank <= 10"),
    "catalogue_vectors": (live_vectors, _V + " SELECT item_id, ('0x' || left(h, 4))::BIGINT AS value FROM n WHERE h IN (SELECT h FROM o)"),
}
