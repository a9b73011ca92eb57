"""Mixing sources to target weights by systematic sampling.

Sources in code point order, the null source last, weigh 1, 2, 3, 1, 2, 3 and
so on and share the words of all documents in proportion. A source takes at
most ``MOST`` times its own words; what is over is shared out anew by weight
among the others, until no source is above its limit. Each round of this is one
aggregate over the table of sources, of which the driver sees two numbers.

A document of a source with target t and s words is expected t / s times. In
each source these expected copies are summed up document by document, one
random offset is added, and a document is emitted once for each integer that
its stretch of the sum crosses: the whole part of t / s, or one more. The
documents stand in order of their size, the largest first, so that what one of
them has too much the next ones, of like size, have too little. Those with more
than ``LARGE`` of the target come before all others; what they took too much or
too little is taken from, or given to, the expected copies of the rest, which
end within about one of their own documents of the target.

Numbering is a range-partitioned sort, whose rows get their place in the
partition; the sizes of all partitions then give each its start. No source and
no size is gathered in one task, however many rows it holds.

Edge cases: null text has no words; the null source is a source, the last one;
documents without words are taken zero words of; a row without a doc_id comes
first among its size; repeated rows count each; a source without words has the
target 0, and without any words nothing is taken; an empty table gives no rows;
other columns are ignored by the query and kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import stored

WEIGHTS = (1, 2, 3)
#: No document is taken more often than this.
MOST = 3
#: Share of a target above which a document is large.
LARGE = 0.01
SEED = "mix"
#: Bits of ``monotonically_increasing_id`` below the number of the partition (fixed value).
_PLACE_BITS = 33


def size(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows``, stored, with ``at``: 0, 1, 2, ... in the given order over all rows."""
    place = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", place)
    dealt = stored(dealt)
    part, at = F.shiftright("_id", _PLACE_BITS), F.col("_id").bitwiseAND((1 << _PLACE_BITS) - 1)
    parts = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    # as many rows as the sort had partitions
    starts = [(r["_part"], r["n"]) for r in parts.orderBy("_part").collect()]
    upto, begin = 0, []
    for number, n in starts:
        begin.append((number, upto))
        upto += n
    begins = rows.sparkSession.createDataFrame(begin, "_part long, _start long")
    return dealt.withColumn("_part", part).join(F.broadcast(begins), "_part").withColumn("at", F.col("_start") + at).drop("_id", "_part", "_start")


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source, of any number of sources."""
    ordered = numbered(sources, F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("at") % len(WEIGHTS) + 1).cast("int")).cast("long")
    weighed = stored(ordered.withColumn("weight", weight).drop("at"))
    cap = MOST * F.col("source_size")
    level, stopped = 0.0, -1
    while True:
        full = cap <= level * F.col("weight")
        found = weighed.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum(F.when(full, cap)), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weight"), F.count(F.when(full, 1)).alias("n"),
        ).first()
        if found["n"] == stopped or not found["weight"] or not found["words"]:
            break
        level, stopped = (found["words"] - found["capped"]) / found["weight"], found["n"]
    return weighed.select("source", "source_size", F.least(cap.cast("double"), level * F.col("weight")).alias("target"))


def sampled(docs: DataFrame, *kept: str) -> DataFrame:
    """The columns ``kept`` of every row with size, source_size, target and copies: how often the mix emits the row."""
    # equal rows may stand in any order: each gets copies of one and the same row
    row = F.struct(*(F.col(c) for c in kept)).alias("row")
    rows = stored(docs.select(row, "source", "doc_id", size(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")))
    every = numbered(rows, F.asc_nulls_last("source"), F.desc("size"), F.asc_nulls_first("doc_id"), "tie").drop("tie", "doc_id")
    by_source = stored(every.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("at").alias("first")))
    aimed = targets(by_source.select("source", "source_size")).select(F.col("source").alias("_s"), "source_size", "target")
    aimed = aimed.join(by_source.select("source", "first"), F.col("_s").eqNullSafe(F.col("source"))).drop("source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aimed = stored(aimed.withColumn("rate", rate).withColumn("offset", offset(F.col("_s"))))
    # Spark broadcasts the stored sources while they are small, else it joins by hash and splits hot ones
    same = F.col("source").eqNullSafe(F.col("_s"))
    k, is_large = F.col("at") - F.col("first"), F.col("size") > LARGE * F.col("target")
    upto = lambda n: F.floor(n * F.col("rate") + F.col("offset"))
    copies = F.least(upto(k + 1) - upto(k), F.lit(MOST))
    large = every.join(aimed, same).where(is_large).groupBy("_s").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("in_large"), F.sum(copies * F.col("size")).alias("taken"))
    both = aimed.join(large.withColumnRenamed("_s", "_l"), F.col("_s").eqNullSafe(F.col("_l")), "left").drop("_l").na.fill(0, ["n", "in_large", "taken"])
    left = F.col("source_size") - F.col("in_large")
    rest = F.when(left > 0, F.least(F.lit(float(MOST)), F.greatest(F.lit(0.0), (F.col("target") - F.col("taken")) / left))).otherwise(0.0)
    aimed = stored(both.withColumn("rest", rest))
    then = lambda n: F.floor(F.col("n") * F.col("rate") + (n - F.col("n")) * F.col("rest") + F.col("offset"))
    copies = F.when(is_large, copies).otherwise(F.least(then(k + 1) - then(k), F.lit(MOST)))
    return every.join(aimed, same).select("row", "size", "source_size", "target", copies.alias("copies"))


def offset(source: Column) -> Column:
    """In [0, 1): fixed for a source."""
    digest = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(source, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    taken = sampled(docs, *docs.columns).where("copies > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


def query(docs: DataFrame) -> DataFrame:
    found = sampled(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
    return found.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
-- with the sources of least limit by weight stopped, the others share what is left; the greatest of these shares is the one that holds
o AS (SELECT *, sum(cap) OVER before AS capped, sum(weight) OVER before AS gone FROM w
  WINDOW before AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max(((SELECT sum(source_size) FROM s) - coalesce(capped, 0))::DOUBLE / ((SELECT sum(weight) FROM w) - coalesce(gone, 0))::DOUBLE) AS level FROM o),
t AS (SELECT source, source_size, least(cap::DOUBLE, level * weight::DOUBLE) AS target FROM w, l),
r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate, size > 0.01::DOUBLE * target AS large,
  ('0x' || left(md5('mix:' || coalesce(d.source, '')), 8))::UBIGINT::DOUBLE / 4294967296::DOUBLE AS u,
  row_number() OVER (PARTITION BY d.source ORDER BY size DESC, doc_id NULLS FIRST) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(least(floor(k * rate + u) - floor((k - 1) * rate + u), 3) AS BIGINT) AS copies FROM r),
b AS (SELECT source AS s, count(*) FILTER (large) AS n, coalesce(sum(size) FILTER (large), 0)::DOUBLE AS in_large, coalesce(sum(copies * size) FILTER (large), 0)::DOUBLE AS taken FROM c GROUP BY source),
e AS (SELECT c.*, n, CASE WHEN source_size - in_large > 0 THEN least(3::DOUBLE, greatest(0::DOUBLE, (target - taken) / (source_size - in_large))) ELSE 0 END AS rest
  FROM c JOIN b ON source IS NOT DISTINCT FROM s)
SELECT doc_id, size, source_size, target, CASE WHEN large THEN copies
  ELSE CAST(least(floor(n * rate + (k - n) * rest + u) - floor(n * rate + (k - 1 - n) * rest + u), 3) AS BIGINT) END * size AS taken FROM e
"""
