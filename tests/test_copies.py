"""Parts of one name and type are ranked as one, and the ranking is still that of every part."""

from collections import Counter

import duckdb
from pyspark.sql import functions as F
import pytest

from ferrule.jobs import insql, ranking
from ferrule.operators import retrieve

PARTS = [(100 - 7 * k, f"{a} {b}" if k % 11 else None, t) for k, (a, b, t) in enumerate([(a, b, t) for a in ("red", "blue") for b in ("ring", "bolts") for t in ("SMALL", "LARGE", None)] * 7)]


@pytest.mark.parametrize("name,query", [("bm25_name_boost", ranking.name_boost), ("sql_ranking", insql.ranked)])
def test_ranking_of_copies_equals_the_sql(spark, tmp_path, name, query):
    spark.createDataFrame(PARTS, "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"create view part as select * from read_parquet('{tmp_path}/part.parquet/*.parquet')")
    want = con.sql(ranking.QUERIES["bm25_name_boost"][1])
    at = [want.columns.index(c) for c in ("query_id", "item_id", "score", "rank")]
    got = Counter(tuple(str(r[c]) for c in ("query_id", "item_id", "score", "rank")) for r in query(spark, str(tmp_path)).collect())
    assert got == Counter(tuple(str(r[k]) for k in at) for r in want.fetchall())


def test_an_item_that_stands_for_several_counts_as_often(spark):
    rows = spark.createDataFrame([(1, "red ring"), (2, "red ring"), (3, "red ring"), (4, "blue bolt ring")], "item_id long, text string")
    q = spark.createDataFrame([(0, "red bolt")], "query_id long, text string")
    every = retrieve.bm25(retrieve.postings(rows, F.col("text")), q, rows.agg(F.count(F.lit(1)).alias("n"))).where("item_id in (1, 4)").collect()
    sets = rows.groupBy("text").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("copies"))
    own = retrieve.bm25(retrieve.postings(sets, F.col("text")), q, sets.agg(F.sum("copies").alias("n")), sets.select("item_id", "copies")).collect()
    assert sorted(every) == sorted(own) and len(own) == 2
