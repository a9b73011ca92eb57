"""Terms counted where a text is read are those of the column functions, in one row for each text and term."""

from collections import Counter

from pyspark.sql import functions as F

from ferrule.functions import text as X
from ferrule.functions import words
from ferrule.operators import search
from ferrule.operators.store import Catalogue

TEXTS = [
    "", None, "the", "x", "Kiln-fired.clay -glazes- glazes GLAZED", "postgresql psql next.js ci/cd K8s", "a\tb\nCafé-au.lait İstanbul Kelvin", "...--..", "dressers classes reds sing singing",
    "node.js node nodejs 日本 tests-the-of.an", "c++ c# .net _private__ 3.14",
]


def test_terms_equal_those_of_the_column_functions(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").repartition(3)
    want = Counter((r.id, r.term) for r in X.token_rows(rows, F.col("text"), "id").collect())
    found = words.term_counts(rows, F.col("text"), "id").collect()
    assert len(found) == len(want) and {(r.id, r.term): r.n for r in found} == want
    whole = {r.id: r.n for r in words.term_counts(rows, F.col("text"), "id", lengths=True).where("term is null").collect()}
    assert whole == {i: sum(n for (k, _), n in want.items() if k == i) for i in range(len(TEXTS))}


def test_ids_that_come_twice_are_counted_together(spark, tmp_path):
    rows = spark.createDataFrame([(1, "clay", "clay kiln"), (1, None, "kiln"), (2, "kiln", "fir")], "item_id long, name string, text string")
    asked = spark.createDataFrame([("kiln",), ("oak",)], "term string")
    want = {(1, "kiln", 2), (1, None, 3), (2, "kiln", 0), (2, None, 1)} - {(2, "kiln", 0)}
    assert {tuple(r) for r in search.counted(rows, F.col("text"), asked).collect()} == want
    kept = Catalogue(spark, f"file://{tmp_path}/c")
    kept._tokenise(rows, 0)
    got = {tuple(r) for r in spark.read.parquet(f"{kept.folder}/postings/born=0").select("item_id", "term", "tf", "in_name").collect()}
    assert got == {(1, "clay", 2, True), (1, "kiln", 2, False), (2, "kiln", 1, True), (2, "fir", 1, False)}


def test_texts_of_items_that_come_once_are_not_shuffled_by_term(spark):
    rows = spark.createDataFrame([(1, "clay kiln"), (2, "kiln")], "item_id long, text string")
    calls = []
    plain, search.stored = search.stored, lambda df: calls.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df)
    try:
        search.counted(rows, F.col("text"), spark.createDataFrame([("kiln",)], "term string"))
    finally:
        search.stored = plain
    assert "MapInArrow" in calls[-1] and "Generate" not in calls[-1] and "hashpartitioning" not in calls[-1]


def test_postings_of_items_that_come_once_are_not_joined_with_lengths(spark):
    queries = spark.createDataFrame([(1, "clay kiln")], "query_id long, text string")
    rows = [(1, "clay kiln kiln"), (2, "kiln fir oak"), (3, None), (None, "clay")]
    calls, found = [], {}
    plain, search.stored = search.stored, lambda df: calls.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or plain(df)
    try:
        for items in (rows, [*rows, (3, "")]):
            found[len(items)] = search.over_texts(spark.createDataFrame(items, "item_id long, text string"), F.col("text"), queries).posted.collect()
    finally:
        search.stored = plain
    plans = [plan for columns, plan in calls if "part" in columns]
    assert not any(word in plans[0] for word in ("hashpartitioning", "SortMergeJoin", "HashJoin"))
    assert {(r.item_id, r.term) for r in found[4]} == {(r.item_id, r.term) for r in found[5]} == {(1, "clay"), (1, "kiln"), (2, "kiln")}
