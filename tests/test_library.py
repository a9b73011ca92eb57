from collections import Counter
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.functions import text as X
from ferrule.functions import vocab as V
from ferrule.jobs import ranking, registry
from ferrule.jobs.prompts import skip_reason
from ferrule.jobs.signals import guarded
from ferrule.operators import choose, evaluate, knn, retrieve, search
from ferrule.operators.catalogue import combined, mentioned
from ferrule.sources import tables

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    found = duck.sql(SQL[name])
    columns = sorted(found.columns)
    assert sorted(df.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert Counter(tuple(str(r[c]) for c in columns) for r in df.collect()) == Counter(tuple(str(r[i]) for i in at) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_tokens_variants_compounds_and_stop_words(spark):
    rows = spark.createDataFrame([(1, "Use PostgreSQL, kiln-fired.clay and glazing"), (2, None), (3, "")], "id int, text string")
    assert sorted(r.term for r in X.token_rows(rows, F.col("text"), "id").collect()) == ["clay", "fir", "glaz", "kiln", "kiln-fired.clay", "postgres"]
    assert {r.term: r.n for r in X.term_counts(rows, F.col("text")).collect()} == {t: 1 for t in ("clay", "fir", "glaz", "kiln", "kiln-fired.clay", "postgres")}


def _rank(spark, items, query):
    rows = spark.createDataFrame([(k, n, t) for k, (n, t) in enumerate(items)], "item_id long, name string, text string")
    posted = retrieve.postings(rows, F.concat_ws(" ", "name", "text"), F.col("name"))
    q = spark.createDataFrame([(0, query)], "query_id long, text string")
    found = retrieve.ranked(retrieve.bm25(posted, q, rows.agg(F.count(F.lit(1)).alias("n")))).orderBy("rank").collect()
    return [items[r.item_id][0] for r in found]


def test_name_and_content_decide_the_top(spark):
    items = [("kiln-firing", "ovens"), ("glaze-recipes", "ash and cobalt colours"), ("wheel-throwing", "bowls and vases"), ("clay-sourcing", "quarries")]
    assert _rank(spark, items, "which cobalt colours suit ash, and how")[0] == "glaze-recipes"
    assert _rank(spark, items, "my kiln cracks vases")[0] == "kiln-firing"
    assert _rank(spark, items, "good evening") == []


def test_bm25_over_texts_equals_bm25_over_postings(spark):
    rows = spark.createDataFrame([(1, "red clay red"), (2, "Clays and firing"), (3, None), (4, "nothing here")], "item_id long, text string")
    q = spark.createDataFrame([(0, "clay fired unknown"), (1, None), (2, "red")], "query_id long, text string")
    a = retrieve.bm25(retrieve.postings(rows, F.col("text")), q, rows.agg(F.count(F.lit(1)).alias("n"))).collect()
    found = search.top(search.over_texts(rows, F.col("text"), q), 9).drop("rank").collect()
    assert a and sorted(a) == sorted(found)


@pytest.mark.parametrize("size", [3, 1000])
def test_cosine_in_blocks_equals_all_pairs(spark, size):
    rnd = np.random.default_rng(1)
    v, q = rnd.integers(-2, 3, (40, 4)).astype(float), rnd.integers(-2, 3, (7, 4)).astype(float)
    frame = lambda m, key: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], f"{key} long, vector array<double>")
    got = {(r.query_id, r["rank"]): (r.item_id, r.cosine) for r in knn.nearest(frame(v, "item_id"), frame(q, "query_id"), 5, size=size)[0].collect()}
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1)
    cos = np.round(unit(q) @ unit(v).T, 4)
    for i in range(7):
        best = sorted(range(40), key=lambda j: (-cos[i, j], j))[:5]
        assert [got[i, k + 1][0] for k in range(5)] == best


def test_admission(spark):
    rows = [("", None), ("x", "loop_wakeup"), ("* no", None), ("#no", None), ("/name", None), ("a <system-reminder> b", None), ("fix the bug", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, s string").select(skip_reason(F.col("t"), F.col("s"))).collect()]
    assert got == ["empty", "source=loop_wakeup", "bypass prefix", "bypass prefix", "slash command", "machine-generated content", None]


def test_quota_keeps_few_of_each_kind(spark):
    rows = [(1, k + 1, "main", 2.0 - 0.05 * k) for k in range(12)]
    rows += [(1, 13, "book", 0.9), (1, 14, "film", 0.8), (1, 15, "book", 0.7), (1, 16, "book", 0.6), (1, 17, "song", 0.5)]
    got = choose.quota(spark.createDataFrame(rows, "query_id int, rank int, kind string, score double")).collect()
    assert Counter(r.kind for r in got) == {"main": 6, "book": 2, "film": 1, "song": 1}
    assert [r.score for r in sorted(got, key=lambda r: r.pick)] == sorted((r.score for r in got), reverse=True)


def test_cliff_keeps_the_row_after_the_drop(spark):
    rows = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.9), (1, 3, 0.3), (1, 4, 0.29)], "query_id int, rank int, score double")
    assert sorted(r["rank"] for r in choose.cliff(rows).collect()) == [1, 2, 3]


def test_diversity_drops_repeats_but_keeps_two(spark):
    rows = spark.createDataFrame([(1, 1, 1, ["a", "b"]), (1, 2, 2, ["a", "b"]), (1, 3, 3, ["c"])], "query_id int, item_id int, rank int, tokens array<string>")
    assert sorted(r.item_id for r in choose.diversify(rows).collect()) == [1, 3]
    assert choose.diversify(rows.where("rank < 3")).count() == 2  # of two rows both stay


def test_metrics(spark):
    rows = [(1, 1, [3], False), (2, 1, [], False), (3, 0, [], True)]
    got = evaluate.scores(spark.createDataFrame(rows, "query_id int, n_labels int, ranks array<int>, abstained boolean")).collect()[0]
    assert (got.recall_1, got.recall_3, got.mrr, got.ndcg_10, got.abstain_precision) == (0.0, 0.5, 0.1667, 0.25, 1.0)


def test_front_matter_and_toml(spark):
    rows = spark.createDataFrame([("---\nname: 'a b'\nDesc: x\nname: c\n---\nbody",), ("no",), ("---\nopen: 1",)], "t string")
    assert [r[0] for r in rows.select(tables.front_matter(F.col("t"))).collect()] == [{"name": "c", "desc": "x"}, {}, {}]
    folded = [("---\nabout: >-\n  one\n\n  two\nb: |\n x\n  # y\n skipped\nc: \"q\"\n---\n",), ("---\n a: 1\n# b: 2\nnocolon\nd:\n---",)]
    got = [r[0] for r in spark.createDataFrame(folded, "t string").select(tables.front_matter(F.col("t"))).collect()]
    assert got == [{"about": "one two", "b": "x skipped", "c": "q"}, {"d": ""}]
    t = spark.createDataFrame([("[mcp.one]\na=1\n [[mcp.two]]\n[other.x]",)], "t string")
    assert t.select(tables.toml_tables(F.col("t"), "mcp")).collect()[0][0] == ["one", "two"]


def test_rerank_gate(spark):
    rows = [(q, i, s, i) for q, scores in ((1, (1.0, 0.9, 0.8)), (2, (2.0, 1.0)), (3, (1.0, 0.9)), (4, (1.0, 0.9, 0.1)), (5, (1.0,))) for i, s in enumerate(scores, 1)]
    odds = [(1, 3, 0.8), (1, 1, 0.2), (2, 2, 0.9), (3, 1, 0.5), (3, 2, 0.5), (4, 3, 0.9)]
    ranking = spark.createDataFrame(rows, "query_id int, item_id int, score double, rank int")
    got = choose.rerank(ranking, spark.createDataFrame(odds, "query_id int, item_id int, p double")).collect()
    assert {r.query_id: r.gate for r in got} == {1: "moved", 2: "clear", 3: "unsure", 4: "weak", 5: "clear"}
    assert {r.item_id: r.place for r in got if r.query_id == 1} == {3: 1, 1: 2, 2: 3}
    assert all(r.place == r["rank"] for r in got if r.query_id != 1)


def test_gold_is_every_document_that_contains_a_passage(spark, tmp_path):
    passage = "one two three four five six"
    texts = [f"{passage} {k}" for k in range(250)] + ["filler words " * 3000 + passage, "bone two three four five sixes", "one two three four five seven six", "xtiny y", "a few words", None]
    items = [passage, "one two three", "tiny", "ny", "no such words in here", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for d, glob in ((str(tmp_path), "/*.parquet"), ("/root/testdata/sf0.001", "")):
        sql = f"SELECT b.item_id, t.doc_id FROM '{d}/benchmark.parquet{glob}' b, '{d}/documents.parquet{glob}' t WHERE contains(t.text, b.text)"
        assert {tuple(r) for r in ranking._gold(spark, d).select("query_id", "item_id").collect()} == set(duckdb.sql(sql).fetchall())
    got = ranking.metrics(spark, str(tmp_path)).collect()[0]
    assert (got.n_positive, got.n_negative) == (4, 2)


def test_boundaries_and_whole_vocabularies(spark):
    texts = ["unpaid work", "a paid tool", "10/mo", "no bugs", "debugger", "naïve ci", "cié", "rm -rf / now", "base64 -D x", "chmod 4755 /usr/bin/a", "evaluate(x)", "prune the tree", "dd if=/dev/zero"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select(
        "k", F.col("t").rlike(f"(?U){V.PAID}").alias("paid"), X.flags(F.col("t"), V.INTENTS).alias("i"), X.flags(F.col("t"), V.RISKS).alias("r"), guarded(F.col("t")).alias("s"))
    got = {r.k: r for r in rows.collect()}
    assert [k for k in got if got[k].paid] == [1, 2]
    assert got[3].i == ["debug"] and got[4].i == [] and got[5].i == ["deploy"] and got[6].i == []
    assert got[7].s == ["rm -rf /"] and got[8].s == ["base64 decode"] and got[9].s == ["privilege edit"] and got[10].s == []
    assert [got[k].r for k in (7, 11, 12)] == [["destructive"]] * 3


def test_mentions_of_generic_names_must_be_explicit(spark):
    rows = [("review this", "review", True), ("use the review", "review", True), ("/review", "review", True), ("please kiln-firing", "kiln-firing", False), ("abc", "abc", False)]
    got = spark.createDataFrame(rows, "p string, n string, g boolean").select(mentioned(F.col("p"), F.col("n"), F.col("g"))).collect()
    assert [r[0] for r in got] == [False, True, True, True, False]


def test_top_up_fills_a_requested_number(spark):
    rows = spark.createDataFrame([(q, k, "skill" if k % 2 else "mcp", 1.0 - 0.2 * k, k + 1) for q in (1, 2) for k in range(6)], "query_id int, item_id int, kind string, score double, rank int")
    got = combined(rows, spark.createDataFrame([(1, 6, True), (2, 6, False)], "query_id int, n int, topup boolean")).collect()
    assert [r.item_id for r in sorted((r for r in got if r.query_id == 1), key=lambda r: r.pick)] == [0, 1, 2, 3, 4, 5]
    assert {r.item_id for r in got if r.query_id == 2} == {0, 1, 2, 3}
