import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.functions import sql
from ferrule.operators import knn, retrieve, search
from ferrule.operators.store import Catalogue


def corpus_of(seed, n=300):
    rnd = random.Random(seed)
    words = [f"term{k}" for k in range(60)] + ["testing", "tests", "postgres", "pg", "setup"]
    weights = [1 / (1 + k) for k in range(len(words))]
    items = [(i, " ".join(rnd.choices(words, weights, k=rnd.choice([0, 3, 10, 80])))) for i in range(n)]
    items += [(n + i, items[5][1]) for i in range(40)]  # copies: ties
    queries = [(q, " ".join(rnd.choices(words, k=rnd.choice([1, 4, 12])))) for q in range(25)]
    return items, queries


def by_pair(df):
    return {(r.query_id, r.item_id): (r.score, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_search_equals_the_whole_ranking(spark, seed):
    items, queries = corpus_of(seed)
    rows, asked = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    posted = retrieve.postings(rows, F.col("text"))
    every = retrieve.ranked(retrieve.bm25(posted, asked, rows.agg(F.count(F.lit(1)).alias("n"))))
    whole = by_pair(every)
    corpus = search.over_texts(rows, F.col("text"), asked)
    for k in (1, 10):
        assert by_pair(search.top(corpus, k)) == {p: v for p, v in whole.items() if v[1] <= k}
    rnd = random.Random(seed)
    gold = rnd.sample(sorted(whole), 40) + [(0, 10**9)]
    got = {r.query_id: r["rank"] for r in search.first_ranks(corpus, spark.createDataFrame(gold, "query_id long, item_id long")).collect()}
    want = {}
    for q, i in gold[:-1]:
        want[q] = min(want.get(q, 10**9), whole[q, i][1])
    assert got == want


def test_search_scores_a_part_of_the_pairs(spark):
    rnd = random.Random(4)
    common, rare = [f"c{k}" for k in range(15)], [f"r{k}" for k in range(3000)]
    items = [(i, " ".join(rnd.choices(common, k=20) + rnd.choices(rare, k=8))) for i in range(1500)]
    queries = [(q, " ".join(items[q * 7][1].split()[-8:] + rnd.choices(common, k=6))) for q in range(20)]
    corpus = search.over_texts(spark.createDataFrame(items, "item_id long, text string"), F.col("text"), spark.createDataFrame(queries, "query_id long, text string"))
    pairs = corpus.terms.join(corpus.posted, "term").select("query_id", "item_id").distinct().count()
    parts = search.opened(corpus, search.bounds(corpus), search.seeds(corpus, 5))
    opened, every = (rows.agg(F.sum("n")).first()[0] for rows in (parts.where("open"), parts))
    assert search.at_least(corpus, search.seeds(corpus, 5), 5).count() < 0.2 * pairs and opened < 0.8 * every


@pytest.mark.parametrize("size", [1024, 16])
def test_nearest_equals_a_scan_and_leaves_cells_out(spark, size):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 12))
    m = np.concatenate([c + 0.05 * rng.normal(size=(40, 12)) for c in centres] + [np.repeat(centres[:1], 100, axis=0), np.zeros((3, 12))])
    q = np.concatenate([centres[:8] + 0.02, np.zeros((1, 12)), -centres[:1]])
    frame = lambda x, key: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{key} long, vector array<double>")
    found, visits = knn.nearest(frame(m, "item_id"), frame(q, "query_id"), 7, size=size)
    unit = lambda x: x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1)
    cosine = np.round(unit(q) @ unit(m).T, 4) + 0.0
    want = {}
    for k, row in enumerate(cosine):
        for place, i in enumerate(sorted(range(len(m)), key=lambda i: (-row[i], i))[:7]):
            want[k, place + 1] = (i, round(float(row[i]), 4))
    assert {(r.query_id, r["rank"]): (r.item_id, round(r.cosine, 4)) for r in found.collect()} == want
    share = {r.query_id: r.visited / r.cells for r in visits.collect()}
    assert max(share[k] for k in range(8)) < 0.5
    assert knn.nearest(frame(m, "item_id").where("false"), frame(q, "query_id"), 7)[0].collect() == []


def live(catalogue, version):
    return (
        sorted(tuple(r) for r in catalogue.terms(version).collect()),
        sorted(tuple(r) for r in catalogue.postings(version).select("item_id", "term", "tf", "in_name").collect()),
        sorted((r.item_id, r.length) for r in catalogue.manifest(version).collect()),
    )


def test_updates_equal_a_rebuild(spark, tmp_path):
    items, queries = corpus_of(9, 60)
    versions = [{i: (f"name{i % 4}", t) for i, t in items}]
    for step in range(3):
        now = dict(versions[-1])
        for i in list(now)[step::9]:
            now[i] = (now[i][0], now[i][1] + f" changed{step}")
        for i in list(now)[step::13]:
            del now[i]
        now |= {1000 + 10 * step + k: (None, f"added term{k} text") for k in range(5)}
        versions.append(now)
    frame = lambda v: spark.createDataFrame([(i, *x) for i, x in v.items()], "item_id long, name string, text string")
    kept = Catalogue(spark, f"file://{tmp_path}/kept")
    assert kept.latest() == -1
    for n, v in enumerate(versions):
        assert kept.update(frame(v)) == n
        whole = Catalogue(spark, f"file://{tmp_path}/whole{n}")
        whole.update(frame(v))
        assert live(kept, n) == live(whole, 0)
        counts = kept.counts(n).first()
        before = versions[n - 1] if n else {}
        changed = {i for i in v if v[i] != before.get(i)}
        assert counts.items == len(v) and counts.tokenised == len({i for i in changed if any(x for x in v[i])}) and counts.lost == len(set(before) - set(v))
    kept.update(frame(versions[-1]), 3)  # run again
    assert kept.latest() == 3 and live(kept, 3) == live(whole, 0)
    asked = spark.createDataFrame(queries, "query_id long, text string")
    best = by_pair(search.top(kept.corpus(asked), 5))
    assert kept.compact() == 4 and live(kept, 4) == live(whole, 0)
    assert best and best == by_pair(search.top(whole.corpus(asked), 5)) == by_pair(search.top(kept.corpus(asked), 5))


def test_vectors_are_kept_by_content(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "item_id long, name string, text string")
    kept = Catalogue(spark, f"file://{tmp_path}/kept")
    kept.update(frame([(1, "a", "x"), (2, "b", "y"), (3, "a", "x")]))
    missing = kept.without_vector(0)
    assert missing.count() == 3
    kept.put_vectors(missing.select("hash").distinct().withColumn("vector", F.array(F.lit(1.0))), 0)
    kept.update(frame([(1, "a", "x"), (2, "b", "other"), (4, "b", "y")]))
    assert [r.item_id for r in kept.without_vector(1).collect()] == [2]
    assert sorted(r.item_id for r in kept.vectors(1).collect()) == [1, 4]


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT tokenize('Fix the FAILING Docker-compose tests') AS t, normalize('psql') AS n, overlap(array('a', 'b'), array('b')) AS o, tokenize(NULL) AS z").first()
    assert (sorted(row.t), row.n, row.o, row.z) == (["compose", "docker", "docker-compose", "fail", "fix", "test"], "postgres", 0.5, [])
    rows = spark.createDataFrame([(1, k, s, "x") for k, s in enumerate([9.0, 8.5, 2.0, 1.9])] + [(2, k, 1.0, "y") for k in range(20)] + [(3, 0, 5.0, "z"), (3, 1, 0.1, "z")], "query_id int, rank int, score double, more string")
    got = spark.sql("SELECT * FROM score_cliff(TABLE(SELECT * FROM {r}) PARTITION BY query_id ORDER BY rank)", r=rows).collect()
    assert sorted((r.query_id, r["rank"]) for r in got) == [(1, 0), (1, 1), (1, 2), *((2, k) for k in range(20)), (3, 0), (3, 1)] and got[0].asDict().keys() == {"query_id", "rank", "score", "more"}
