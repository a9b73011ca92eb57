from collections import Counter

import pytest
from pyspark.sql import functions as F

from ferrule.jobs import signals
from ferrule.jobs import streams
from ferrule.streaming import events as S

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The events in order of time, in four files."""
    path = str(tmp_path_factory.mktemp("events") / "events.parquet")
    spark.read.parquet(f"{SF}/events.parquet").repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    return path


def _rows(df):
    columns = sorted(df.columns)
    return Counter(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def test_stream_pairs_equal_the_batch_query(spark):
    assert _rows(streams.interval_pairs(spark, SF)) == _rows(signals.interval_pairs(spark, SF))


def test_stateful_pairing_equals_the_fold(spark):
    found = _rows(streams.one_to_one(spark, SF))
    assert found and found == _rows(signals.one_to_one(spark, SF))


@pytest.mark.parametrize("held", [S.HELD, 50])
def test_pairing_of_a_hot_user_equals_the_fold_over_batches(spark, tmp_path, held):
    """One user has most events; what a task should not hold goes through the state, slot by slot."""
    rows = spark.range(600).selectExpr(
        "id AS event_id", "timestamp_seconds(1700000000 + id * 97 + id % 5) AS ts", "IF(id % 6 = 5, id % 4, 99) AS user_id",
        "CASE WHEN id % 3 = 0 THEN 'view' WHEN id % 3 = 1 THEN IF(id % 2 = 0, 'view', 'purchase') ELSE 'purchase' END AS event_type", "1.0D AS value", "'' AS props")
    (tmp_path / "d").mkdir()
    rows.coalesce(1).write.parquet(str(tmp_path / "d/events.parquet"))
    want = _rows(signals.one_to_one(spark, str(tmp_path / "d")))
    path = str(tmp_path / "parts")
    for k in range(3):  # one file after the other, since batches are taken by the files' times
        rows.where(f"event_id div 200 = {k}").coalesce(1).write.mode("append").parquet(path)
    with S.state_on_disk(spark):
        found = _rows(S.drain(S.one_to_one(S.event_stream(spark, path, 1), held=held), "hot"))
    assert len(want) > 100 and found == want


def test_totals_are_the_same_over_several_batches(spark, parts):
    found = S.user_totals(S.event_stream(spark, parts, 1))
    whole = spark.read.parquet(parts).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("latest"))
    assert _rows(found) == _rows(whole)


def test_a_batch_run_twice_changes_nothing(spark, tmp_path):
    sink = S.Upsert(str(tmp_path), lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n")))
    for batch, rows in [(0, [(1, 1), (2, 1)]), (1, [(1, 1)]), (1, [(1, 1)])]:
        sink(spark.createDataFrame(rows, "k int, n long"), batch)
    assert _rows(spark.read.parquet(sink.path(1))) == Counter([(1, 2), (2, 1)])


def test_repeats_are_suppressed(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet")
    path = str(tmp_path / "events.parquet")
    rows.unionByName(rows).coalesce(1).write.parquet(path)
    found = S.drain(S.once(S.event_stream(spark, path)).select("event_id"), "once")
    assert _rows(found) == _rows(rows.select("event_id").distinct())
