"""Jobs that run the table of events as a stream, to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.jobs import derived, signals
from ferrule.sources.shared import new_folder, stored
from ferrule.streaming import events as S
from ferrule.streaming import gaps as G


def _stream(spark, d):
    return S.event_stream(spark, f"{d}/events.parquet")


def interval_pairs(spark, d):
    return S.drain(S.interval_pairs(_stream(spark, d)), "interval-pairs")


def one_to_one(spark, d):
    with S.state_on_disk(spark):
        return S.drain(S.one_to_one(_stream(spark, d)), "one-to-one")


def once(spark, d):
    return S.drain(S.once(_stream(spark, d)).select("event_id"), "once")


def user_totals(spark, d):
    return S.user_totals(_stream(spark, d))


def gap_entries(spark, d, batches: int = 3):
    """What prompts ask for again, kept up over several batches by keys that need not be equal."""
    folder = new_folder(spark, "gaps")
    rows = derived.rows(spark, d, derived.PROMPTS).where("prompt_id LIKE 'p%'").select(F.substring("prompt_id", 2, 20).cast("long").alias("ord"), "prompt")
    rows = stored(rows.select("ord", (F.col("ord") * 3600).alias("at"), "prompt"))
    share = (rows.agg(F.max("ord").alias("n")).first()["n"] or 0) // batches + 1
    for k in range(batches):  # one after the other, since a stream takes files by their times
        rows.where(F.floor(F.col("ord") / share) == k).coalesce(1).write.mode("append").parquet(f"{folder}/asked")
    asked = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/asked")
    entries = G.kept_up(asked, folder)
    return entries.select("key", "first", "last", "count", F.array_join("examples", " | ").alias("examples"))


QUERIES = {
    "gap_entries": (gap_entries, None),
    "stream_interval_pairs": (interval_pairs, signals.QUERIES["interval_pairs"][1]),
    "stream_one_to_one_pairs": (one_to_one, signals.QUERIES["one_to_one_pairs"][1]),
    "stream_once": (once, "SELECT DISTINCT event_id FROM events"),
    "stream_user_totals": (user_totals, "SELECT user_id, count(*) AS n, max(epoch_us(ts) // 1000000) AS latest FROM events GROUP BY user_id"),
}
