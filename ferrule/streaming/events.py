"""Streams of events: pairing within an interval, one-to-one pairing, duplicate suppression, keyed upserts.

Every function takes and gives streaming DataFrames with columns event_id,
user_id, event_type and ``time``; ``drain`` runs one to its end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ferrule.sources.shared import new_folder

WINDOW = 6 * 3600


def event_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The files of a table of events as a stream."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # a pattern, since a stream takes a single file only as a match of one
    rows = reader.parquet(f"{path[:-1]}[{path[-1]}]")
    return rows.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("time"))


def drain(stream: DataFrame, name: str) -> DataFrame:
    """All that a stream gives for the input there is, written as Parquet and read back."""
    spark = stream.sparkSession
    folder = new_folder(spark, name)
    running = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/rows")
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def interval_pairs(events: DataFrame, seconds: int = WINDOW, late: str = "1 hour") -> DataFrame:
    """Views with the purchases of the same user that follow within the interval; both sides forget what can no longer pair."""
    views = events.where("event_type = 'view'").select(F.col("user_id").alias("v_user"), F.col("event_id").alias("view_id"), F.col("time").alias("v_time"))
    buys = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("buy_id"), F.col("time").alias("b_time"))
    in_time = F.expr(f"v_user = user_id AND b_time >= v_time AND b_time < v_time + INTERVAL {seconds} SECONDS")
    pairs = views.withWatermark("v_time", late).join(buys.withWatermark("b_time", late), in_time)
    gap = F.unix_timestamp("b_time") - F.unix_timestamp("v_time")
    # whole seconds decide, as in the batch query
    return pairs.where((gap >= 0) & (gap < seconds)).select("view_id", "buy_id", gap.alias("seconds"))


def once(events: DataFrame, key: str = "event_id", within: str = "90 seconds") -> DataFrame:
    """The first of the events with a key; repeats within the time are suppressed, and the state is bounded by it."""
    return events.withWatermark("time", within).dropDuplicatesWithinWatermark([key])


#: Seconds of a slot, and how many rows of a user a task holds before they go to the state.
SLOT, HELD = 3600, 20_000
_ROWS = "rows array<struct<at:bigint,kind:int,event:bigint>>"


class Pairing(StatefulProcessor):
    """One-to-one pairing of a user's purchases with the views before them.

    The state is the list of views still open, which the interval bounds, and a timer drops it by event time. Rows of
    a batch that are more than a task should hold go to a map of time slots in the state first; slots are then
    taken in order, one at a time.
    """

    def __init__(self, seconds: int, held: int = HELD) -> None:
        self.seconds, self.held = seconds, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.opened = handle.getListState("opened", "at bigint, event bigint")
        self.slots = handle.getMapState("slots", "slot bigint", _ROWS)

    def _put(self, rows: list[tuple[int, int, int]]) -> None:
        by_slot: dict[int, list] = {}
        for row in rows:
            by_slot.setdefault(row[0] // SLOT, []).append(row)
        for slot, more in by_slot.items():
            old = [tuple(r) for r in self.slots.getValue((slot,))[0]] if self.slots.containsKey((slot,)) else []
            self.slots.updateValue((slot,), (old + more,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now, several, latest = [], False, 0
        for r in rows:
            now.append((r["at"], r["kind"], r["event_id"]))
            latest = max(latest, r["at"])
            if len(now) >= self.held:
                self._put(now)
                now, several = [], True
        opened = [(v[0], v[1]) for v in self.opened.get()]
        if several:
            self._put(now)
            for slot in sorted(k[0] for k in list(self.slots.keys())):
                part = sorted(tuple(r) for r in self.slots.getValue((slot,))[0])
                self.slots.removeKey((slot,))
                opened = yield from self._pair(key[0], part, opened)
        else:
            opened = yield from self._pair(key[0], sorted(now), opened)
        self.opened.clear()
        if opened:
            self.opened.put(opened)
            # one timer a user: that of the last event
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(max((latest + self.seconds) * 1000, timerValues.getCurrentWatermarkInMs() + 1))

    def _pair(self, user: int, rows: list[tuple[int, int, int]], opened: list[tuple[int, int]]):
        for at, kind, event in rows:
            opened = [v for v in opened if at - v[0] <= self.seconds]
            if kind == 0:
                opened.append((at, event))
            elif opened:
                seen, view = opened.pop()
                yield Row(user_id=user, buy=event, view=view, seconds=at - seen)
        return opened

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.opened.clear()
        return iter(())

    def close(self) -> None:
        pass


def one_to_one(events: DataFrame, seconds: int = WINDOW, late: str = "1 hour", held: int = HELD) -> DataFrame:
    """Each purchase takes the user's most recent view within the interval that none took before.

    Events of one batch are taken in order of time. The state needs a store on disk: see ``state_on_disk``.
    """
    rows = events.where("event_type in ('view', 'purchase')").withWatermark("time", late)
    rows = rows.select("user_id", "event_id", "time", F.unix_timestamp("time").alias("at"), F.when(F.col("event_type") == "view", 0).otherwise(1).alias("kind"))
    return rows.groupBy("user_id").transformWithState(Pairing(seconds, held), "user_id long, buy long, view long, seconds long", "append", "EventTime")


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started within it keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Upsert:
    """Sink for ``foreachBatch``: a table of one row per key, written anew as a version for each batch.

    Batch n reads version n - 1 and writes version n, so a batch that is run
    again after a failure gives the same version; older ones are deleted. ``merge`` turns the rows of
    the version before and those of the batch into one row per key; both have
    the same columns.
    """

    def __init__(self, folder: str, merge: Callable[[DataFrame], DataFrame]) -> None:
        self.folder, self.merge, self.version = folder, merge, -1

    def path(self, version: int) -> str:
        return f"{self.folder}/version={version}"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id > 0:
            batch = batch.unionByName(batch.sparkSession.read.parquet(self.path(batch_id - 1)))
        self.merge(batch).write.mode("overwrite").parquet(self.path(batch_id))
        self.version = batch_id
        spark = batch.sparkSession
        old = spark._jvm.org.apache.hadoop.fs.Path(self.path(batch_id - 2))
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def user_totals(events: DataFrame) -> DataFrame:
    """(user_id, n, latest): events and last second of each user, kept by upserts."""
    spark = events.sparkSession
    folder = new_folder(spark, "user-totals")
    sink = Upsert(folder, lambda rows: rows.groupBy("user_id").agg(F.sum("n").alias("n"), F.max("latest").alias("latest")))
    rows = events.select("user_id", F.lit(1).cast("long").alias("n"), F.unix_timestamp("time").alias("latest"))
    rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if sink.version < 0:
        return spark.createDataFrame([], rows.schema)
    return spark.read.parquet(sink.path(sink.version))
