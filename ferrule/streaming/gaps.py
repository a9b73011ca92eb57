"""Gaps: what is asked for again and again, under keys that need not be equal, kept up by a stream.

A prompt belongs to the entry whose tokens overlap most with its own, from
``LEAST`` on and the oldest of equals; else it starts one, under a key made of its tokens.
An entry takes over the tokens of its last prompt, so its place drifts, and the
order of prompts counts. Entries that no prompt touched for ``KEPT`` seconds are
gone when the next prompt comes.

Prompts can only act on each other through a chain of overlapping token sets.
So the different sets of a batch are joined by similarity with each other and
with the sets of the entries there are; the groups that hang together are
independent, and each is folded in order of time in one pass over sorted rows.
A prompt that comes several times in a row is one row before that. Entries without such a link are
carried on as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions.text import intent_key, intent_tokens
from ferrule.operators import similar
from ferrule.sources.shared import stored

LEAST, KEPT, EXAMPLES, EXAMPLE = 0.6, 30 * 86400, 5, 120
ENTRY = "key string, tokens array<string>, born long, first long, last long, count long, examples array<string>"


def sightings(prompts: DataFrame) -> DataFrame:
    """(ord, at, prompt, tokens, key) of prompts (ord, at, prompt), without those that have no tokens."""
    rows = prompts.withColumn("tokens", F.array_sort(intent_tokens(F.col("prompt")))).where(F.size("tokens") > 0)
    return rows.select("ord", "at", F.substring("prompt", 1, EXAMPLE).alias("prompt"), "tokens", intent_key(F.col("tokens")).alias("key"))


def _set_id(tokens):
    return F.sha1(F.array_join(F.array_sort(F.array_distinct(tokens)), "\x00"))


def _runs(seen: DataFrame) -> DataFrame:
    """Neighbouring sightings of one prompt in a group as one row: (group, ord, key, tokens, first, last, n, prompt).

    A run also ends at a pause that an entry does not outlive.
    """
    w = Window.partitionBy("group").orderBy("ord")
    same = (F.lag("prompt").over(w) == F.col("prompt")) & (F.lag("set_id").over(w) == F.col("set_id")) & (F.col("at") - F.lag("at").over(w) <= KEPT)
    rows = seen.withColumn("run", F.sum(F.when(same, 0).otherwise(1)).over(w))
    return rows.groupBy("group", "run").agg(
        F.min("ord").alias("ord"), F.first("key").alias("key"), F.first("tokens").alias("tokens"), F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n"), F.first("prompt").alias("prompt"))


class _Group:
    """The entries of one group, in the order in which they were started."""

    def __init__(self) -> None:
        self.entries: dict[str, dict] = {}

    def take(self, e: dict) -> None:
        self.entries[e["key"]] = e

    def see(self, r: dict) -> None:
        tokens = set(r["tokens"])
        for key in [k for k, e in self.entries.items() if e["last"] < r["first"] - KEPT]:
            del self.entries[key]
        best, key = 0.0, None
        for k, e in self.entries.items():
            own = set(e["tokens"])
            j = len(own & tokens) / len(own | tokens)
            if j > best:
                best, key = j, k
        key = key if best >= LEAST else r["key"]
        e = self.entries.get(key) or {"key": key, "born": r["ord"], "first": r["first"], "count": 0, "examples": []}
        examples = list(e["examples"])
        for p in r["prompts"]:
            if p not in examples:
                examples = (examples + [p])[-EXAMPLES:]
        self.entries[key] = e | {"tokens": r["tokens"], "last": r["last"], "count": e["count"] + r["n"], "examples": examples}


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.string()), ("tokens", pa.list_(pa.string())), ("born", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("count", pa.int64()), ("examples", pa.list_(pa.string()))])
    now, group = None, _Group()
    for batch in batches:
        for r in batch.to_pylist():
            if r["group"] != now:
                if group.entries:
                    yield pa.RecordBatch.from_pylist(list(group.entries.values()), schema)
                now, group = r["group"], _Group()
            if r["is_entry"]:
                group.take({"key": r["key"], "tokens": r["tokens"], "born": r["ord"], "first": r["first"], "last": r["last"], "count": r["n"], "examples": r["prompts"]})
            else:
                group.see(r)
    if group.entries:
        yield pa.RecordBatch.from_pylist(list(group.entries.values()), schema)


def merged(entries: DataFrame, prompts: DataFrame) -> DataFrame:
    """The entries after some prompts (ord, at, prompt); ``ord`` and ``at`` go on from what was seen before."""
    seen = stored(sightings(prompts).withColumn("set_id", _set_id(F.col("tokens"))))
    held = stored(entries.withColumn("set_id", _set_id(F.col("tokens"))))
    sets = stored(seen.groupBy("set_id").agg(F.first("tokens").alias("t")))
    near = similar.links(sets, LEAST, held.select("set_id", F.col("tokens").alias("t")).dropDuplicates(["set_id"]))
    # an entry may have drifted from the set that its key stands for: both belong to one group
    keys = seen.select("set_id", "key").join(held.select("key", F.col("set_id").alias("b")), "key").select(F.col("set_id").alias("a"), "b").where("a <> b")
    drifted = held.groupBy("set_id").agg(F.min("set_id").alias("b")).select(F.col("set_id").alias("a"), "b")
    found = similar.components(near.select("a", "b").unionByName(keys).unionByName(drifted).unionByName(sets.select(F.col("set_id").alias("a"), F.col("set_id").alias("b"))))
    groups = stored(found.select(F.col("node").alias("set_id"), F.col("root").alias("group")))
    touched = sets.select("set_id").join(groups, "set_id").select("group").distinct()
    near_held = held.join(groups, "set_id", "left")
    mine = near_held.join(touched, "group", "left_semi")
    rest = near_held.join(touched, "group", "left_anti").select("key", "tokens", "born", "first", "last", "count", "examples")
    runs = _runs(seen.join(groups, "set_id")).select("group", F.lit(False).alias("is_entry"), "ord", "key", "tokens", "first", "last", "n", F.array("prompt").alias("prompts"))
    olds = mine.select("group", F.lit(True).alias("is_entry"), F.col("born").alias("ord"), "key", "tokens", "first", "last", F.col("count").alias("n"), F.col("examples").alias("prompts"))
    # entries first, in the order in which they were started
    rows = olds.unionByName(runs).withColumn("late", ~F.col("is_entry")).repartition("group").sortWithinPartitions("group", "late", "ord")
    folded = rows.select("group", "is_entry", "ord", "key", "tokens", "first", "last", "n", "prompts").mapInArrow(_fold, ENTRY)
    every = stored(folded.unionByName(rest))
    latest = seen.agg(F.max("at").alias("now"))  # one row
    return every.crossJoin(F.broadcast(latest)).where(F.col("now").isNull() | (F.col("last") >= F.col("now") - KEPT)).drop("now")


class Sink:
    """Sink for ``foreachBatch``: version n of the entries is made from version n - 1 and batch n of prompts (ord, at, prompt).

    A batch that is run again after a failure writes the same version again. Versions before the last two are deleted.
    """

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def path(self, version: int) -> str:
        return f"{self.folder}/version={version}"

    def entries(self, spark: SparkSession, version: int) -> DataFrame:
        if version < 0:
            return spark.createDataFrame([], ENTRY)
        return spark.read.schema(ENTRY).parquet(self.path(version))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        merged(self.entries(spark, batch_id - 1), stored(batch)).write.mode("overwrite").parquet(self.path(batch_id))
        self.version = batch_id
        old = spark._jvm.org.apache.hadoop.fs.Path(self.path(batch_id - 2))
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def kept_up(prompts: DataFrame, folder: str) -> DataFrame:
    """The entries after all that a stream of prompts (ord, at, prompt) gives now."""
    spark, sink = prompts.sparkSession, Sink(f"{folder}/entries")
    sink.version = -1
    prompts.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sink.entries(spark, sink.version)


def plan_rekey(entries: DataFrame, most: int = 24, held: int = 64) -> DataFrame:
    """What a re-keying would do to each entry (key, tokens, count, served, installed): (key, action, new_key, n_tokens, entry...).

    Long or hashed keys that nothing was decided on are dropped; other long ones get a hashed key; the rest stays.
    """
    n = F.size("tokens")
    long = (n > most) | F.col("key").startswith("intent:")
    action = F.when(long & F.col("served").isNull() & F.col("installed").isNull(), "drop").when(long, "rekey").otherwise("keep")
    new = F.when(long, intent_key(F.array_sort(F.array_distinct("tokens")))).otherwise(F.col("key"))
    return entries.select("*", n.alias("n_tokens"), action.alias("action"), new.alias("new_key")).withColumn("tokens", F.slice(F.array_sort(F.array_distinct("tokens")), 1, held))


def apply_rekey(plan: DataFrame) -> DataFrame:
    """The entries after a plan: those that meet under one key add up, the latest stays, and the first decision that is there."""
    order = F.struct("born", "key")
    kept = plan.where("action <> 'drop'")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    return kept.groupBy(F.col("new_key").alias("k")).agg(
        F.min_by("tokens", order).alias("tokens"), F.min("born").alias("born"), F.min_by("first", order).alias("first"), F.max("last").alias("last"), F.sum("count").alias("count"),
        F.min_by("examples", order).alias("examples"), first("served"), first("installed")).withColumnRenamed("k", "key")
