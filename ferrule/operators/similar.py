"""Sets alike to a least Jaccard overlap, found without pairing all that share a member, and their groups.

Rows with the same set are one class. The members of a class's set are ordered
by rarity; two sets alike to the least share one of the first few (the prefix:
a set of n members that shares none of n - ceil(least * n) + 1 with another
overlaps too little). So the classes that have a prefix member in common are
compared, whole set with whole set, where they meet: a member's classes are
dealt into blocks, and each two blocks meet in one place. Of a meeting only
what is asked for goes on, a row for each class at most: its best other class,
or a forest that joins what is alike. Pairs are never written or shuffled, and
copies never meet as pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.sources.shared import stored

#: Classes of a member in a block, about, and members that are compared at a time.
BLOCK, WIDTH = 1024, 4096
#: An overlap in steps of 1/10000 stands above these bits, the other class's number (the first is the greatest) within.
BITS = 48


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, set_id) and (set_id, t, n, first, second), stored: the different sets of rows (id, t), their number of rows and their first two ids; empty sets are none."""
    own = rows.where(F.size("t") > 0).select("id", F.array_sort(F.array_distinct("t")).alias("t"))
    # the digest is grouped, not the set
    own = stored(own.withColumn("set_id", F.sha1(F.array_join("t", "\x00"))))
    ids = own.select("set_id", "id").distinct()
    least = stored(ids.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")))
    second = own.join(least.where("n > 1").select("set_id", "first"), "set_id").where("id > first").groupBy("set_id").agg(F.min("id").alias("second"))
    sets = own.join(least.select("set_id", "first"), "set_id").where("id = first").dropDuplicates(["set_id"]).select("set_id", "t")
    return ids, stored(sets.join(least, "set_id").join(second, "set_id", "left"))


def _numbered(sets: DataFrame, order: str) -> DataFrame:
    """``sets`` with nr, numbers that rise with ``order``, stored."""
    return stored(sets.orderBy(order).withColumn("nr", F.monotonically_increasing_id()))


def _meetings(sets: DataFrame, least: float) -> DataFrame:
    """(w, i, j, block, nr, size, asked, members): the sets (nr, t, asked) of a prefix member w, once for each two blocks (i, j) with its own."""
    long = sets.select("nr", F.size("t").alias("size"), "asked", F.explode("t").alias("word"))
    # a member that no other set has comes first in the order, and nothing meets there
    df = stored(long.groupBy("word").agg(F.count(F.lit(1)).alias("df")).where("df > 1").withColumn("w", F.monotonically_increasing_id()))
    own = long.join(df, "word").groupBy("nr").agg(F.first("size").alias("size"), F.first("asked").alias("asked"), F.array_sort(F.collect_list(F.struct("df", "w"))).alias("l"))
    n = F.col("size") - F.ceil(least * F.col("size")) + 1 - (F.col("size") - F.size("l"))
    own = stored(own.select("nr", "size", "asked", F.col("l.w").alias("members"), F.slice(F.col("l.w"), F.lit(1), F.greatest(n, F.lit(0)).cast("int")).alias("prefix")))
    prefix = own.select("nr", "size", "asked", "members", F.explode("prefix").alias("w"))
    blocks = prefix.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.max("asked").alias("any")).where("n > 1 and any").select("w", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    met = prefix.join(blocks, "w").withColumn("block", F.pmod(F.xxhash64("nr"), "blocks")).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return met.select("w", F.least("block", "at").alias("i"), F.greatest("block", "at").alias("j"), "block", "nr", "size", "asked", "members")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Each run of rows with one (w, i, j)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in range(3)])
        cut = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cut, cut[1:]):
            now = key[:, start].tolist()
            if now != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _alike(met: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(a, b, common, union) of a meeting: the numbers of the sets of both blocks, and counts for each two of them; where they are not alike, common is 0."""
    if met.num_rows < 2:
        return None
    block, nr, size = (met.column(k).to_numpy() for k in (3, 4, 5))
    asked = met.column(6).to_numpy(zero_copy_only=False)
    members = met.column(7).combine_chunks()
    members = members.flatten() if isinstance(members, pa.ListArray) else pa.concat_arrays([c.flatten() for c in members.chunks])
    at = np.repeat(np.arange(len(nr)), np.concatenate([np.diff(c.offsets.to_numpy()) for c in met.column(7).chunks]))
    _, place, times = np.unique(members.to_numpy(), return_inverse=True, return_counts=True)
    kept = times[place] > 1
    at, place = at[kept], (np.cumsum(times > 1) - 1)[place[kept]]
    alone = met.column(1)[0].as_py() == met.column(2)[0].as_py()
    a = np.arange(len(nr)) if alone else np.flatnonzero(block == met.column(1)[0].as_py())
    b = a if alone else np.flatnonzero(block != met.column(1)[0].as_py())
    common = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, int(place.max(initial=-1)) + 1, WIDTH):
        here = (place >= start) & (place < start + WIDTH)
        held = np.zeros((len(nr), min(WIDTH, int(place.max()) + 1 - start)), np.float32)
        held[at[here], place[here] - start] = 1
        common += held[a] @ held[b].T
    common = common.astype(np.int64)
    union = size[a].astype(np.int64)[:, None] + size[b][None, :] - common
    wrong = (common / union < least) | ~(asked[a][:, None] | asked[b][None, :]) | (nr[a][:, None] == nr[b][None, :])
    common[wrong] = 0
    return nr[a], nr[b], common, union


def _compared(sets: DataFrame, least: float, answer: Callable, schema: str) -> DataFrame:
    """What ``answer`` gives of each meeting, as arrays of numbers."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in _met(batches):
            found = _alike(met, least)
            if found is not None:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in answer(*found)], names)

    met = _meetings(sets, least).repartition("w", "i", "j").sortWithinPartitions("w", "i", "j")
    return met.mapInArrow(run, schema)


def _best(a: np.ndarray, b: np.ndarray, common: np.ndarray, union: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nr, best) for each set with one that is alike: the overlap rounded to four places, then the least number."""
    steps = np.where(common > 0, (20000 * common + union) // (2 * union), 0) << BITS
    last = (1 << BITS) - 1
    of_a = np.where(common > 0, steps | (last - b)[None, :], 0).max(axis=1)
    of_b = np.where(common > 0, steps | (last - a)[:, None], 0).max(axis=0)
    nr, best = np.concatenate([a, b]), np.concatenate([of_a, of_b])
    return nr[best > 0], best[best > 0]


def _forest(a: np.ndarray, b: np.ndarray, common: np.ndarray, union: np.ndarray) -> tuple[list[int], list[int]]:
    """(a, b) of links that join all that is alike, no more than there are sets in both blocks."""
    new_a, new_b = np.ones(len(a), bool), np.ones(len(b), bool)
    out: tuple[list[int], list[int]] = ([], [])
    alike = common > 0
    for start in range(len(a)):
        todo = [(True, start)] if new_a[start] else []
        new_a[start] = False
        while todo:
            of_a, k = todo.pop()
            new, ids = (new_b, b) if of_a else (new_a, a)
            found = np.flatnonzero((alike[k] if of_a else alike[:, k]) & new)
            new[found] = False
            out[0].extend([int(a[k] if of_a else b[k])] * len(found))
            out[1].extend(ids[found].tolist())
            todo.extend((not of_a, x) for x in found.tolist())
    return out


def links(sets: DataFrame, least: float, others: DataFrame | None = None) -> DataFrame:
    """(a, b): pairs of different sets (set_id, t) with at least that overlap that join the same groups as all such pairs; with ``others``, of a set and one of these or of ``sets``."""
    every = sets.select("set_id", "t", F.lit(True).alias("asked"))
    if others is not None:
        more = others.join(sets.select("set_id"), "set_id", "left_anti").select("set_id", "t", F.lit(False).alias("asked"))
        every = every.unionByName(more)
    every = _numbered(every.withColumn("t", F.array_distinct("t")), "set_id")
    found = stored(_compared(every, least, _forest, "x long, y long").distinct())
    name = every.select("nr", "set_id")
    return found.join(name.select(F.col("nr").alias("x"), F.col("set_id").alias("a")), "x").join(name.select(F.col("nr").alias("y"), F.col("set_id").alias("b")), "y").select("a", "b")


def best(rows: DataFrame, least: float) -> DataFrame:
    """(id, other, overlap): for each row (id, t) the other row most alike, the first of equals, if alike to the least."""
    ids, sets = classes(rows)
    sets = _numbered(sets.withColumn("asked", F.lit(True)), "first")
    chosen = stored(_compared(sets, least, _best, "nr long, best long").groupBy("nr").agg(F.max("best").alias("best")))
    last = (1 << BITS) - 1
    chosen = chosen.select("nr", (F.lit(last) - F.col("best").bitwiseAND(F.lit(last))).alias("to"), (F.shiftright("best", BITS) / 10000).alias("overlap"))
    chosen = chosen.join(sets.select(F.col("nr").alias("to"), F.col("first").alias("other")), "to").select("nr", "other", "overlap")
    of_set = sets.join(chosen, "nr", "left").select("set_id", "n", "first", "second", "other", "overlap")
    own = ids.join(of_set, "set_id")
    copy = F.col("n") > 1
    other = F.when(copy, F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first"))).otherwise(F.col("other"))
    # another set may reach the rounded overlap of a copy only if it is the same set
    return own.select("id", other.alias("other"), F.when(copy, 1.0).otherwise(F.col("overlap")).alias("overlap")).where("other is not null")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of undirected edges (a, b): the least node that is reached; each round takes the least label around and then that label's own."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both)
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        around = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("r"))
        less = label.join(around, "node").select("node", "root", F.least("root", "r").alias("less"))
        onward = label.select(F.col("node").alias("less"), F.col("root").alias("next"))
        step = stored(less.join(onward, "less", "left").select("node", F.least("less", F.coalesce("next", "less")).alias("root"), (F.least("less", F.coalesce("next", "less")) < F.col("root")).alias("moved")))
        label = step.drop("moved")
        if step.where("moved").isEmpty():
            return label
