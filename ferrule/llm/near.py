"""Near copies: SimHash groups, widened by an exact check of five-word shingles.

At a similarity of 0.8 the fingerprints of two texts often lie eight bits apart,
so groups of fingerprints within four bits miss many near copies. This stage
links, besides these, texts whose sets of five-word shingles have a Jaccard
similarity of ``LEAST`` or more:

* texts with the same set are one class and go on as one;
* the hashes of a set are cut into ``BINS`` equal ranges, and the least hash of
  each is the sketch; every ``BAND`` bins in a row make a key, so that a pair at
  0.8 shares none of its keys once in six hundred times;
* the classes of a key stream by in blocks. In a block a greatest spanning
  forest by agreement of sketches is taken, as many links as classes at most,
  however many are alike; some classes of the blocks before stand in each block;
* the links are checked against the sets themselves;
* what blocks and forests left out follows: all pairs of a key that agree well
  enough and lie in different groups by then are checked too, and where they are
  many, their sets are compared where they meet and make no rows. So no link between
  classes that share a key is lost, and a group of copies is not paired out.

Edge cases are those of ``simhash``: null text counts as empty, texts without
a word are copies of each other, rows without a doc_id stay, of repeated rows
with one doc_id one stays, an empty table gives none, other columns are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm import simhash
from ferrule.llm.common import BROADCAST_ROWS, components, few, kept, stored

SHINGLE, LEAST = 5, 0.8
BINS, BAND = 48, 4
#: Share of equal bins from which a pair is checked: three standard errors below 0.8.
CHECKED = 0.6
#: Classes of a key taken at a time, and how many of the first ones stand in every block.
BLOCK, FIRST = 256, 32
#: Pairs for each class held in a block beyond which its sets are compared in place, and hashes of sets that a block may hold (4 MB).
CROWD, HASHES = 4, 1 << 19


def sketched(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, same, size, sketch): fingerprint, digest and size of the set of shingles, least hash of each bin (-1: none)."""
    edges = (np.arange(1, BINS, dtype=np.float64) / BINS * 2.0**64).astype(np.uint64)

    def one(text: str | None) -> tuple[int, int, int, np.ndarray]:
        h = simhash.hashes(text, shingle)
        if not len(h):
            return 0, 0, 0, np.full(BINS, -1, np.int32)
        own = np.unique(h)
        at = np.concatenate([[0], np.searchsorted(own, edges), [len(own)]])
        full = at[1:] > at[:-1]
        sketch = np.where(full, (own[np.minimum(at[:-1], len(own) - 1)] >> np.uint64(20) & np.uint64(0x7FFFFFFF)).astype(np.int64), -1)
        return simhash.majority(h), int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True), len(own), sketch.astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("near", dict)  # what another operator left in this process goes
        for batch in batches:
            found = [one(t.as_py()) for t in batch.column(1)]
            if found:
                fps = np.array([f[0] for f in found], np.uint64).view(np.int64)
                sketches = np.concatenate([f[3] for f in found])
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * BINS), pa.array(sketches))
                yield pa.record_batch([batch.column(0), pa.array(fps), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), listed], ["doc_id", "fp", "same", "size", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long, same long, size long, sketch array<int>")


def _keys(m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, key) for each band; a band without a hash is no key."""
    for band in range(BINS // BAND):
        part = m[:, band * BAND : (band + 1) * BAND].astype(np.int64).view(np.uint64)
        key = np.full(len(m), np.uint64(band + 1))
        for c in range(BAND):
            key = (key ^ part[:, c]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        rows = np.flatnonzero((m[:, band * BAND : (band + 1) * BAND] >= 0).any(axis=1))
        yield rows, key[rows].view(np.int64)


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal bins of each sketch of ``x`` with each of ``y``; bins that are empty in both do not count."""
    both_empty = ((x < 0).astype(np.float32) @ (y < 0).astype(np.float32).T).astype(np.int64)
    equal = sum((x[:, k, None] == y[None, :, k]).astype(np.uint8) for k in range(BINS))
    return (equal - both_empty) / np.maximum(1, BINS - both_empty)


def _forest(ids: np.ndarray, m: np.ndarray, old: int) -> list[tuple[int, int]]:
    """Links of a greatest spanning forest by agreement of sketches; the first ``old`` classes are not linked among themselves."""
    agree = _agreement(m, m)
    i, j = np.nonzero(np.triu(agree >= CHECKED, 1))
    keep = j >= old
    i, j = i[keep], j[keep]
    root, out = list(range(len(ids))), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k in np.argsort(-agree[i, j], kind="stable").tolist():
        a, b = top(int(i[k])), top(int(j[k]))
        if a != b:
            root[a] = b
            out.append((int(ids[i[k]]), int(ids[j[k]])))
    return out


def keyed(classes: DataFrame) -> DataFrame:
    """(key, id, n) of the keys that n classes (id, sketch) share, two or more; stored."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(0).to_numpy()
                for rows, key in _keys(batch.column(1).flatten().to_numpy().reshape(-1, BINS)):
                    yield pa.record_batch([pa.array(key), pa.array(ids[rows])], ["key", "id"])

    every = stored(classes.select("id", "sketch").mapInArrow(spread, "key long, id long"))
    return stored(every.join(every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key"))


def candidates(classes: DataFrame, of_key: DataFrame, block: int = BLOCK, first: int = FIRST) -> DataFrame:
    """(a, b) of classes (id, sketch) that share a key and agree well enough to be checked: enough of them to join most that are alike."""
    members = of_key.select("key", "id").join(classes.select("id", "sketch"), "id").select("key", "id", "sketch")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sketches, old = None, [], [], 0

        def links() -> pa.RecordBatch:
            found = _forest(np.array(ids), np.array(sketches), old) if len(ids) > old and len(ids) > 1 else []
            return pa.record_batch([pa.array([f[k] for f in found], pa.int64()) for k in range(2)], ["a", "b"])

        for batch in batches:
            keys, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows = batch.column(2).flatten().to_numpy().reshape(-1, BINS)
            for k in range(len(keys)):
                if keys[k] != now:
                    yield links()
                    now, ids, sketches, old = keys[k], [], [], 0
                elif len(ids) >= old + block:
                    yield links()
                    ids, sketches = ids[:first], sketches[:first]
                    old = len(ids)
                ids.append(own[k])
                sketches.append(rows[k])
        yield links()

    pairs = members.repartition("key").sortWithinPartitions("key", "id").mapInArrow(pair, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _meetings(batches: Iterator[pa.RecordBatch], block: int, most: int) -> Iterator[tuple[tuple[int, int], list, list]]:
    """((key, at), held, waiting): columns of the classes held there and of the next that meet them, ``block`` of them or ``most`` hashes at a time."""
    now, held, waiting, hashes = None, [], [], 0

    def columns() -> Iterator[tuple[tuple[int, int], list, list]]:
        if held and waiting:
            yield now, *([[*map(np.array, c[:5]), *c[5:]] for c in (list(zip(*rows)) for rows in (held, waiting))])

    for batch in batches:
        key, at, other, *plain = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(7))
        sketches = batch.column(7).flatten().to_numpy().reshape(-1, BINS)
        sets = [batch.column(k) for k in range(8, batch.num_columns)]
        for k in range(len(key)):
            if (key[k], at[k]) != now:
                yield from columns()
                now, held, waiting, hashes = (key[k], at[k]), [], [], 0
            elif len(waiting) >= block or hashes >= most:
                yield from columns()
                waiting, hashes = [], 0
            own = [c[k].values.to_numpy().view(np.uint64) for c in sets]
            if other[k]:
                hashes += sum(map(len, own))
            (waiting if other[k] else held).append((*(c[k] for c in plain), sketches[k], *own))
    yield from columns()


def _likely(held: list, waiting: list) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of held and waiting classes of different groups that agree well enough and are near enough in size."""
    (x, rx, _, nx, sx), (y, ry, out, ny, sy) = held[:5], waiting[:5]
    # two classes outside the greatest group meet twice
    near_size = np.minimum(nx[:, None], ny[None, :]) >= LEAST * np.maximum(nx[:, None], ny[None, :])
    return np.nonzero((_agreement(sx, sy) >= CHECKED) & near_size & (rx[:, None] != ry[None, :]) & (~out[None, :] | (x[:, None] < y[None, :])))


def _common(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many hashes a set, sorted and not empty, has in common with each of the others."""
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, every), len(own) - 1)
    return np.diff(np.append(0, np.cumsum(own[at] == every))[np.append(0, np.cumsum([len(o) for o in others]))])


def meeting(classes: DataFrame, of_key: DataFrame, found: DataFrame, block: int = BLOCK, most: int = HASHES) -> DataFrame:
    """(key, at, other, id, root, out, size, sketch): which classes of a key are held at a place, and which meet them there.

    Of a key, the classes outside its greatest group (node, root) are dealt out over blocks, and all of its classes meet each block.
    """
    named = of_key.where("n > 2").select("key", "id").join(found.select(F.col("node").alias("id"), "root"), "id", "left")  # a key of two has no pair left
    named = stored(named.join(classes.select("id", "size"), "id").select("key", "id", F.coalesce("root", "id").alias("root"), "size"))
    sizes = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("size").alias("hashes"))
    split = sizes.groupBy("key").agg(F.max_by("root", F.struct("k", "root")).alias("main"), (F.sum("k") - F.max("k")).alias("outside"), (F.sum("hashes") - F.max_by("hashes", F.struct("k", "root"))).alias("hashes")).where("outside > 0")
    split = split.select("key", "main", F.ceil(F.greatest(F.col("outside") / block, F.col("hashes") / most)).cast("int").alias("blocks"))
    rows = named.join(split, "key").withColumn("out", F.col("root") != F.col("main")).join(classes.select("id", "size", "sketch"), ["id", "size"])
    own = rows.where("out").withColumn("at", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("other", F.lit(False))
    others = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("other", F.lit(True))
    columns = ["key", "at", "other", "id", "root", "out", "size", "sketch"]
    return own.select(columns).unionByName(others.select(columns))


def left_out(met: DataFrame, block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """(key, at, a, b): the pairs of ``met`` that share a key, agree well enough and are in different groups.

    Sets whose sizes alone rule out the similarity are no pair. Where there are more than ``crowd`` for each class that is
    held, the place alone is given, a and b being null: ``crowded`` goes through its pairs.
    """

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pairs = None, []

        def given() -> pa.RecordBatch:
            a, b = ([pa.array(np.concatenate([np.zeros(0, np.int64), *(p[k] for p in pairs)])) for k in range(2)]) if pairs is not None else [pa.nulls(1, pa.int64())] * 2
            key, at = now or (0, 0)
            return pa.record_batch([pa.array(np.full(len(a), key, np.int64)), pa.array(np.full(len(a), at, np.int32)), a, b], ["key", "at", "a", "b"])

        for unit, held, waiting in _meetings(batches, block, HASHES):
            if unit != now:
                yield given()
                now, pairs = unit, []
            if pairs is not None:
                i, j = _likely(held, waiting)
                a, b = held[0][i], waiting[0][j]
                pairs.append((np.minimum(a, b), np.maximum(a, b)))
                if sum(len(p[0]) for p in pairs) > crowd * len(held[0]):
                    pairs = None
        yield given()

    dealt = met.repartition("key", "at").sortWithinPartitions("key", "at", "other")
    return dealt.mapInArrow(pair, "key long, at int, a long, b long")


def crowded(met: DataFrame, places: DataFrame, docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST, block: int = BLOCK, most: int = HASHES) -> DataFrame:
    """(a, b): links that join all groups which any pair of ``met`` at ``places`` (key, at) joins; the sets are compared where they meet.

    A place gives fewer links than it has classes, however many pairs it has.
    """
    rows = met.join(F.broadcast(places) if places.count() <= BROADCAST_ROWS else places, ["key", "at"], "left_semi")
    own = sets(docs, rows.select("id").distinct(), shingle)
    rows = rows.join(own.withColumnRenamed("doc_id", "id"), "id").select(*rows.columns, "set")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, above = None, {}

        def top(x: int) -> int:
            while (up := above.get(x, x)) != x:
                above[x] = x = above.get(up, up)
            return x

        for unit, held, waiting in _meetings(batches, block, most):
            if unit != now:
                now, above = unit, {}
            i, j = _likely(held, waiting)
            links = []
            for k, which in zip(*_runs(i, j)):
                x, mine = held[5][k], held[1][k]
                which = [w for w in which.tolist() if top(mine) != top(waiting[1][w])]
                if not which or not len(x):
                    continue
                common = _common(x, [waiting[5][w] for w in which])
                alike = common >= least * (len(x) + np.array([len(waiting[5][w]) for w in which]) - common)
                for w in np.array(which)[alike].tolist():
                    a, b = top(mine), top(waiting[1][w])
                    if a != b:
                        above[a] = b
                        links.append((int(held[0][k]), int(waiting[0][w])))
            yield pa.record_batch([pa.array([n[c] for n in links], pa.int64()) for c in range(2)], ["a", "b"])

    dealt = rows.repartition("key", "at").sortWithinPartitions("key", "at", "other")
    return dealt.mapInArrow(link, "a long, b long")


def _runs(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different values of ``i``, sorted, and the part of ``j`` for each."""
    own, starts = np.unique(i, return_index=True)
    return own, np.split(j, starts[1:])


def sets(docs: DataFrame, asked: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, set) of the rows whose doc_id is asked for, stored; the texts of repeated rows with one doc_id all count."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few(stored(asked.toDF("doc_id"))), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                own = np.unique(simhash.hashes(text.as_py(), shingle)).view(np.int64)
                yield pa.record_batch([pa.array([doc_id.as_py()], pa.int64()), pa.array([own], pa.list_(pa.int64()))], ["doc_id", "set"])

    return stored(rows.mapInArrow(run, "doc_id long, set array<long>"))


def checked(pairs: DataFrame, docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """The pairs (a, b) of doc_ids whose sets of shingles have at least that Jaccard similarity."""
    own = sets(docs, pairs.select(F.explode(F.array("a", "b"))).distinct(), shingle)
    both = pairs.join(own.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), "a").join(own.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.withColumn("common", common).where(F.col("common") >= least * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b")


def groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, component_id) of every row with a doc_id: the smallest doc_id of its group."""
    marked = stored(sketched(docs.where("doc_id is not null"), shingle))
    classes = stored(marked.groupBy("same").agg(F.min("doc_id").alias("id"), F.min_by("fp", "doc_id").alias("fp"), F.min_by("size", "doc_id").alias("size"), F.min_by("sketch", "doc_id").alias("sketch")))
    of_key = keyed(classes)
    tried = stored(candidates(classes, of_key))
    links = checked(tried, docs, shingle)
    # fingerprints within four bits, from one class of each fingerprint to another
    of_fp = stored(classes.groupBy("fp").agg(F.min("id").alias("id")))
    near = simhash.links(of_fp.select("fp"))
    near = near.join(of_fp.select(F.col("fp").alias("a"), F.col("id").alias("ia")), "a").join(of_fp.select(F.col("fp").alias("b"), F.col("id").alias("ib")), "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"))
    same = classes.select("id", "fp").join(of_fp.select("fp", F.col("id").alias("a")), "fp").where("a <> id").select("a", F.col("id").alias("b"))
    found = stored(components(links.unionByName(near).unionByName(same)))
    met = meeting(classes, of_key, found)
    rest = stored(left_out(met))
    if not rest.isEmpty():
        pairs = stored(rest.where("a is not null").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"))
        more = checked(pairs, docs, shingle).unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        places = rest.where("a is null").select("key", "at")
        found = components(more if places.isEmpty() else more.unionByName(crowded(met, places, docs, shingle)))
    named = classes.select("same", "id").join(found.select(F.col("node").alias("id"), "root"), "id", "left").select("same", F.coalesce("root", "id").alias("component_id"))
    return marked.select("doc_id", "same").join(named, "same").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group: that with the smallest doc_id."""
    return simhash.kept_of(docs, groups(docs))
