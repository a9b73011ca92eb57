"""SimHash near-duplicates with Golay-code fuzzy hashing.

A document's 64-bit fingerprint is the bitwise majority over the XXH64 hashes
of its four-word shingles. Two fingerprints link when at most four bits
differ; documents linked directly or through others form one group.

Candidate search. The fingerprint is cut into four 16-bit segments. Padded
with zeros to 23 bits, a segment lies within three bits of exactly one word of
the perfect Golay code; the code words within four bits of it (one, or six)
are its *near* set. If two segments differ in one bit at most, the nearest
code word of one is in the near set of the other. With four differing bits
over four segments, one of two cases holds:

* some segment is equal, and of the other three one differs in one bit at
  most: key = (which two, the equal 16 bits, a code word of the other);
* each segment differs in exactly one bit: key = (the code words of the first
  two segments, the parities of all four, which all flip).

So every link meets in a key. Each fingerprint probes with 13 keys and is
listed under about 90; a key run is checked as it streams by. Runs longer than
``RUN_LIMIT`` are not paired: their fingerprints go through mid-points instead
(two words at distance four or less have a word within two bits of both, and
all words around one mid-point are linked), which costs a fixed number of rows
a fingerprint however large the group is, and loses no link.

Edge cases: null text counts as empty; documents without a word have
fingerprint zero and link like any other; repeated rows give repeated result
rows; rows without a doc_id keep a null id and take the group of their
fingerprint; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import components, few, stored

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: A key with more fingerprints than this is resolved through mid-points, not pairs.
RUN_LIMIT = 256
#: Shingles hashed at a time, so that a very long text needs little memory.
BLOCK = 1 << 18

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
#: Generator polynomial of the binary Golay code of length 23 (fixed value).
_GOLAY = 0b110001110101


def hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of a text, in order, repeats included; none for a text without words."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    ends = np.append(np.flatnonzero(np.frombuffer(line, np.uint8) == 32), len(line))
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(found) - shingle + 1)
    ends = ends[shingle - 1 :] if len(found) >= shingle else ends[-1:]
    out = np.empty(n, np.uint64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        a, b = starts[at : min(n, at + BLOCK)].tolist(), ends[at : at + BLOCK].tolist()
        out[at : at + BLOCK] = [digest(line[i:j], SEED) for i, j in zip(a, b)]
    return out


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as an unsigned integer."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(h), BLOCK):
        per_byte = h[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            count[8 * k : 8 * k + 8] += np.bincount(per_byte[:, k], minlength=256) @ _BITS
    return int(((count * 2 > len(h)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text as an unsigned integer."""
    h = hashes(text, shingle)
    return majority(h) if len(h) else 0


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


@lru_cache(1)
def near_words() -> np.ndarray:
    """For each 16-bit segment the code words within four bits: nearest first, -1 where none."""
    code = np.zeros(4096, np.uint32)
    for bit in range(12):
        code ^= np.where(np.arange(4096) >> bit & 1, np.uint32(_GOLAY << bit), np.uint32(0))
    out = np.full((1 << 16, 6), -1, np.int64)
    for at in range(0, 1 << 16, 2048):
        part = np.arange(at, at + 2048, dtype=np.uint32)
        apart = np.bitwise_count(part[:, None] ^ code[None, :])
        row, word = np.nonzero(apart <= 4)
        order = np.lexsort((apart[row, word], row))
        row, word = row[order], word[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        out[at + row, rank] = word
    return out


def _keys(fps: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fingerprint, is it a probe) for all keys of ``fps`` (unsigned)."""
    seg = [((fps >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64) for k in range(4)]
    parity = sum((np.bitwise_count(seg[k]).astype(np.int64) & 1) << k for k in range(4))
    found: list[tuple[np.ndarray, np.ndarray, bool]] = []
    for tag, (i, j) in enumerate((i, j) for i in range(4) for j in range(4) if i != j):
        head = (tag << 28) | (seg[i] << 12)
        for rank in range(6):
            word = near[seg[j], rank]
            ok = word >= 0
            found.append(((head | word)[ok], fps[ok], False))
        found.append((head | near[seg[j], 0], fps, True))
    head = (12 << 28) | (parity << 24)
    for a in range(6):
        for b in range(6):
            w, v = near[seg[0], a], near[seg[1], b]
            ok = (w >= 0) & (v >= 0)
            found.append(((head | (w << 12) | v)[ok], fps[ok], False))
    probe = (12 << 28) | ((parity ^ 15) << 24) | (near[seg[0], 0] << 12) | near[seg[1], 0]
    found.append((probe, fps, True))
    return tuple(np.concatenate(x) for x in ([f[0] for f in found], [f[1] for f in found], [np.full(len(f[0]), f[2]) for f in found]))


def _runs(batches: Iterator[pa.RecordBatch], columns: int, limit: int) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """Runs of equal keys in sorted batches: (is it cut short, columns without the key).

    A run longer than ``limit`` is given in pieces, marked as cut short; the next
    piece then begins with the last row of the one before.
    """
    rest: list[np.ndarray] | None = None
    long_run = False
    for batch in batches:
        now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(columns)]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now)]
        if not len(now[0]):
            continue
        cuts = np.append(np.flatnonzero(now[0][1:] != now[0][:-1]) + 1, len(now[0]))
        starts = np.append(0, cuts[:-1])
        keep = np.flatnonzero(cuts[:-1] - starts[:-1] >= 2)
        for k in keep.tolist():
            part = [x[starts[k] : cuts[k]] for x in now[1:]]
            yield (long_run and k == 0) or len(part[0]) > limit, part
        if len(starts) > 1:
            long_run = False
        rest = [x[starts[-1] :] for x in now]
        if len(rest[0]) > limit:
            yield True, [x for x in rest[1:]]
            rest, long_run = [x[-1:] for x in rest], True
    if rest is not None and len(rest[0]) >= 2:
        yield long_run or len(rest[0]) > limit, rest[1:]


def links(distinct_fps: DataFrame, run_limit: int = RUN_LIMIT) -> DataFrame:
    """(a, b) for linked fingerprints: all links of small key runs, and for the others enough of
    them to leave every group connected."""
    spark = distinct_fps.sparkSession
    near = spark.sparkContext.broadcast(near_words())  # always 65,536 x 6

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 4096):
                key, fp, probe = _keys(fps[at : at + 4096], near.value)
                yield pa.record_batch([pa.array(key), pa.array(fp.view(np.int64)), pa.array(probe)], ["key", "fp", "probe"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        held = 0

        def full() -> pa.RecordBatch:
            a, b = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
            return pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

        for cut_short, (fp, probe) in _runs(batches, 3, run_limit):
            if cut_short:  # a == b marks a fingerprint that goes through mid-points
                found = np.stack([fp, fp])
            else:
                x, y = fp[probe], fp[~probe]
                i, j = np.nonzero(np.bitwise_count(x.view(np.uint64)[:, None] ^ y.view(np.uint64)[None, :]) <= MAX_BITS)
                found = np.stack([x[i], y[j]])
                found = found[:, found[0] < found[1]]
            if found.shape[1]:
                out.append(found)
                held += found.shape[1]
            if held > 1 << 16:
                yield full()
                out, held = [], 0
        yield full()

    keyed = distinct_fps.select("fp").mapInArrow(spread, "key long, fp long, probe boolean")
    keyed = keyed.repartition("key").sortWithinPartitions("key")
    near_pairs = stored(keyed.mapInArrow(pair, "a long, b long").distinct())
    dense = near_pairs.where("a = b").select(F.col("a").alias("fp"))
    near_pairs = near_pairs.where("a <> b")
    if dense.isEmpty():
        return near_pairs
    return near_pairs.unionByName(_through_midpoints(dense))


def _through_midpoints(fps: DataFrame) -> DataFrame:
    masks = np.array([0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i, j in combinations(range(64), 2))], np.uint64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 64):
                part = fps[at : at + 64]
                mid = (part.view(np.uint64)[:, None] ^ masks[None, :]).ravel().view(np.int64)
                yield pa.record_batch([pa.array(mid), pa.array(np.repeat(part, len(masks)))], ["mid", "fp"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (fp,) in _runs(batches, 2, 1 << 16):
            yield pa.record_batch([pa.array(fp[:-1]), pa.array(fp[1:])], ["a", "b"])

    around = fps.mapInArrow(spread, "mid long, fp long").repartition("mid").sortWithinPartitions("mid")
    return around.mapInArrow(chain, "a long, b long").where("a <> b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, run_limit: int = RUN_LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (long), component_id (smallest doc_id of its group)."""
    marked = stored(fingerprints(docs, shingle))
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = components(links(classes, run_limit)).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(groups, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each group: that with the smallest doc_id.

    Rows without a doc_id stay. Of repeated rows with one doc_id one stays.
    """
    return kept_of(docs, near_duplicates(docs, shingle))


def kept_of(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` without the rows whose group (doc_id, component_id) has a smaller doc_id."""
    found = stored(groups.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("n")))
    gone = few(found.where("component_id <> doc_id").select("doc_id"))
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    again = found.where("component_id = doc_id and n > 1").select("doc_id")
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(once)


def hex_of(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", hex_of().alias("fingerprint"), "component_id")
