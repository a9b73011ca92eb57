"""Removal of long repeated byte strings, exactly, over the whole corpus.

Every byte covered by a ``LENGTH``-byte string (200) that also starts anywhere
else, in the same document or another, is removed. Strings never cross
documents and are judged on the input.

A shard here is what meets under one anchor. In each window of ``LENGTH``
bytes the anchor is the start of the 32-byte string with the least hash (the
leftmost of equals), so equal windows have equal anchors at equal offsets, and
a document needs about one anchor in 85 bytes. The windows of one anchor
occurrence are neighbours; the bytes they cover are its context.

0. Where texts are read, contexts found twice among ``HELD`` occurrences are
   settled but for one of each, so that a passage in very many texts sends few
   rows to its anchor.
1. Occurrences are sorted by (anchor, context hash). Contexts found twice are
   repeated in all their windows. A context found once, whose anchor has other
   contexts, stays open, and one of each of these others stands for its class.
2. Open contexts are cut out of their texts and meet by anchor; their windows
   are compared by hash and offset. Anchors with more than ``GROUP_LIMIT`` open
   contexts have their windows dealt out by window hash instead. Windows with
   one hash are compared in one task: what is held there grows with the number
   of different surroundings of one 200-byte string within these anchors.
3. Repeated windows become byte ranges, and each document is cut once.

This takes the place of merging shard suffix transforms by interleave
refinement, which needs a pass over all bytes for each of 200 characters of
common prefix (see the README).

Edge cases: null text counts as empty; texts shorter than ``LENGTH`` bytes
keep everything; repeated rows and rows without a doc_id are documents of
their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import stored

LENGTH = 200
SEED_BYTES = 32
#: Open contexts of an anchor that are compared in one task.
GROUP_LIMIT = 20_000
#: Occurrences that a task looks through for repeated contexts before they are shuffled.
HELD = 1 << 18
#: Bytes scanned at a time; parts overlap by a window.
PART = 1 << 19

_ODD = np.uint64(0x9E3779B97F4A7C15)  # any odd numbers with well-spread bits
_BASE = np.uint64(0xD6E8FEB86659FD93)


def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = PART + 2 * LENGTH
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_tables: list[np.ndarray] = []


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD
    h = (h ^ (h >> np.uint64(29))) * _BASE
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of any substrings of some bytes, by prefix sums of a polynomial modulo 2^64."""

    def __init__(self, raw: np.ndarray) -> None:
        if not _tables:
            _tables.extend(_powers())
        self.down = _tables[1]
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((_mixed(raw.astype(np.uint64) + np.uint64(1))) * _tables[0][: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` successive keys."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(raw: np.ndarray, length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor hash, context hash, first window, last window, anchor position) of all occurrences, in parts."""
    seed = min(SEED_BYTES, length)
    width = length - seed + 1
    for at in range(0, max(0, len(raw) - length + 1), PART):
        part = raw[at : at + PART + length - 1]
        if len(part) < length:
            return
        h = Hashes(part)
        starts = np.arange(len(part) - seed + 1)
        seeds = h.of(starts, starts + seed)
        low = np.uint64((1 << 20) - 1)
        chosen = (_least((seeds & ~low) | starts.astype(np.uint64), width) & low).astype(np.int64)
        first = np.append(0, np.flatnonzero(chosen[1:] != chosen[:-1]) + 1)
        last = np.append(first[1:], len(chosen)) - 1
        anchor = chosen[first]
        context = h.of(first, last + length) ^ _mixed((anchor - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64))
        yield seeds[anchor], context, first + at, last + at, anchor + at


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


#: Of occurrences, also whether the context is known to be found twice.
_OCCURRENCE = "anchor long, context long, row_id long, first long, last long, pos long"
_NAMES = ["anchor", "context", "row_id", "first", "last", "pos"]


def _occurrences(docs: DataFrame, length: int) -> DataFrame:
    def known(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        """One row of a context that these texts repeat stands for it, marked; the others are settled and go anywhere."""
        a, c, row, first, last, pos = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((c, a))
        new = np.append(True, (a[order][1:] != a[order][:-1]) | (c[order][1:] != c[order][:-1]))
        group = np.cumsum(new) - 1
        twice = np.zeros(len(a), bool)
        twice[order] = np.bincount(group)[group] > 1
        spare = order[~new]
        a = a.copy()
        a[spare] = _mixed(row[spare].view(np.uint64) * _ODD + pos[spare].view(np.uint64))
        return pa.record_batch([_signed(a), _signed(c), *(pa.array(x) for x in (row, first, last, pos, twice))], [*_NAMES, "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in batches:
            for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                for a, c, first, last, pos in anchors(raw, length):
                    held.append((a, c, np.full(len(a), row_id), first, last, pos))
                    n += len(a)
                if n >= HELD:
                    yield known(held)
                    held, n = [], 0
        if held:
            yield known(held)

    return docs.select("row_id", "text").mapInArrow(run, _OCCURRENCE + ", twice boolean")


def _in_batches(run):
    """Joins small record batches, so that few cross over to the JVM."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n >= 20_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return joined


def _sorted_out(occurrences: DataFrame) -> DataFrame:
    """Occurrences whose windows are all repeated (done), or that stay open; the rest go.

    Streams over the occurrences sorted by anchor and context. ``stands`` marks an open row that
    is itself done and only represents its class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None
        before = None  # (anchor, context) of the last row already given out, if its group may go on
        opened = None  # anchor that is known to have several contexts

        def sort_out(t: pa.RecordBatch, prior: tuple | None, upcoming: tuple | None) -> pa.RecordBatch:
            a, c = (t.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            new_a = np.append(prior is None or prior[0] != a[0], a[1:] != a[:-1])
            new_c = new_a.copy()
            new_c[1:] |= c[1:] != c[:-1]
            new_c[0] |= prior is not None and prior[1] != c[0]
            group_a, group_c = np.cumsum(new_a), np.cumsum(new_c)
            size = np.bincount(group_c, minlength=group_c[-1] + 1)
            twice = (size[group_c] > 1) | t.column(6).to_numpy(zero_copy_only=False)
            if prior is not None and not new_c[0]:
                twice |= group_c == group_c[0]
            contexts = np.bincount(group_a[new_c], minlength=group_a[-1] + 1)
            several = contexts[group_a] > 1
            if prior is not None and not new_a[0]:
                several |= (group_a == group_a[0]) & (new_c[0] | (contexts[group_a[0]] > 0) | (opened == a[0]))
            if upcoming is not None and upcoming[0] == a[-1]:
                several |= group_a == group_a[-1]
                if upcoming[1] == c[-1]:
                    twice |= group_c == group_c[-1]
            is_open = several & (new_c | ~twice)
            keep = np.flatnonzero(twice | is_open)
            found = t.take(pa.array(keep))
            return pa.record_batch([*found.columns[:6], pa.array(twice[keep]), pa.array(is_open[keep])], [*_NAMES, "done", "open"])

        for batch in batches:
            t = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            if t.num_rows < 2:
                rest = t
                continue
            a, c = (t.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            # give out all but the last context group, or, if it fills the batch, all but its last row
            cut = int(np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])))[-1]) or t.num_rows - 1
            head = t.slice(0, cut)
            yield sort_out(head, before, (int(a[cut]), int(c[cut])))
            several = before is not None and before[0] == a[cut - 1] and (opened == before[0] or before[1] != c[cut - 1])
            same = np.flatnonzero(a[:cut] == a[cut - 1])
            several |= bool((c[same] != c[cut - 1]).any())
            opened = int(a[cut - 1]) if several else (opened if opened == a[cut - 1] else None)
            before, rest = (int(a[cut - 1]), int(c[cut - 1])), t.slice(cut)
        if rest is not None and rest.num_rows:
            yield sort_out(rest, before, None)

    dealt = occurrences.repartition("anchor").sortWithinPartitions("anchor", "context")
    return dealt.mapInArrow(run, _OCCURRENCE + ", done boolean, open boolean")


def _windows(contexts: DataFrame, docs: DataFrame, length: int, group_limit: int) -> DataFrame:
    """(row_id, first, last): repeated windows among open contexts."""
    crowded = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_limit).select("anchor", F.lit(True).alias("crowded"))
    rows = contexts.join(crowded, "anchor", "left").select("row_id", F.struct("anchor", "first", "last", "pos", F.coalesce("crowded", F.lit(False)).alias("crowded"), "done").alias("c"))
    by_doc = rows.groupBy("row_id").agg(F.collect_list("c").alias("contexts"))  # at most one for 85 bytes of its text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        for batch in batches:
            for row_id, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                raw, out = text.as_py().encode(), []
                for c in found:
                    a, b = c["first"], c["last"]
                    if not c["crowded"]:
                        out.append((c["anchor"], raw[a : b + length], row_id, a, c["pos"] - a, c["done"]))
                    else:
                        h, p = Hashes(np.frombuffer(raw[a : b + length], np.uint8)), np.arange(b - a + 1)
                        keys = (h.of(p, p + length) ^ _mixed((c["pos"] - a - p).astype(np.uint64)) ^ np.uint64(c["anchor"] & (2**64 - 1))).view(np.int64)
                        out.extend((k, raw[a + q : a + q + length], row_id, a + q, c["pos"] - a - q, c["done"]) for q, k in enumerate(keys.tolist()))
                if out:
                    yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["key", "bytes", "row_id", "first", "offset", "done"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None

        def groups(t: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            raws, ids, firsts, offsets = (t.column(k).to_pylist() for k in (1, 2, 3, 4))
            done = t.column(5).to_numpy(zero_copy_only=False)
            key = t.column(0).to_numpy(zero_copy_only=False)
            for part in np.split(np.arange(len(key)), np.flatnonzero(key[1:] != key[:-1]) + 1):
                if len(part) < 2:
                    continue
                hs, own, at = [], [], []
                for k in part.tolist():
                    n = len(raws[k]) - length + 1
                    p = np.arange(n)
                    hs.append(Hashes(np.frombuffer(raws[k], np.uint8)).of(p, p + length) ^ _mixed((offsets[k] - p).astype(np.uint64)))
                    own.append(np.full(n, k))
                    at.append(p)
                h, own, at = np.concatenate(hs), np.concatenate(own), np.concatenate(at)
                _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
                hit = (count[inverse] > 1) & ~done[own]
                own, at = own[hit], at[hit]
                if len(own):
                    new = np.append(True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1))
                    i, j = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(own)) - 1
                    base = np.array([firsts[k] for k in own[i].tolist()])
                    yield pa.record_batch([pa.array([ids[k] for k in own[i].tolist()]), pa.array(base + at[i]), pa.array(base + at[j])], ["row_id", "first", "last"])

        for batch in batches:
            t = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            if not t.num_rows:
                continue
            key = t.column(0).to_numpy(zero_copy_only=False)
            last = int(np.searchsorted(key, key[-1]))
            yield from groups(t.slice(0, last))
            rest = t.slice(last)
        if rest is not None:
            yield from groups(rest)

    cuts = docs.join(by_doc, "row_id").select("row_id", "text", "contexts").mapInArrow(_in_batches(cut), "key long, bytes binary, row_id long, first long, offset long, done boolean")
    return cuts.repartition("key").sortWithinPartitions("key").mapInArrow(_in_batches(compare), "row_id long, first long, last long")


def numbered(docs: DataFrame) -> DataFrame:
    """(row_id, doc_id, text): doc_id as row_id where it tells all rows apart; else a stored copy with numbers."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    twice = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if twice.isEmpty():
        return rows.select(F.col("doc_id").alias("row_id"), "doc_id", "text")
    return stored(rows.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text"))


def remove(docs: DataFrame, length: int = LENGTH, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept) of every row; spans: removed byte ranges."""
    rows = numbered(docs)
    found = stored(_sorted_out(_occurrences(rows, length)))
    done = found.where("done").select("row_id", "first", "last")
    opened = found.where("open").select("anchor", "row_id", "first", "last", "pos", "done")
    windows = done.unionByName(_windows(opened, rows, length, group_limit))
    ranges = windows.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("windows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                raw, spans = text.as_py().encode(), []
                for w in found or ():
                    if spans and w["first"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], w["last"] + length)
                    else:
                        spans.append([w["first"], w["last"] + length])
                edges = [0, *(x for s in spans for x in s), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((doc_id, len(raw), len(raw) - len(kept), len(spans), spans, kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary())
            if out:
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    joined = rows.join(ranges, "row_id", "left").select("doc_id", "text", "windows")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<array<bigint>>, kept binary")


def query(docs: DataFrame) -> DataFrame:
    return remove(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """What ``remove`` must give, by looking at every string."""
    seen: dict[bytes, int] = {}
    raws = [(t or "").encode() for t in texts]
    for raw in raws:
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]] = seen.get(raw[i : i + length], 0) + 1
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out
