"""Best-fit packing into bins of several permitted lengths.

Documents longer than the largest permitted length are cut; the pieces are
dealt to shards by a hash, about ``SHARD`` documents each, and every shard is
packed on its own, so no task grows with the corpus. Within a shard, pieces go
in order of decreasing length to the open bin that they fill best. If none has
room, a bin opens. Every permitted length is tried for it: what is left of the
shard's pieces, from the largest down, shows how full a bin of that length would
get, and the one that costs least for each unit so held opens. So the mix of
pieces decides between the lengths. At the end, every bin shrinks to the least
permitted length that holds its contents.

A bin of length c costs ``c + c * c / QUADRATIC + OVERHEAD``: its positions,
attention over them, and what each sequence costs besides.

Edge cases: empty and null texts have length 0 and get no row; repeated rows
and rows without a doc_id are packed each on their own; ties go by doc_id and
piece; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Permitted sequence lengths, in the unit of the length column (bytes of UTF-8 unless given otherwise).
CAPACITIES = (1024, 2048, 4096, 8192)
OVERHEAD, QUADRATIC = 64, 65536
#: Pieces of a shard, on average.
SHARD = 4096

SCHEMA = "bin_id long, capacity long, used long, bin_start long, doc_id long, piece long, piece_start long, length long"


def cost(capacity: int) -> float:
    return capacity + capacity * capacity / QUADRATIC + OVERHEAD


def _filled(room: int, left: list[int], sizes: int) -> int:
    """How much of ``room`` the pieces left fill, taken from the largest that fits down; bit n of ``sizes``: some have length n."""
    held, room0 = 0, room
    taken: dict[int, int] = {}
    while room > 0 and (fit := sizes & ((1 << (room + 1)) - 1)):
        size = fit.bit_length() - 1
        n = min(left[size] - taken.get(size, 0), room // size)
        if n <= 0:  # all of this length are taken
            sizes &= ~(1 << size)
            continue
        taken[size] = taken.get(size, 0) + n
        held += n * size
        room -= n * size
        if taken[size] == left[size]:
            sizes &= ~(1 << size)
    return min(held, room0)


def assign(lengths: list[int], capacities: tuple[int, ...]) -> tuple[list[int], list[int]]:
    """Bin number of each length (in decreasing order), and the final capacity of each bin."""
    capacities = tuple(sorted(capacities))
    left, sizes = [0] * (capacities[-1] + 1), 0
    for size in lengths:
        left[size] += 1
        sizes |= 1 << size
    room: list[list[int]] = [[] for _ in range(capacities[-1] + 1)]
    have = 0  # bit r is set if some open bin has room r
    of, used = [], []
    for size in lengths:
        left[size] -= 1
        if not left[size]:
            sizes &= ~(1 << size)
        fitting = have >> size << size
        if fitting:
            r = (fitting & -fitting).bit_length() - 1
            number = room[r].pop()
            if not room[r]:
                have ^= 1 << r
        else:
            r = min((c for c in capacities if c >= size), key=lambda c: (cost(c) / (size + _filled(c - size, left, sizes)), c))
            number = len(used)
            used.append(0)
        of.append(number)
        used[number] += size
        if r > size:
            if not room[r - size]:
                have |= 1 << (r - size)
            room[r - size].append(number)
    return of, [min(c for c in capacities if c >= u) for u in used]


def _pack(capacities: tuple[int, ...]) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = t["length"].to_pylist()
        of, final = assign(lengths, capacities)
        used, start = [0] * len(final), []
        for number, size in zip(of, lengths):
            start.append(used[number])
            used[number] += size
        shard = t["shard"][0].as_py() << 32
        made = {
            "bin_id": [shard + k for k in of], "capacity": [final[k] for k in of], "used": [used[k] for k in of], "bin_start": start,
            "doc_id": t["doc_id"], "piece": t["piece"], "piece_start": t["piece_start"], "length": t["length"],
        }
        return pa.table({k: v if isinstance(v, pa.ChunkedArray) else pa.array(v, pa.int64()) for k, v in made.items()})

    return run


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, length: Column | None = None, shard: int = SHARD) -> DataFrame:
    """One row per piece: its bin, the bin's final capacity, and where the piece stands in it.

    Shards have about as many pieces each, however long the documents are. Equal rows are dealt to shards one by one.
    """
    size = F.octet_length(F.coalesce("text", F.lit(""))) if length is None else length
    most = max(capacities)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.cast("long").alias("size"), F.monotonically_increasing_id().alias("row")).where("size > 0")
    n = rows.agg(F.sum(F.ceil(F.col("size") / most)).alias("n")).first()["n"] or 0
    shards = max(1, -(-n // shard))
    starts = rows.select("doc_id", "size", "row", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(most).cast("long"))).alias("piece", "piece_start"))
    pieces = starts.select(
        "doc_id", F.col("piece").cast("long").alias("piece"), "piece_start", F.least(F.lit(most), F.col("size") - F.col("piece_start")).cast("long").alias("length"),
        F.pmod(F.xxhash64("doc_id", "piece", "size", "row"), F.lit(shards)).alias("shard"),
    )
    return pieces.groupBy("shard").applyInArrow(_pack(tuple(capacities)), SCHEMA)


def fill(bins: DataFrame) -> DataFrame:
    """One row on a packing: bins, units used, padded share, and the padded share that bins of the largest capacity alone would have at best."""
    each = bins.groupBy("bin_id").agg(F.first("capacity").alias("capacity"), F.first("used").alias("used"))
    whole = each.agg(F.count(F.lit(1)).alias("bins"), F.coalesce(F.sum("used"), F.lit(0)).alias("used"), F.coalesce(F.sum("capacity"), F.lit(0)).alias("held"), F.max("capacity").alias("most"))
    least = F.ceil(F.col("used") / F.col("most")) * F.col("most")
    return whole.select("bins", "used", "held", F.round(1 - F.try_divide("used", "held"), 6).alias("padded"), F.round(1 - F.try_divide(F.col("used"), least), 6).alias("padded_at_best"))
