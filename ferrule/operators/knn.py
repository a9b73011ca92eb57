"""Exact nearest vectors by cosine, with cells that are left out.

Items are dealt to the nearest of up to ``MOST_CELLS`` centres, which are items
themselves, chosen by a hash of their ids. On unit vectors cosine and distance
order alike, so the triangle inequality bounds what a cell can hold for a query:
no item of a block lies nearer than the query's distance to the centre less the
block's outer radius, or its inner radius less that distance.

A query first visits its nearest cells until these hold k items. The k-th best of
them is pushed down as a threshold, and of the other cells only those are
visited whose bound allows a better one. A visit is a matrix product of a block
of items with a block of queries that visit its cell; only k rows of it go on for
each query. A cell with many items is several blocks, by radius, so none is held
whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.sources.shared import stored

MOST_CELLS = 1024
#: Vectors of a block, on average.
BLOCK = 1024
#: Cosines are rounded to four places.
SLACK = 1.01e-4
#: The cell of vectors without a direction, whose cosine is 0 to all; every query visits it.
NOWHERE = -1


def _rows(column: pa.Array) -> np.ndarray:
    """A matrix of unit vectors; zero vectors stay zero."""
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm > 0, norm, 1.0)


def _list(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def _far(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosine))


class Cells:
    """Items dealt out: ``blocks`` (cell, ids, values, inner, outer), stored, and the matrix of centres."""

    def __init__(self, items: DataFrame, most: int = MOST_CELLS, size: int = BLOCK) -> None:
        """``items``: (item_id, vector), vectors of one length without nulls."""
        rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.transform("vector", lambda x: x.cast("double")).alias("vector"))
        self.n = rows.count()
        n_cells = min(most, max(1, math.isqrt(self.n)))
        picked = rows.orderBy(F.xxhash64("item_id"), "item_id").limit(n_cells).select("vector").toArrow()  # MOST_CELLS rows
        centres = _rows(picked.column(0).combine_chunks()) if picked.num_rows else np.zeros((1, 1))
        centres = np.unique(np.round(centres, 12), axis=0)
        centres = centres[(centres != 0).any(axis=1)]
        self.centres = centres / np.sqrt((centres * centres).sum(axis=1, keepdims=True)) if len(centres) else centres
        held = self.held = rows.sparkSession.sparkContext.broadcast(self.centres)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                m = _rows(batch.column(1))
                cell, far = np.full(len(m), NOWHERE), np.zeros(len(m))
                if len(held.value):
                    cosine = m @ held.value.T
                    whole = (m != 0).any(axis=1)
                    cell = np.where(whole, cosine.argmax(axis=1), NOWHERE)
                    far = np.where(whole, _far(cosine.max(axis=1)), 0.0)
                yield pa.record_batch([batch.column(0), pa.array(cell), pa.array(far), _list(m)], ["item_id", "cell", "far", "v"])

        dealt = stored(rows.mapInArrow(deal, "item_id long, cell long, far double, v array<double>"))
        sizes = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("least"), F.max("far").alias("most"))
        # rings of like radius, and within these by a hash, so that equal vectors are dealt out too
        rings = F.ceil(F.sqrt(F.col("n") / size))
        ring = F.floor((F.col("far") - F.col("least")) / F.greatest(F.col("most") - F.col("least"), F.lit(1e-9)) * rings)
        part = F.pmod(F.xxhash64("item_id"), F.ceil(F.col("n") / size / rings).cast("long"))
        placed = dealt.join(F.broadcast(sizes), "cell").withColumn("ring", F.least(ring, rings - 1)).withColumn("part", part)  # MOST_CELLS rows
        blocks = placed.groupBy("cell", "ring", "part").agg(F.collect_list(F.struct("item_id", "v")).alias("rows"), F.min("far").alias("inner"), F.max("far").alias("outer"))
        self.blocks = stored(blocks.select("cell", "inner", "outer", F.col("rows.item_id").alias("ids"), F.flatten("rows.v").alias("values")))
        self.sizes = stored(self.blocks.groupBy("cell").agg(F.sum(F.size("ids")).alias("n"), F.min("inner").alias("inner"), F.max("outer").alias("outer")))

    def distances(self, queries: DataFrame) -> DataFrame:
        """(query_id, q, cell, far): every query (query_id, vector) and its distance to every centre, as one row of lists."""
        held = self.held

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                m = _rows(batch.column(1))
                # a query without a direction is as far from all: no bound leaves a cell out for it
                far = np.where((m != 0).any(axis=1)[:, None], _far(m @ held.value.T), np.nan) if len(held.value) else np.zeros((len(m), 0))
                yield pa.record_batch([batch.column(0), _list(m), _list(far)], ["query_id", "q", "far"])

        rows = queries.select(F.col("query_id").cast("long").alias("query_id"), F.transform("vector", lambda x: x.cast("double")).alias("vector"))
        return stored(rows.mapInArrow(measure, "query_id long, q array<double>, far array<double>"))

    def visits(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """(query_id, q, cell) of the first visits and what they find; queries as ``distances`` gives them."""
        each = queries.select("query_id", F.posexplode("far").alias("cell", "far")).join(F.broadcast(self.sizes.select("cell", "n")), "cell")
        order = Window.partitionBy("query_id").orderBy(F.asc_nulls_first("far"), "cell").rowsBetween(Window.unboundedPreceding, -1)
        near = each.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("before") < k).select("query_id", "cell")
        always = queries.select("query_id").join(F.broadcast(self.sizes.where(F.col("cell") == NOWHERE).select("cell")))  # one row or none
        return near.unionByName(always), each

    def found(self, queries: DataFrame, pairs: DataFrame, k: int, size: int = BLOCK) -> DataFrame:
        """(query_id, item_id, cosine): k rows of each block for each pair (query_id, cell, least)."""
        asked = pairs.join(queries.select("query_id", "q"), "query_id")
        n = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias("parts"))
        asked = asked.join(F.broadcast(n), "cell").groupBy("cell", F.pmod(F.xxhash64("query_id"), F.col("parts")).alias("part"))
        asked = asked.agg(F.collect_list(F.struct("query_id", "least", "q")).alias("rows"))
        asked = asked.select("cell", F.col("rows.query_id").alias("qids"), F.col("rows.least").alias("leasts"), F.flatten("rows.q").alias("qs"))
        both = self.blocks.join(asked, "cell").select("ids", "values", "qids", "leasts", "qs")

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, values, qids, leasts, qs = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in range(5))
                    cosine = np.round(qs.reshape(len(qids), -1) @ values.reshape(len(ids), -1).T, 4) + 0.0
                    keep = min(k, len(ids))
                    order = np.lexsort((np.broadcast_to(ids, cosine.shape), -cosine), axis=1)[:, :keep]
                    best = np.take_along_axis(cosine, order, 1)
                    row, col = np.nonzero(best >= leasts[:, None])
                    yield pa.record_batch([pa.array(qids[row]), pa.array(ids[order[row, col]]), pa.array(best[row, col])], ["query_id", "item_id", "cosine"])

        return both.mapInArrow(multiply, "query_id long, item_id long, cosine double")


def nearest(items: DataFrame, queries: DataFrame, k: int, most: int = MOST_CELLS, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(query_id, item_id, cosine, rank) of the k nearest items (item_id, vector) of each query (query_id, vector), ties by item_id; and (query_id, cells, visited)."""
    cells = Cells(items, most, size)
    asked = cells.distances(queries)
    first, each = cells.visits(asked, k)
    first = stored(first)
    low = F.lit(-2.0)
    near = stored(cells.found(asked, first.withColumn("least", low), k, size))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "item_id"))
    kth = near.withColumn("rank", place).where(F.col("rank") == k).select("query_id", (F.col("cosine") - SLACK).alias("least"))
    rest = each.join(first, ["query_id", "cell"], "left_anti").join(F.broadcast(cells.sizes.select("cell", "inner", "outer")), "cell").join(kth, "query_id", "left")
    bound = F.greatest(F.lit(0.0), F.col("far") - F.col("outer"), F.col("inner") - F.col("far"))
    can = F.col("least").isNull() | F.isnan("far") | (1 - bound * bound / 2 >= F.col("least"))
    rest = stored(rest.where(can).select("query_id", "cell", F.coalesce("least", low).alias("least")))
    both = near.unionByName(cells.found(asked, rest, k, size))
    report = first.select("query_id").unionByName(rest.select("query_id")).groupBy("query_id").agg(F.count(F.lit(1)).alias("visited"))
    report = report.crossJoin(F.broadcast(cells.sizes.agg(F.count(F.lit(1)).alias("cells"))))  # one row
    return both.withColumn("rank", place).where(F.col("rank") <= k), report.select("query_id", "cells", "visited")
