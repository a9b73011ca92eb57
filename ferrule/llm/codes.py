"""Product codes of vectors, by dictionaries of the values of each dimension.

Components become integers, floor(256 x). A vector is cut into ``PARTS`` equal
parts, and each part is replaced by the number of the nearest entry in the
codebook of its position. Codebooks start as the parts of the first vectors and
are refined by rounds of assigning and averaging.

The distinct integers of each dimension are few, whatever the number of
vectors: Spark collects them once into a dictionary, and vectors are stored as
dictionary codes. For a round, every dictionary value is tabulated against all
entries of its part: (value - entry)^2. The distances of a part to its entries
are then sums of table rows, gathered by code; no component is multiplied
again. Dictionaries travel while they have at most ``MOST_VALUES`` values in
all; where a table has more, each block of rows makes its own in its task, with
the same results.

A round gives sums and counts by part and entry, added up within tasks and then
by Spark; the driver sees one row for each entry, 1,024 in all. Errors of equal
labels are added up by a grouping with map-side sums, and the table of labels is
joined back, a hot label split by Spark if it is not broadcast.

Edge cases: vectors that are null or hold a null or non-finite component are
dropped, and so are those whose length is not that of the first vector (by
vec_id) of a length that the parts divide; null vec_ids come last, equal ones
in the order of their integers; with fewer vectors than entries the codebooks
are smaller; an entry that nothing is assigned to stays; ties go to the lower
index; components beyond 2**25 steps either way count as the limit; null labels
are one label; repeated rows count each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import kept, stored

STEP, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Distinct values of all dimensions that may be broadcast: 64 MB of tables in a worker.
MOST_VALUES = 1 << 17
#: Vectors assigned at a time.
BLOCK = 4096
_LIMIT = 1 << 25


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, label) of the vectors that can be coded; ``v`` are integers."""
    whole = F.expr("embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    steps = F.expr(f"transform(embedding, x -> CAST(greatest({-_LIMIT}D, least({_LIMIT}D, floor({STEP}D * CAST(x AS DOUBLE)))) AS BIGINT))")
    rows = vectors.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), steps.alias("v"), "label").where(F.size("v") % PARTS == 0)
    length = rows.agg(F.min_by(F.size("v"), F.struct(F.col("vec_id").isNull(), "vec_id", "v")).alias("n")).first()["n"]
    return rows.where(F.size("v") == (length or 0))


def first_codebooks(rows: DataFrame, entries: int = ENTRIES) -> np.ndarray:
    """(part, entry, place): the parts of the first vectors."""
    first = rows.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()  # entries rows
    if not first:
        return np.zeros((PARTS, 0, 0), np.int64)
    return np.array([r["v"] for r in first], np.int64).reshape(len(first), PARTS, -1).transpose(1, 0, 2)


def dictionaries(rows: DataFrame, most: int = MOST_VALUES) -> list[np.ndarray] | None:
    """The sorted distinct integers of each dimension; None if there are too many to broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(0))
            for k in range(m.shape[1]):
                values = np.unique(m[:, k])
                yield pa.record_batch([pa.array(np.full(len(values), k)), pa.array(values)], ["dim", "value"])

    found = stored(rows.select("v").mapInArrow(run, "dim long, value long").distinct())
    if found.count() > most:
        return None
    table = found.toArrow()
    dim, value = (table.column(c).to_numpy() for c in range(2))
    return [np.sort(value[dim == k]) for k in range(int(dim.max()) + 1)] if len(dim) else []


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class _Book:
    """Codebooks with the tables of one set of dictionaries."""

    def __init__(self, codebooks: np.ndarray, values: list[np.ndarray]) -> None:
        place = codebooks.shape[2]
        self.place = place
        self.tables = [(values[d][:, None] - codebooks[d // place, :, d % place][None, :]) ** 2 for d in range(len(values))]

    def nearest(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every part of rows of dictionary codes."""
        n, parts = len(codes), codes.shape[1] // self.place
        entry, error = np.empty((n, parts), np.int64), np.empty((n, parts), np.int64)
        for at in range(0, n, BLOCK):
            rows = slice(at, at + BLOCK)
            for p in range(parts):
                far = self.tables[p * self.place][codes[rows, p * self.place]]
                for d in range(p * self.place + 1, (p + 1) * self.place):
                    far = far + self.tables[d][codes[rows, d]]
                entry[rows, p] = far.argmin(axis=1)  # the first of equal ones
                error[rows, p] = np.take_along_axis(far, entry[rows, p, None], 1)[:, 0]
        return entry, error


def _coded(m: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(values[d], m[:, d]) for d in range(m.shape[1])], axis=1)


def encoded(rows: DataFrame, values) -> DataFrame:
    """``rows`` (vec_id, v, label) with dictionary codes for their integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _coded(_matrix(batch.column(1)), values.value).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1]), pa.array(codes.ravel()))
            yield pa.record_batch([batch.column(0), listed, batch.column(2)], ["vec_id", "v", "label"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "v", "label").mapInArrow(run, f"vec_id long, v array<int>, label {kind}")


class Coder:
    """Assigns parts to entries; ``rows`` hold dictionary codes, or integers if there are no dictionaries."""

    def __init__(self, spark, values: list[np.ndarray] | None) -> None:
        self.sc, self.values = spark.sparkContext, values
        self.held = self.sc.broadcast(values)

    def _blocks(self, codebooks: np.ndarray):
        """Function of a list column: (integers, entry, error)."""
        held, book = self.held, self.sc.broadcast(codebooks)

        def run(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            m = _matrix(column)
            if held.value is not None:
                key = ("codes", hashlib.sha256(book.value.tobytes()).digest())
                entry, error = kept(key, lambda: _Book(book.value, held.value)).nearest(m)
                return np.stack([held.value[d][m[:, d]] for d in range(m.shape[1])], axis=1), entry, error
            values = [np.unique(m[:, d]) for d in range(m.shape[1])]
            entry, error = _Book(book.value, values).nearest(_coded(m, values))
            return m, entry, error

        return run

    def refined(self, rows: DataFrame, codebooks: np.ndarray) -> np.ndarray:
        """The codebooks after one round."""
        assign, (parts, entries, place) = self._blocks(codebooks), codebooks.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((parts, entries, place), np.int64), np.zeros((parts, entries), np.int64)
            for batch in batches:
                if not len(batch.column(0)):
                    continue
                m, entry, _ = assign(batch.column(0))
                for p in range(parts):
                    np.add.at(total[p], entry[:, p], m[:, p * place : (p + 1) * place])
                    count[p] += np.bincount(entry[:, p], minlength=entries)
            p, e = np.nonzero(count)
            sums = total[p, e].reshape(len(p), place)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * place), pa.array(sums.ravel()))
            yield pa.record_batch([pa.array(p), pa.array(e), pa.array(count[p, e]), listed], ["part", "entry", "n", "sums"])

        found = rows.select("v").mapInArrow(run, "part long, entry long, n long, sums array<long>")
        found = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(place)))
        out = codebooks.copy()
        for r in found.collect():  # one row for each entry of each part
            out[r["part"], r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(place)]
        return out

    def coded(self, rows: DataFrame, codebooks: np.ndarray) -> DataFrame:
        """(vec_id, code, error, label)."""
        assign = self._blocks(codebooks)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch.column(0)):
                    continue
                _, entry, error = assign(batch.column(1))
                code = [bytes(row).hex() for row in entry.astype(np.uint8)]
                yield pa.record_batch([batch.column(0), pa.array(code, pa.string()), pa.array(error.sum(axis=1)), batch.column(2)], ["vec_id", "code", "error", "label"])

        kind = rows.schema["label"].dataType.simpleString()
        return rows.select("vec_id", "v", "label").mapInArrow(run, f"vec_id long, code string, error long, label {kind}")


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, most: int = MOST_VALUES) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, code, error, label) of all vectors that can be coded, and the codebooks (part, entry, place)."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry is one byte: 1 to 256 of them")
    rows = stored(integers(vectors))
    codebooks = first_codebooks(rows, entries)
    if not codebooks.size:
        kind = rows.schema["label"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id long, code string, error long, label {kind}"), codebooks
    values = dictionaries(rows, most)
    coder = Coder(vectors.sparkSession, values)
    if values is not None:
        rows = stored(encoded(rows, coder.held))
    for _ in range(rounds):
        codebooks = coder.refined(rows, codebooks)
    return stored(coder.coded(rows, codebooks)), codebooks


def decode(code: str, codebooks: np.ndarray) -> np.ndarray:
    """The integers that a code stands for."""
    return np.concatenate([codebooks[p, int(code[2 * p : 2 * p + 2], 16)] for p in range(len(codebooks))])


def query(vectors: DataFrame) -> DataFrame:
    rows, codebooks = compress(vectors)
    digest = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    by_label = stored(rows.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "_label")
    found = rows.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


ORACLE = """
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, v[1 + part * len(v) // 16:(part + 1) * len(v) // 16] AS x FROM k, range(16) r(part)),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 64)),
"""
for _n in range(ROUNDS + 1):
    ORACLE += f"""d{_n} AS (SELECT p.part, vec_id, x, entry, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS far FROM p JOIN b{_n} b ON b.part = p.part),
a{_n} AS MATERIALIZED (SELECT part, vec_id, any_value(x) AS x, min(entry) FILTER (far = least_far) AS entry, any_value(least_far) AS far FROM (SELECT *, min(far) OVER (PARTITION BY part, vec_id) AS least_far FROM d{_n}) GROUP BY part, vec_id),
"""
    if _n < ROUNDS:
        ORACLE += f"""m{_n} AS (SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY place) AS c FROM (SELECT part, entry, place, sum(y)::DOUBLE AS s, count(*) AS n FROM (SELECT part, entry, unnest(x) AS y, unnest(range(len(x))) AS place FROM a{_n}) GROUP BY ALL) GROUP BY part, entry),
b{_n + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{_n} b LEFT JOIN m{_n} m ON m.part = b.part AND m.entry = b.entry),
"""
ORACLE += f"""s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS}),
e AS (SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT e.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN k USING (vec_id), s"""
