"""Toxicity by nearest labelled examples: exact TF-IDF cosine over whole texts.

Terms are all words of a text (runs of letters, lower-cased) and the words'
five-letter beginnings; none is dropped and their number has no cap. A term
weighs ``(1 + ln tf) * ln((1 + n) / (1 + df)) * relevance``, where relevance is
``FLOOR + (ratio / (ratio + SOFT)) ** 2`` with the term's log-likelihood ratio
with the label among the examples: terms that say nothing about the label fade
but stay. Vectors have length one, similarity is the cosine. The only bound is
``MAX_TRAIN``, the number of labelled rows that serve as examples. Terms that
no example has weigh nothing.

The examples lie in an inverted index: equal vectors form one class; classes
are numbered by the number of their terms, so that neighbours in a block of
``BLOCK`` have weights alike, and each term keeps its largest weight in each
block. A query adds up the postings of its heavy terms. The k-th best of these
sums is less than or equal to the k-th best similarity, and the block maxima
of the remaining terms bound what each block can still gain; classes that may
reach the k-th best are added up from their own vectors. So the neighbours are
exact. Examples at exactly the k-th similarity all vote.

A vote weighs the square of its cosine; ``PRIOR`` votes at the common rate
keep thin evidence from extreme shares. Shares become probabilities by an
isotonic regression on examples scored against the examples of the other
folds, with the term weights of those folds.

The model is bounded by its examples whatever the size of the tables, and
broadcast; scoring is a pass over the documents without a shuffle.

Edge cases: null and empty texts and texts without known terms have the share
of a prior without votes; without any labelled rows every score is 0; rows
without a doc_id are scored and not held out; repeated label rows of a document
count once, toxic if any says so; a label without a document is not used;
columns named score, predicted or evidence are replaced, others are kept.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.common import kept

#: Labelled rows that serve as examples, at most: those first in the order of a hash.
MAX_TRAIN = 4096
FOLDS = 3
#: Relevance of a term: FLOOR at least, half of the most at a ratio of about 2.4 times SOFT.
SOFT, FLOOR = 25.0, 0.01
BEGINNING = 5
NEIGHBOURS, PRIOR, BLOCK = 25, 1.0, 64
#: Share of the bound of all terms that the light ones may have together.
LIGHT = 0.05
THRESHOLD = 0.3
#: Rows that are filtered at a time.
ROWS = 1000

_WORD = regex.compile(r"\p{L}+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def terms(text: str | None) -> Counter:
    found = Counter(_WORD.findall((text or "").lower()))
    for word, n in list(found.items()):
        if len(word) >= BEGINNING:
            found[word[:BEGINNING] + "*"] += n
    return found


class Examples:
    """Counts of the terms of labelled rows, by row: ``ids`` and ``counts`` from ``starts[k]`` to ``starts[k + 1]``."""

    def __init__(self, doc_ids: list, labels: np.ndarray, folds: np.ndarray, names: list[str], starts: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.doc_ids, self.labels, self.folds, self.names = doc_ids, labels, folds, names
        self.starts, self.ids, self.counts = starts, ids.astype(np.int32), counts.astype(np.int32)

    def row(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.starts[k], self.starts[k + 1])
        return self.ids[part], self.counts[part]


def relevance(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Relevance of terms found in a of n1 toxic and b of n0 other examples."""
    if not n1 or not n0:
        return np.full(len(a), FLOOR)
    p = (a + b) / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):

        def part(k: np.ndarray, n: int) -> np.ndarray:
            return np.where(k > 0, k * np.log(k / (n * p)), 0.0) + np.where(k < n, (n - k) * np.log((n - k) / (n * (1 - p))), 0.0)

        ratio = np.where((p > 0) & (p < 1), 2 * (part(a, n1) + part(b, n0)), 0.0)
    ratio = np.maximum(np.nan_to_num(ratio), 0.0)
    return FLOOR + (ratio / (ratio + SOFT)) ** 2


class Index:
    """Inverted index over classes of equal example vectors, with the largest weight per block."""

    def __init__(self, examples: Examples, rows: np.ndarray) -> None:
        """``rows``: numbers of the examples that are to be in the index."""
        # a worker keeps the memory that this takes at its most: numbers are 32 bits wide, and what is used up goes at once
        e, rows = examples, np.asarray(rows, np.int64)
        labels = e.labels[rows]
        n, n1 = len(rows), int(labels.sum())
        self.rate = n1 / n if n else 0.0
        lengths = e.starts[rows + 1] - e.starts[rows]
        at = np.repeat((e.starts[rows] - (np.cumsum(lengths) - lengths)).astype(np.int32), lengths)
        at += np.arange(len(at), dtype=np.int32)
        ids, counts = e.ids[at], e.counts[at]
        del at
        df = np.bincount(ids, minlength=len(e.names)).astype(np.float64)
        toxic = np.bincount(ids, weights=np.repeat(labels.astype(np.float64), lengths), minlength=len(e.names))
        self.weight = np.where(df > 0, np.log((1 + n) / (1 + df)) * relevance(toxic, df - toxic, n1, n - n1), 0.0)
        classes: dict[bytes, list] = {}
        for k in range(n):
            i, c = e.row(int(rows[k]))
            known = classes.setdefault(hashlib.sha256(i.tobytes() + b"|" + c.tobytes()).digest(), [len(i), k, 0, 0, []])
            known[2] += 1
            known[3] += int(labels[k])
            if len(known[4]) < 3 and e.doc_ids[rows[k]] is not None:
                known[4].append(e.doc_ids[rows[k]])
        found = sorted((c for c in classes.values() if c[0]), key=lambda c: c[:2])
        self.size = np.array([c[2] for c in found], np.float64)
        self.toxic = np.array([c[3] for c in found], np.float64)
        self.evidence = [c[4] for c in found]
        number = np.full(n, -1, np.int32)
        number[[c[1] for c in found]] = np.arange(len(found), dtype=np.int32)
        owner = np.repeat(number, lengths)
        keep = owner >= 0
        ids, counts, owner = ids[keep], counts[keep], owner[keep]
        w = np.log(counts)
        del counts, keep
        w += 1
        w *= self.weight[ids]
        norm = np.sqrt(np.bincount(owner, weights=w * w, minlength=len(found)))
        w /= np.where(norm > 0, norm, 1.0)[owner]
        order = np.argsort(owner, kind="stable").astype(np.int32)
        self.row_starts = np.append(0, np.cumsum(np.bincount(owner, minlength=len(found))))
        self.row_ids, self.row_weights = ids[order], w[order]  # ids stay 32 bits wide
        del order
        order = np.lexsort((owner, ids)).astype(np.int32)
        self.starts = np.append(0, np.cumsum(np.bincount(ids, minlength=len(e.names))))
        self.at = owner[order]
        del owner
        self.postings = w[order]
        del w
        # the postings of a term within a block follow each other: the largest weight of each such run
        self.n_blocks = len(found) // BLOCK + 1
        run = ids[order].astype(np.int64)
        del ids, order
        run *= self.n_blocks
        run += self.at // BLOCK
        first = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(run) else np.zeros(0, np.int64)
        run = run[first]
        self.most = np.maximum.reduceat(self.postings, first) if len(first) else np.zeros(0)
        self.most_block = (run % self.n_blocks).astype(np.int32)
        self.most_starts = np.searchsorted(first, self.starts)
        self.top = np.zeros(len(e.names))
        np.maximum.at(self.top, run // self.n_blocks, self.most)
        self.block = np.arange(len(found)) // BLOCK

    def vector(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = self.weight[ids] * (1 + np.log(counts))
        ids, raw = ids[raw > 0], raw[raw > 0]
        norm = math.sqrt(float(raw @ raw))
        return ids, raw / norm if norm else raw

    def _gains(self, ids: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Of all blocks, what these terms can add to a similarity at most."""
        n = self.most_starts[ids + 1] - self.most_starts[ids]
        at = np.repeat(self.most_starts[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(self.most_block[at], weights=np.repeat(w, n) * self.most[at], minlength=self.n_blocks)

    def _sums(self, ids: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Of all classes, the part of the similarity that these terms make up."""
        n = self.starts[ids + 1] - self.starts[ids]
        at = np.repeat(self.starts[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(self.at[at], weights=np.repeat(w, n) * self.postings[at], minlength=len(self.size))

    def nearest(self, ids: np.ndarray, counts: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """Classes and cosines of the k nearest examples, and of all that tie with the last."""
        ids, w = self.vector(ids, counts)
        if not len(ids) or not len(self.size):
            return np.zeros(0, np.int64), np.zeros(0)
        bound = w * self.top[ids]
        order = np.argsort(-bound, kind="stable")
        ids, w, bound = ids[order], w[order], bound[order]
        left = bound.sum() - np.cumsum(bound)
        heavy = int(np.searchsorted(-left, -LIGHT * bound.sum())) + 1
        sums = self._sums(ids[:heavy], w[:heavy])
        if heavy < len(ids):
            best = np.argpartition(-sums, min(k, len(sums)) - 1)[:k]  # every class has one example or more
            least = sums[best].min() if len(best) >= k else 0.0
            gain = self._gains(ids[heavy:], w[heavy:])
            hit = np.flatnonzero(sums + gain[self.block] >= least - 1e-9)
            cost = int((self.row_starts[hit + 1] - self.row_starts[hit]).sum())
            if cost < int((self.starts[ids[heavy:] + 1] - self.starts[ids[heavy:]]).sum()):
                dense = np.zeros(len(self.weight))
                dense[ids] = w
                n = self.row_starts[hit + 1] - self.row_starts[hit]
                at = np.repeat(self.row_starts[hit] - (np.cumsum(n) - n), n) + np.arange(cost)
                score = np.add.reduceat(dense[self.row_ids[at]] * self.row_weights[at], np.cumsum(n) - n) if len(hit) else np.zeros(0)
            else:
                score = (sums + self._sums(ids[heavy:], w[heavy:]))[hit]
        else:
            hit, score = np.arange(len(sums)), sums
        score = np.round(score, 9)  # sums in another order are the same
        order = np.lexsort((hit, -score))[: int((score > 0).sum())]
        hit, score = hit[order], score[order]
        enough = int(np.searchsorted(np.cumsum(self.size[hit]), k))
        keep = score >= score[enough] if enough < len(hit) else slice(None)
        return hit[keep], score[keep]

    def share(self, ids: np.ndarray, counts: np.ndarray) -> tuple[float, list[int]]:
        """Share of toxic votes, and doc_ids of the nearest examples."""
        near, cosine = self.nearest(ids, counts)
        vote = cosine * cosine
        p = (float(vote @ self.toxic[near]) + PRIOR * self.rate) / (float(vote @ self.size[near]) + PRIOR)
        return p, [d for c in near[:3].tolist() for d in self.evidence[c]][:3]


def isotonic(shares: np.ndarray, labels: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps (share, probability) fitted to labels; each step holds one vote at the common rate besides."""
    order = np.argsort(shares, kind="stable")
    pools: list[list[float]] = []  # toxic, rows, sum of shares
    for x, y in zip(shares[order].tolist(), labels[order].tolist()):
        pools.append([y, 1.0, x])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top)]
    x = np.array([s / n for _, n, s in pools])
    p = np.array([(t + rate) / (n + 1) for t, n, _ in pools])
    return x, np.maximum.accumulate(p)


class Model:
    """The examples and what shares of votes mean. It travels without its index, which each process builds once."""

    def __init__(self, examples: Examples | None, shares: np.ndarray, labels: np.ndarray) -> None:
        self.examples, self.token = examples, uuid.uuid4().hex
        known = len(shares) and 0 < labels.sum() < len(labels)
        self.steps = isotonic(shares, labels, float(examples.labels.mean())) if known else None

    def _parts(self) -> tuple[Index, dict[str, int]]:
        e = self.examples
        return kept(("toxicity", self.token), lambda: (Index(e, np.arange(len(e.labels))), {t: i for i, t in enumerate(e.names)}))

    @property
    def index(self) -> Index:
        return self._parts()[0]

    @property
    def number(self) -> dict[str, int]:
        return self._parts()[1]

    def counted(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        get, found = self.number.get, {}
        for word, n in Counter(_WORD.findall((text or "").lower())).items():
            if (i := get(word)) is not None:
                found[i] = n
            if len(word) >= BEGINNING and (i := get(word[:BEGINNING] + "*")) is not None:
                found[i] = found.get(i, 0) + n
        return np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.float64, len(found))

    def score(self, text: str | None) -> tuple[float, list[int]]:
        if self.examples is None:
            return 0.0, []
        share, evidence = self.index.share(*self.counted(text))
        return (float(np.interp(share, *self.steps)) if self.steps is not None else share), evidence


def examples_of(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Examples | None:
    """The labelled rows that are not held out, at most ``max_train``, with the counts of all their terms."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    marks = marks.withColumn("fold", F.pmod(F.crc32(F.concat(F.lit("fold "), F.col("doc_id").cast("string"))), F.lit(FOLDS)).cast("int"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marks), "doc_id").select("doc_id", "toxic", "fold", "text")  # at most max_train marks

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(x.as_py()) for x in batch.column(3)]
            names, ns = pa.array([sorted(f) for f in found], pa.list_(pa.string())), pa.array([[f[t] for t in sorted(f)] for f in found], pa.list_(pa.int32()))
            yield pa.record_batch([*batch.columns[:3], names, ns], ["doc_id", "toxic", "fold", "terms", "ns"])

    table = rows.mapInArrow(count, "doc_id long, toxic int, fold int, terms array<string>, ns array<int>").toArrow()  # at most max_train documents
    if not table.num_rows:
        return None
    table = table.sort_by("doc_id").combine_chunks()
    names = table["terms"].combine_chunks()
    coded = names.flatten().dictionary_encode()
    starts = np.append(0, np.cumsum(names.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)))
    counts = table["ns"].combine_chunks().flatten().to_numpy().astype(np.float64)
    return Examples(table["doc_id"].to_pylist(), table["toxic"].to_numpy(), table["fold"].to_numpy(), coded.dictionary.to_pylist(), starts, coded.indices.to_numpy().astype(np.int64), counts)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """The model; learns from rows that are not held out."""
    examples = examples_of(docs, labels, max_train)
    if examples is None:
        return Model(None, np.zeros(0), np.zeros(0))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(examples)
    parts, token = 4, uuid.uuid4().hex

    def validate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = shared.value
        for task in (x for batch in batches for x in batch.column(0).to_pylist()):
            fold, part = task // parts, task % parts
            own = np.flatnonzero(e.folds == fold)[part::parts]
            others = np.flatnonzero(e.folds != fold)
            index = kept(("toxicity", token, fold), lambda: Index(e, others))
            shares = [index.share(*e.row(int(k)))[0] for k in own] if len(others) else []
            yield pa.record_batch([pa.array(own[: len(shares)]), pa.array(shares, pa.float64())], ["row", "share"])

    tasks = FOLDS * parts
    found = spark.range(0, tasks, 1, tasks).mapInArrow(validate, "row long, share double").toArrow().sort_by("row")  # one row an example
    model = Model(examples, found["share"].to_numpy(), examples.labels[found["row"].to_numpy()].astype(np.float64))
    shared.unpersist()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score, predicted and evidence (doc_ids of the nearest examples)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted", "evidence")
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.score(x.as_py()) for x in batch.column(at)]
            p = np.array([f[0] for f in found], np.float64)
            yield pa.record_batch(
                [*batch.columns, pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32)), pa.array([f[1] for f in found], pa.list_(pa.int64()))],
                [*names, "score", "predicted", "evidence"],
            )

    kinds = [*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.ArrayType(T.LongType()))]
    return docs.mapInArrow(run, T.StructType(kinds))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted toxic; all its columns, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                yield part.filter(pa.array([m.score(x.as_py())[0] < THRESHOLD for x in part.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return score(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")
