"""Spelling variants, found through Bloom filters of the vocabulary.

Words are counted over all texts; the frequent ones are the vocabulary. Two of
its words are near if they differ by exactly one inserted, deleted or replaced
character. Instead of pairing words, every word generates its neighbourhood:

* each word with one character less (a pair of lengths n and n - 1 is found
  from its longer word),
* each word with one character replaced by a later one of the characters that
  the vocabulary has (a pair of one length is found from its lesser word).

A generated edit is not a string but a hash, made from that of the word in a
few operations. It is looked up in a blocked Bloom filter of the words of its
length: all its bits are in one block of 512. Only edits whose bits are all set
become strings and are shuffled to the exact join with the vocabulary, which
removes the false ones, some in a thousand.

The filters are built by a grouping with bitwise or. They are broadcast in
passes of ``PASS_BLOCKS`` blocks at most, 16 MB, over which the lengths, and
the blocks of a large length, are dealt out: a vocabulary of up to four million
words takes one or two passes, a larger one more of them. A pass goes only over
the words that have edits of its lengths.

A word's form is its near word of largest count if that is at least ``RATIO``
times its own. Forms grow at each step, so that following them ends; roots are
found by doubling the steps. No link depends on a group: a word has at most as
many near words as edits, and groupings keep a maximum and a count.

Edge cases: null text has no words; a row without a doc_id is hashed with an
empty id; repeated rows count each; ties of count go to the first word in
code-point order; an empty table gives no rows; other columns are ignored; runs
of any length are words, and cost time in proportion to their length squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import stored

LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: One in so many occurrences loses a character.
NOISE = 97
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a filter for each word, bits that a word sets, 64-bit slots of a block.
BITS, PROBES, SLOTS = 16, 6, 8
#: Blocks broadcast at a time.
PASS_BLOCKS = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def occurrences(docs: DataFrame) -> DataFrame:
    """(word, n): words of at least ``LEAST_LENGTH`` characters; one in ``NOISE`` occurrences lost a character."""
    # shorter runs stay too short whatever they lose
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(rf"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = "CAST(h % length(run) AS INT)"
    word = F.when(F.col("h") % NOISE == 0, F.expr(f"concat(left(run, {at}), substr(run, {at} + 2))")).otherwise(F.col("run"))
    return rows.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _letter(codes: np.ndarray) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BASE, np.uint64))])


def _matrix(words: list[str], length: int) -> np.ndarray:
    return np.array(words, dtype=f"U{length}").view(np.uint32).reshape(len(words), length)


def _strings(codes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(codes).view(f"U{codes.shape[1]}").ravel()


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _block(x: np.ndarray, blocks: int) -> np.ndarray:
    return ((x >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def _bit(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th of the places in its block, below 512, that a spread hash sets."""
    return ((x * np.uint64(2 * k + 3)) >> np.uint64(20)).astype(np.int64) & 511


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, positions of the words that have it)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        yield length, np.flatnonzero(lengths == length)


def filters(vocabulary: DataFrame, blocks: dict[int, int]) -> DataFrame:
    """(length, block, slot, bits): the slots of all filters that are not zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            for length, at in by_length(words):
                x = _spread((_letter(_matrix([words[i] for i in at], length)) * _powers(length)[:length]).sum(axis=1, dtype=np.uint64))
                block = _block(x, blocks[length])
                for k in range(PROBES):
                    bit = _bit(x, k)
                    one = (np.uint64(1) << (bit & 63).astype(np.uint64)).view(np.int64)
                    yield pa.record_batch([pa.array(np.full(len(at), length)), pa.array(block), pa.array(bit >> 6), pa.array(one)], ["length", "block", "slot", "bits"])

    rows = vocabulary.select("word").mapInArrow(run, "length long, block long, slot long, bits long")
    return rows.groupBy("length", "block", "slot").agg(F.bit_or("bits").alias("bits"))


def passes(blocks: dict[int, int], most: int = PASS_BLOCKS) -> list[list[tuple[int, int, int]]]:
    """(length, first block, end) dealt out so that no pass has more than ``most`` blocks."""
    out, room = [], 0
    for length, n in sorted(blocks.items()):
        at = 0
        while at < n:
            if room == 0:
                out.append([])
                room = most
            end = min(n, at + room)
            out[-1].append((length, at, end))
            room -= end - at
            at = end
    return out


class _Filter:
    """What one pass knows of the words of a length."""

    def __init__(self, blocks: int, first: int, end: int, slots: np.ndarray) -> None:
        self.blocks, self.first, self.end, self.slots = blocks, first, end, slots

    def has(self, h: np.ndarray) -> np.ndarray:
        """Positions of the hashes that may be those of words."""
        x = _spread(h)
        block = _block(x, self.blocks)
        at = np.arange(len(x)) if self.end - self.first == self.blocks else np.flatnonzero((block >= self.first) & (block < self.end))
        for k in range(PROBES):
            bit = _bit(x[at], k)
            found = self.slots[(block[at] - self.first) * SLOTS + (bit >> 6)] >> (bit & 63).astype(np.uint64) & np.uint64(1)
            at = at[found.astype(bool)]
        return at


def _edits(codes: np.ndarray, same: _Filter | None, shorter: _Filter | None, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, edit) for the edits of words of one length that pass a filter."""
    length = codes.shape[1]
    power = _powers(length)
    letter = _letter(codes)
    upto = np.concatenate([np.zeros((len(codes), 1), np.uint64), np.cumsum(letter * power[:length], axis=1, dtype=np.uint64)], axis=1)
    whole, new = upto[:, -1], _letter(letters)
    for i in range(length):
        if shorter is not None:
            # of a run of one character only the first goes
            rows = np.arange(len(codes)) if i == 0 else np.flatnonzero(codes[:, i] != codes[:, i - 1])
            h = upto[rows, i] + (whole[rows] - upto[rows, i + 1]) * np.uint64(_BASE_INVERSE)
            rows = rows[shorter.has(h)]
            if len(rows):
                yield rows, _strings(np.delete(codes[rows], i, axis=1))
        if same is not None:
            rows, k = np.nonzero(codes[:, i, None] < letters[None, :])
            h = whole[rows] + (new[k] - letter[rows, i]) * power[i]
            found = same.has(h)
            if len(found):
                rows, k = rows[found], k[found]
                edited = codes[rows].copy()
                edited[:, i] = letters[k]
                yield rows, _strings(edited)


def near_pairs(vocabulary: DataFrame, most: int = PASS_BLOCKS) -> DataFrame:
    """(a, a_n, b, b_n): every two near words of ``vocabulary`` (word, n) once."""
    spark = vocabulary.sparkSession
    sizes = vocabulary.groupBy(F.length("word").alias("length")).count().collect()  # one row for each length of a word
    blocks = {r["length"]: -(-r["count"] * BITS // (64 * SLOTS)) for r in sizes}
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("c")).distinct().collect()  # 90 at most
    letters = np.array(sorted(ord(r["c"]) for r in letters if r["c"]), np.uint32)
    bits = stored(filters(vocabulary, blocks))
    met = []
    for dealt in passes(blocks, most):
        held = {}
        for length, first, end in dealt:
            slots = np.zeros((end - first) * SLOTS, np.uint64)
            part = bits.where((F.col("length") == length) & (F.col("block") >= first) & (F.col("block") < end)).select("block", "slot", "bits").toArrow()
            block, slot, value = (part.column(c).to_numpy() for c in range(3))
            slots[(block - first) * SLOTS + slot] = value.view(np.uint64)
            held[length] = _Filter(blocks[length], first, end, slots)
        met.append(_positives(vocabulary, spark.sparkContext.broadcast(held), letters))
    if not met:
        return vocabulary.selectExpr("word AS a", "n AS a_n", "word AS b", "n AS b_n").where("false")
    found = met[0]
    for more in met[1:]:
        found = found.unionByName(more)
    return found.join(vocabulary.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")


def _positives(vocabulary: DataFrame, held, letters: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for length, at in by_length(words):
                same, shorter = held.value.get(length), held.value.get(length - 1)
                if same is None and shorter is None:
                    continue
                step = max(1, (1 << 20) // (length * 8 + len(letters)))
                for begin in range(0, len(at), step):
                    rows = at[begin : begin + step]
                    for found, edited in _edits(_matrix([words[i] for i in rows], length), same, shorter, letters):
                        own = rows[found]
                        yield pa.record_batch([pa.array([words[i] for i in own], pa.string()), pa.array(counts[own]), pa.array(edited.tolist(), pa.string())], ["a", "a_n", "b"])

    lengths = sorted(n + more for n in held.value for more in (0, 1))
    rows = vocabulary.select("word", "n").where(F.length("word").isin(sorted(set(lengths))))
    return rows.mapInArrow(run, "a string, a_n long, b string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of each chain of forms."""
    reached = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = stored(reached.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if further.where("moved").isEmpty():
            return further.drop("moved")
        reached = further.drop("moved")


def variants(vocabulary: DataFrame, most: int = PASS_BLOCKS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each word of ``vocabulary`` (word, n)."""
    pairs = stored(near_pairs(vocabulary, most))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), "b")).alias("best"))
    formed = vocabulary.join(best, "word", "left")
    takes = -F.col("best.less") >= RATIO * F.col("n")
    formed = stored(formed.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.b")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n")))
    rooted = roots(formed.where("form is not null").select("word", "form"))
    return formed.join(rooted, "word", "left").withColumn("root", F.coalesce("root", "word"))


def query(docs: DataFrame) -> DataFrame:
    vocabulary = stored(occurrences(docs).where(F.col("n") >= LEAST_COUNT))
    return variants(vocabulary).select("word", "form", "root", "n", "n_near", "form_n")
