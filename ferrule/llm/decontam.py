"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Texts are lower-cased and cut into runs of letters and digits. A document and
a benchmark item overlap if along some alignment there are ``SPAN`` (12)
successive words of which at least 10 are equal: up to two may be substituted.

Masks. Cut a span into four blocks of three words. Two substitutions leave two
blocks whole, which lie next to each other, one block apart, or two apart. So
three fixed masks, 111111, 111...111 and 111......111, each ignoring the
positions between, find every overlap. A hash of the masked words is joined
with the same hash of the benchmark, and the alignment of each hit is verified
on the words themselves.

Items of fewer than 12 words take their length as the span, one seed of three
words, and one substitution in five words (none under six words); items of one
or two words take the whole item as the seed.

The benchmark's hashes are broadcast only if counted and found few; beyond
that, both sides are shuffled. Hot passages give rows in proportion to the
documents that hold them.

Edge cases: null and empty texts match nothing; ``overlaps`` gives one row for
a pair of ids, so that rows sharing a doc_id are reported as one and rows
without an id not at all, while ``clean`` judges every row on its own; repeated
items are each reported; several overlaps of one pair give one row; an empty
benchmark or table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import stored

SPAN, ERRORS, BLOCK = 12, 2, 3
GAPS = (3, 6, 9)
#: Benchmark hashes that may be broadcast (about 50 MB).
BROADCAST_ROWS = 1_000_000


def normalised(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _blocks(w: Column) -> Column:
    """Hashes of all runs of three words; of the whole text where it has fewer."""
    n = F.size(w)
    runs = F.transform(F.sequence(F.lit(0), n - BLOCK), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(n >= BLOCK, runs).otherwise(F.array().cast("array<bigint>"))


def _seeds(t: Column, gap: int) -> Column:
    """Masked hash of the block at the current position and the block ``gap`` words on."""
    return F.xxhash64(F.lit(gap), F.col("t0"), t)


def _short(w: Column) -> Column:
    """Hashes of all single words and word pairs."""
    one = F.transform(w, lambda x: F.xxhash64(F.lit(1), x))
    n = F.size(w)
    two = F.when(n >= 2, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.xxhash64(F.lit(2), F.get(w, i), F.get(w, i + 1))))
    return one, F.coalesce(two, F.array().cast("array<bigint>"))


def _positions(rows: DataFrame, key: str) -> DataFrame:
    """(key, at, t0, t3, t6, t9): each block hash with those of the blocks further on (null past the end)."""
    # no filter on the arrays: the planner would push it below them and build them twice
    at = F.when(F.size("t") > 0, F.sequence(F.lit(0), F.size("t") - 1)).otherwise(F.array().cast("array<int>"))
    ahead = F.transform(at, lambda i: F.struct(i.alias("at"), *(F.get("t", i + g).alias(f"t{g}") for g in (0, *GAPS))))
    return rows.select(key, F.inline(ahead))


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """(seed, item_id, at): hash, and the position of its first word in the item."""
    rows = stored(items.select("item_id", normalised(F.col("text")).alias("w"))).withColumn("n", F.size("w"))
    rows = stored(rows.withColumn("t", _blocks(F.col("w"))))
    every = _positions(rows.where(F.col("n") >= SPAN), "item_id")
    long = every.select("item_id", "at", F.inline(F.array(*(F.struct(F.when(F.col(f"t{g}").isNotNull(), _seeds(F.col(f"t{g}"), g)).alias("seed")) for g in GAPS)))).where("seed is not null")
    mid = _positions(rows.where((F.col("n") >= BLOCK) & (F.col("n") < SPAN)), "item_id").select("item_id", "at", F.col("t0").alias("seed"))
    one, two = _short(F.col("w"))
    few = rows.where((F.col("n") > 0) & (F.col("n") < BLOCK)).select("item_id", F.lit(0).alias("at"), F.when(F.col("n") == 1, F.get(one, F.lit(0))).otherwise(F.get(two, F.lit(0))).alias("seed"))
    return long.unionByName(mid).unionByName(few)


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_spans, matched): one row per overlapping pair.

    doc_word and item_word say where the first overlapping span begins, n_spans how many spans
    overlap, matched the most equal words of a span.
    """
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    seeds = stored(benchmark_seeds(items))
    n_seeds = seeds.count()
    item_words = stored(items.select("item_id", normalised(F.col("text")).alias("w"))).withColumn("n", F.size("w"))
    blocks = stored(item_words.select(_blocks(F.col("w")).alias("t"))).select(F.explode("t").alias("t0")).distinct()
    rows = docs.select("doc_id", normalised(F.col("text")).alias("w"))
    seen = _positions(rows.select("doc_id", _blocks(F.col("w")).alias("t")), "doc_id").join(_sized(blocks, n_seeds), "t0")
    keys = F.array(F.col("t0"), *(F.when(F.col(f"t{g}").isNotNull(), _seeds(F.col(f"t{g}"), g)) for g in GAPS))
    probes = seen.select("doc_id", F.col("at").alias("doc_at"), F.explode(keys).alias("seed"))
    if not item_words.where(F.col("n").between(1, BLOCK - 1)).isEmpty():
        one, two = _short(F.col("w"))
        single = rows.select("doc_id", F.posexplode(one).alias("doc_at", "seed"))
        pairs = rows.select("doc_id", F.posexplode(two).alias("doc_at", "seed"))
        probes = probes.unionByName(single).unionByName(pairs)
    hits = probes.join(_sized(seeds, n_seeds), "seed").select("doc_id", "item_id", (F.col("doc_at") - F.col("at")).alias("shift")).distinct()
    return _verified(docs, stored(hits), item_words, n_seeds)


def _verified(docs: DataFrame, hits: DataFrame, item_words: DataFrame, n_seeds: int) -> DataFrame:
    """Hits whose alignment (doc position less item position = shift) has a span with enough equal words."""
    found = docs.join(hits.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", normalised(F.col("text")).alias("dw"))
    # what of the document an item of n words can touch is cut out before items and documents meet
    pairs = found.join(hits, "doc_id").join(_sized(item_words.withColumnRenamed("w", "iw"), n_seeds), "item_id")
    pairs = pairs.select("doc_id", "item_id", "shift", "n", "iw", F.slice("dw", F.greatest(F.col("shift"), F.lit(0)) + 1, F.col("n")).alias("dw"))
    offset = F.greatest(-F.col("shift"), F.lit(0))
    equal = F.transform(F.col("iw"), lambda x, i: F.coalesce((i >= offset) & (F.get("dw", F.greatest(i - offset, F.lit(0))) == x), F.lit(False)).cast("int"))
    span = F.least(F.lit(SPAN), F.col("n"))
    least = span - F.when(span >= SPAN, ERRORS).when(span >= 6, F.floor(span / 5)).otherwise(0)
    pairs = pairs.select("doc_id", "item_id", "shift", equal.alias("equal"), span.alias("span"), least.alias("least"))
    sums = F.transform(F.sequence(F.lit(0), F.size("equal") - F.col("span")), lambda i: F.aggregate(F.slice("equal", i + 1, F.col("span")), F.lit(0), lambda a, x: a + x))
    spans = pairs.withColumn("sums", sums).select("doc_id", "item_id", "shift", F.posexplode("sums").alias("item_word", "matched"), "least").where("matched >= least")
    return spans.groupBy("doc_id", "item_id").agg(
        F.min(F.struct(F.col("item_word") + F.col("shift"), F.col("item_word"))).alias("first"),
        F.count(F.lit(1)).alias("n_spans"), F.max("matched").cast("long").alias("matched"),
    ).select("doc_id", "item_id", F.col("first.col1").cast("long").alias("doc_word"), F.col("first.item_word").cast("long").alias("item_word"), "n_spans", "matched")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without those that overlap with an item, rows without a doc_id or with a repeated one each on their own."""
    rows = docs.select("doc_id", "text")
    twice = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if twice.isEmpty():
        bad = stored(overlaps(docs, items).select("doc_id").distinct())
        return docs.join(bad, "doc_id", "left_anti").select(docs.columns)
    numbered = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")))
    bad = stored(overlaps(numbered.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")), items).select(F.col("doc_id").alias("row")).distinct())
    return numbered.join(bad, "row", "left_anti").select(*(F.col("doc")[c].alias(c) for c in docs.columns))
