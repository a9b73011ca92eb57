"""A catalogue that is kept up: postings, document frequencies and vectors by version, with deltas.

Version n is made from version n - 1 and the items as they are now. Only items
that are new or whose content hash has changed are tokenised. What is stored,
below one folder:

* ``manifest/version=n``: (item_id, hash, length, born) of every item, ``born``
  being the version whose delta holds its postings;
* ``postings/born=n``: (item_id, term, tf, in_name) of the items tokenised for version n;
* ``terms/version=n``: (term, df): those of version n - 1, less the terms that
  changed or lost items had, plus those of new and changed ones;
* ``vectors/batch=...``: (hash, vector): items with an unchanged hash keep theirs.

A version is a pure function of the one before and its input, and writes only
folders that carry its number, so running it again after a failure gives the
same; a version counts once its ``counts`` are written, the last thing that is.
Reading joins the manifest with the deltas; ``compact`` writes what is live into
one delta.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions import words
from ferrule.functions.text import item_hash, token_rows
from ferrule.operators import search
from ferrule.sources.shared import new_folder

_MANIFEST = "item_id long, hash string, length long, born int"
_POSTINGS = "item_id long, term string, tf long, in_name boolean"
_COUNTS = "items long, same long, changed long, new long, lost long, tokenised long, vectors_missing long"


class Catalogue:
    """Stored versions below ``folder``; items are (item_id, name, text), name may be null."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.folder = spark, folder or new_folder(spark, "catalogue")

    # ---- reading

    def _read(self, path: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{path}")

    def _there(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _empty(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def latest(self) -> int:
        """The last version that is whole; -1 if there is none."""
        n = -1
        while self._there(f"counts/version={n + 1}/_SUCCESS"):
            n += 1
        return n

    def manifest(self, version: int) -> DataFrame:
        return self._read(f"manifest/version={version}", _MANIFEST) if version >= 0 else self._empty(_MANIFEST)

    def terms(self, version: int) -> DataFrame:
        """(term, df) of a version."""
        return self._read(f"terms/version={version}", "term string, df long") if version >= 0 else self._empty("term string, df long")

    def postings(self, version: int, items: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
        """The live postings of a version: each item's from the delta in which it was last tokenised.

        ``items``: (item_id, born) of the version's items that are wanted, ``terms``: (term), where not all are.
        """
        if version < 0:
            return self._empty(_POSTINGS)
        born = [r["born"] for r in self.manifest(version).select("born").distinct().collect()]  # a row for each version that is still used
        rows = None
        for b in born:
            delta = self._read(f"postings/born={b}", _POSTINGS).withColumn("born", F.lit(b))
            if terms is not None:  # before the items are looked up
                delta = delta.join(terms, "term", "left_semi")
            rows = delta if rows is None else rows.unionByName(delta)
        if rows is None:
            return self._empty(_POSTINGS)
        wanted = self.manifest(version) if items is None else items
        return rows.join(wanted.select("item_id", "born"), ["item_id", "born"], "left_semi").select("item_id", "term", "tf", "in_name")

    def counts(self, version: int) -> DataFrame:
        return self._read(f"counts/version={version}", _COUNTS)

    def vectors(self, version: int) -> DataFrame:
        """(item_id, vector) of the items of a version that have one."""
        if not self._there("vectors"):
            return self._empty("item_id long, vector array<double>")
        known = self.spark.read.schema("hash string, vector array<double>").parquet(f"{self.folder}/vectors").dropDuplicates(["hash"])
        return self.manifest(version).select("item_id", "hash").join(known, "hash").select("item_id", "vector")

    def without_vector(self, version: int) -> DataFrame:
        """(item_id, hash) that a model has to embed: no item with the same content has a vector yet."""
        rows = self.manifest(version).select("item_id", "hash")
        if not self._there("vectors"):
            return rows
        return rows.join(self.spark.read.parquet(f"{self.folder}/vectors").select("hash"), "hash", "left_anti")

    # ---- writing

    def put_vectors(self, rows: DataFrame, batch: int) -> None:
        """Adds (hash, vector); the same batch written again replaces itself."""
        rows.select("hash", F.transform("vector", lambda x: x.cast("double")).alias("vector")).write.mode("overwrite").parquet(f"{self.folder}/vectors/batch={batch}")

    def update(self, items: DataFrame, version: int | None = None) -> int:
        """Makes the next version (or the given one again) from the items as they are now, one row for each id; returns its number."""
        version = self.latest() + 1 if version is None else version
        rows = items.select(F.col("item_id").cast("long").alias("item_id"), "name", "text")
        hashed = rows.withColumn("hash", item_hash(F.col("name"), F.col("text")))
        before = self.manifest(version - 1).select("item_id", F.col("hash").alias("had"), F.col("length").alias("old_length"), "born")
        state = hashed.select("item_id", "hash").join(before, "item_id", "full_outer")
        how = F.when(F.col("had").isNull(), "new").when(F.col("hash").isNull(), "lost").when(F.col("hash") == F.col("had"), "same").otherwise("changed")
        state.select("*", how.alias("how")).write.mode("overwrite").parquet(f"{self.folder}/changes/version={version}")
        state = self._read(f"changes/version={version}", "item_id long, hash string, had string, old_length long, born int, how string")
        fresh = state.where("how in ('new', 'changed')").select("item_id")
        # in the first version all items are new
        self._tokenise(rows.join(fresh, "item_id", "left_semi") if version else rows.where("item_id is not null"), version)
        delta = self._read(f"postings/born={version}", _POSTINGS)
        self._manifest(state, delta, version)
        self._terms(state, delta, version)
        done = self.manifest(version)
        tallies = state.groupBy().agg(*(F.count_if(F.col("how") == h).alias(h) for h in ("same", "changed", "new", "lost")))
        read = delta.select("item_id").distinct().agg(F.count(F.lit(1)).alias("tokenised"))
        # one row each
        both = tallies.crossJoin(read).crossJoin(done.agg(F.count(F.lit(1)).alias("items"))).crossJoin(self.without_vector(version).select("hash").distinct().agg(F.count(F.lit(1)).alias("vectors_missing")))
        both.select("items", "same", "changed", "new", "lost", "tokenised", "vectors_missing").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/counts/version={version}")
        return version

    def _tokenise(self, rows: DataFrame, version: int) -> None:
        own = words.term_counts(rows, F.concat_ws(" ", "name", "text"), "item_id", name=F.col("name")).withColumnRenamed("n", "tf")
        if not words.comes_once(rows, "item_id"):
            own = own.groupBy("item_id", "term").agg(F.sum("tf").alias("tf"), F.max("in_name").alias("in_name"))
        own.write.mode("overwrite").parquet(f"{self.folder}/postings/born={version}")

    def _manifest(self, state: DataFrame, delta: DataFrame, version: int) -> None:
        fresh = delta.groupBy("item_id").agg(F.sum("tf").alias("length"))
        rows = state.where("how <> 'lost'").join(fresh, "item_id", "left")
        same = F.col("how") == "same"
        rows = rows.select(
            "item_id", "hash", F.when(same, F.col("old_length")).otherwise(F.coalesce("length", F.lit(0))).cast("long").alias("length"),
            F.when(same, F.col("born")).otherwise(F.lit(version)).cast("int").alias("born"),
        )
        rows.write.mode("overwrite").parquet(f"{self.folder}/manifest/version={version}")

    def _terms(self, state: DataFrame, delta: DataFrame, version: int) -> None:
        gone = state.where("how in ('changed', 'lost')").select("item_id", "born")
        lost = self.postings(version - 1, gone).select("term", F.lit(-1).cast("long").alias("df"))
        moved = self.terms(version - 1).unionByName(lost).unionByName(delta.select("term", F.lit(1).cast("long").alias("df")))
        moved.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0").write.mode("overwrite").parquet(f"{self.folder}/terms/version={version}")

    def compact(self) -> int:
        """A version like the last one whose postings are all in one delta."""
        last = self.latest()
        version = last + 1
        self.postings(last).write.mode("overwrite").parquet(f"{self.folder}/postings/born={version}")
        self.manifest(last).withColumn("born", F.lit(version)).write.mode("overwrite").parquet(f"{self.folder}/manifest/version={version}")
        self.terms(last).write.mode("overwrite").parquet(f"{self.folder}/terms/version={version}")
        n = self.counts(last)
        zero = F.lit(0).cast("long")
        n.select("items", F.col("items").alias("same"), zero.alias("changed"), zero.alias("new"), zero.alias("lost"), zero.alias("tokenised"), "vectors_missing").write.mode("overwrite").parquet(f"{self.folder}/counts/version={version}")
        return version

    # ---- searching

    def corpus(self, queries: DataFrame, version: int | None = None) -> search.Corpus:
        """What ``search`` needs to rank queries (query_id, text); texts of items are not read."""
        version = self.latest() if version is None else version
        asked = search.stored(token_rows(queries, F.col("text"), "query_id").distinct())
        posted = self.postings(version, terms=asked.select("term").distinct())
        lengths = self.manifest(version).select("item_id", "length")
        return search.corpus(asked, posted, lengths, lengths.agg(F.count(F.lit(1)).alias("n")))


def named(items: DataFrame, name: Column | None = None) -> DataFrame:
    """Items (item_id, text) in the catalogue's columns."""
    return items.select("item_id", (F.lit(None).cast("string") if name is None else name).alias("name"), "text")
