"""The corpus pipeline: toxicity, near-duplicates, decontamination, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; what it returns is written as Parquet and read again as the next one's
docs. All but the last return the columns of ``documents``.

Edge cases: null text counts as empty throughout; rows without a doc_id stay
until they are packed, and are never copies of others; of repeated rows with one
doc_id one stays; an empty table gives no bins; stages keep columns they do not
know.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import decontam, near, packing, pii, tokens, toxicity
from ferrule.llm.common import discard, own_folder, scratch, stored, table
from ferrule.llm.queries import vocabulary_path


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic from their nearest labelled examples."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: fingerprints within four bits, or sets of five-word shingles alike to 0.8."""
    return near.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked in their texts."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into bins of several lengths, measured in tokens."""
    counts = stored(tokens.count_tokens(docs, vocabulary_path(), keep=False).select("doc_id", "n_tokens"))
    return packing.pack(counts, length=F.col("n_tokens"))


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: SQL cannot express fingerprints, neighbours or bins; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder, before = own_folder(spark, "pipeline"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
