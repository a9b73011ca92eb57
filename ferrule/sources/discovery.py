"""Finding what a catalogue holds: notes with front matter under several roots, of which the first that has a name wins.

Folders are listed through Hadoop's file systems, level by level, so that a
skipped folder is never looked into; the files that are left are read by Spark,
whole, and parsed as columns.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.sources.tables import first_wins, front_matter

#: Folders that hold no notes of their own, besides those whose names begin with a dot.
SKIPPED = ("node_modules", "__pycache__", "dist", "build", "venv")
#: Characters of a file that are read for its front matter.
HEAD = 8000
FOUND = "kind string, name string, about string, extra string, path string, harness string, scope string"


class Root(NamedTuple):
    """A folder of notes. ``note`` names the file that a folder is recognised by; without it, every Markdown file is a note."""

    kind: str
    harness: str
    scope: str
    path: str
    note: str | None = "SKILL.md"
    recursive: bool = False


def _listed(spark: SparkSession, folder: str) -> list[tuple[str, str, bool]]:
    """(name, path, is it a folder) of what is in a folder, by name; none if it is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted((s.getPath().getName(), s.getPath().toString(), s.isDirectory()) for s in fs.listStatus(path))


def notes(spark: SparkSession, root: Root, skipped: tuple[str, ...] = SKIPPED) -> list[str]:
    """Paths of the notes of a root, in order. Without ``recursive`` only its own folders (or files) are looked at."""
    out, level = [], [root.path]
    while level:
        below = []
        for folder in level:
            for name, path, is_folder in _listed(spark, folder):
                if is_folder and not name.startswith(".") and name not in skipped:
                    below.append(path)
                    if root.note and any(n == root.note and not d for n, _, d in _listed(spark, path)):
                        out.append(f"{path}/{root.note}")
                elif not root.note and not is_folder and name.endswith(".md") and not name.startswith("."):
                    out.append(path)
        level = below if root.recursive else []
    return sorted(out)


def discover(spark: SparkSession, roots: list[Root], skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(kind, name, about, extra, path, harness, scope): one row for each kind and name without regard to case, the first root's; within a root the first path's."""
    rows = None
    for k, root in enumerate(roots):
        paths = notes(spark, root, skipped)
        if paths:
            read = spark.read.text(paths, wholetext=True).select(F.substring("value", 1, HEAD).alias("head"), F.col("_metadata.file_path").alias("path"))
            read = read.select("*", F.lit(k).alias("root"), *(F.lit(v).alias(c) for c, v in (("kind", root.kind), ("harness", root.harness), ("scope", root.scope), ("of_folder", root.note is not None))))
            rows = read if rows is None else rows.unionByName(read)
    if rows is None:
        return spark.createDataFrame([], FOUND)
    rows = rows.withColumn("m", front_matter(F.col("head")))
    given = lambda key: F.coalesce(F.col("m")[key], F.lit(""))
    own = F.when(F.col("of_folder"), F.regexp_extract("path", "([^/]+)/[^/]+$", 1)).otherwise(F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), r"\.md$", ""))
    name = F.coalesce(F.nullif(F.btrim(given("name")), F.lit("")), F.url_decode(own))
    extra = F.array_join(F.array(*(given(k) for k in ("tags", "type", "keywords", "triggers"))), " ")
    found = rows.select(F.concat_ws(":", "kind", F.lower(name)).alias("key"), "root", "path", "kind", name.alias("name"), given("description").alias("about"), extra.alias("extra"), "harness", "scope")
    return first_wins(found, "key", "root", "path").select("kind", "name", "about", "extra", "path", "harness", "scope")
