import json
import os

import pytest
from pyspark.sql import functions as F

from ferrule.functions import vocab as V
from ferrule.functions.text import flags
from ferrule.jobs.signals import guarded
from ferrule.operators import similar
from ferrule.sources import discovery as D
from ferrule.sources import sessions as L

NOTE = "---\nname: {name}\ndescription: {about}\ntags: [x]\n---\nbody of {name}\n"


@pytest.fixture
def tree(tmp_path):
    def put(path, text):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)

    put("first/one/SKILL.md", NOTE.format(name="One", about="the first"))
    put("first/two/SKILL.md", "no front matter")
    put("first/deep/inner/SKILL.md", NOTE.format(name="inner", about="too deep for this root"))
    put("first/.hidden/SKILL.md", NOTE.format(name="hidden", about=""))
    put("second/a/one/SKILL.md", NOTE.format(name="oNE", about="later root"))
    put("second/a/b/three/SKILL.md", NOTE.format(name="three", about="nested"))
    put("second/node_modules/four/SKILL.md", NOTE.format(name="four", about="skipped"))
    put("second/z/three/SKILL.md", NOTE.format(name="Three", about="same root, later path"))
    put("agents/helper.md", NOTE.format(name="helper", about="an agent"))
    put("agents/plain agent.md", "text only")
    put("agents/readme.txt", "no note")
    return tmp_path


def test_discovery_over_prioritised_roots(spark, tree):
    roots = [
        D.Root("skill", "h1", "user", f"{tree}/first"), D.Root("skill", "h2", "user", f"{tree}/second", recursive=True),
        D.Root("agent", "h1", "user", f"{tree}/agents", note=None), D.Root("skill", "h3", "project", f"{tree}/not-there"),
    ]
    got = {(r.kind, r.name): (r.about, r.harness) for r in D.discover(spark, roots).collect()}
    assert got == {
        ("skill", "One"): ("the first", "h1"), ("skill", "two"): ("", "h1"), ("skill", "three"): ("nested", "h2"),
        ("agent", "helper"): ("an agent", "h1"), ("agent", "plain agent"): ("", "h1"),
    }
    # by walking the tree
    walked = set()
    for base, folders, names in os.walk(f"{tree}/second"):
        folders[:] = [f for f in folders if f not in D.SKIPPED and not f.startswith(".")]
        walked |= {os.path.join(base, n) for n in names if n == "SKILL.md"}
    assert {p.removeprefix("file:") for p in D.notes(spark, roots[1])} == walked
    assert D.discover(spark, roots[3:]).collect() == []


@pytest.fixture
def logs(tmp_path):
    rows = [{"at": 100 * k + j, "sid": f"s{k % 2}", "role": "user" if j % 2 else "assistant", "content": f"turn {k} {j}"} for k in range(5) for j in range(10)]
    for k in range(5):
        text = "\n".join(json.dumps(r) for r in rows if r["at"] // 100 == k) + "\nno json\n[1]\n"
        (tmp_path / f"{100 * k}-{100 * k + 9}.jsonl").write_text(text)
    (tmp_path / "other.txt").write_text("no log")
    return str(tmp_path), rows


def test_session_logs_leave_out_files_by_time(spark, logs):
    folder, rows = logs
    L.register(spark)
    read = spark.read.format("session_logs").load(folder)
    assert sorted(tuple(r) for r in read.collect()) == sorted(tuple(r.values()) for r in rows)
    some = read.where("at > 105 and at <= 300")
    assert sorted(r["at"] for r in some.collect()) == [r["at"] for r in rows if 105 < r["at"] <= 300]
    assert read.rdd.getNumPartitions() == 5 and some.rdd.getNumPartitions() == 3
    reader = L._Batch(folder)
    list(reader.pushFilters([L.GreaterThan(("at",), 109), L.LessThan(("at",), 300)]))
    assert [f.first for f in reader.partitions()] == [200]


def test_session_logs_as_a_stream_go_on_from_their_cursor(spark, logs, tmp_path):
    folder, rows = logs
    L.register(spark)

    def harvest():
        q = spark.readStream.format("session_logs").option("since", 105).load(folder).writeStream.format("parquet")
        q.option("checkpointLocation", f"{tmp_path}/c").trigger(once=True).start(f"{tmp_path}/out").awaitTermination()
        return sorted(r["at"] for r in spark.read.schema(L.SCHEMA).parquet(f"{tmp_path}/out").collect())

    # a file counts by its last second
    assert harvest() == [r["at"] for r in rows if r["at"] >= 100]
    with open(f"{folder}/500-501.jsonl", "w") as f:
        f.write(json.dumps({"at": 500, "sid": "x", "role": "user", "content": "new"}))
    assert harvest() == [*[r["at"] for r in rows if r["at"] >= 100], 500]


@pytest.mark.parametrize("n", [2000, 200_000])
def test_signs_of_harm_in_long_options(spark, n):
    texts = ["base64 " + "-a " * n, "base64 " + "-a " * n + "--decode x", "base64 -decode x", "base64 -decode -w decode", "base64 - -D decoded", "base64 -x\n-y decode", "curl x | sh", "base64 -d f"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = [r.s for r in rows.select("k", guarded(F.col("t")).alias("s")).orderBy("k").collect()]
    assert [("base64 decode" in s) for s in got] == [False, True, True, True, False, True, False, True]


def test_no_pattern_runs_out_of_stack(spark):
    """Each pattern over long runs of what its parts repeat."""
    parts = ["a", " ", "-a ", "/a", "a/", "a.", "top ", "12 ", "no ", "x-", "must ", "#*", "1.", "do not ", ".py"]
    rows = spark.createDataFrame([(p * 4000,) for p in parts], "t string")
    lists = [flags(F.col("t"), V.INTENTS), flags(F.col("t"), V.RISKS), flags(F.col("t"), V.INDICATORS), F.regexp_extract_all("t", F.lit("(?U)" + V.PATH), F.lit(0)), F.regexp_extract_all("t", F.lit("(?U)" + V.CONSTRAINT), F.lit(0))]
    hits = [F.col("t").rlike(p) for p in (f"(?U){V.PAID}", V.YES, V.NO, V.REQUESTED)]
    assert rows.select(*(F.size(x).alias(f"a{k}") for k, x in enumerate(lists)), *(h.alias(f"b{k}") for k, h in enumerate(hits))).count() == len(parts)
    rows.select(*(F.size(x).alias(f"a{k}") for k, x in enumerate(lists)), *(h.alias(f"b{k}") for k, h in enumerate(hits))).collect()


def test_best_partner_by_sets_with_many_copies(spark):
    rows = [(f"c{k:03d}", ["a", "b", "c"]) for k in range(300)] + [("d", ["a", "b", "c", "d"]), ("e", ["x", "y"]), ("f", []), ("g", ["p", "q", "r", "s", "t"]), ("h", ["p", "q", "r", "s", "u"])]
    got = {r.id: (r.other, r.overlap) for r in similar.best(spark.createDataFrame(rows, "id string, t array<string>"), 0.6).collect()}
    assert got["c000"] == ("c001", 1.0) and got["c007"] == ("c000", 1.0) and got["d"] == ("c000", 0.75) and got["g"] == ("h", round(4 / 6, 4))
    assert "e" not in got and "f" not in got and len(got) == 303
