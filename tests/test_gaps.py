import random
import re

import pytest
from pyspark.sql import functions as F

from ferrule.functions.vocab import INTENT_STOP
from ferrule.streaming import gaps as G

HOUR = 3600


def tokens_of(prompt):
    return sorted({w for w in re.findall("[a-z][a-z0-9_-]{2,}", prompt.lower()) if w not in INTENT_STOP})


def fold(rows):
    """One prompt after the other against all entries."""
    entries = {}
    now = 0
    for at, prompt in rows:
        own = set(tokens_of(prompt))
        if not own:
            continue
        now = at
        entries = {k: e for k, e in entries.items() if e["last"] >= at - G.KEPT}
        best, key = 0.0, None
        for k, e in entries.items():
            j = len(own & set(e["tokens"])) / len(own | set(e["tokens"]))
            if j > best:
                best, key = j, k
        if best < G.LEAST:
            key = " ".join(sorted(own))
        e = entries.get(key) or {"first": at, "count": 0, "examples": []}
        if prompt[:120] not in e["examples"]:
            e["examples"] = (e["examples"] + [prompt[:120]])[-5:]
        entries[key] = e | {"tokens": sorted(own), "last": at, "count": e["count"] + 1}
    return {k: (tuple(e["tokens"]), e["first"], e["last"], e["count"], tuple(e["examples"])) for k, e in entries.items() if e["last"] >= now - G.KEPT}


def prompts(seed, n):
    """Prompts whose words drift, a hot one that comes again and again, pauses longer than an entry lives."""
    rnd, at, out = random.Random(seed), 10**6, []
    words = [f"word{c}{k}" for c in "abcd" for k in range(6)]
    for _ in range(n):
        at += rnd.choice([60, HOUR, HOUR, 86400, 86400 * 2])
        if rnd.random() < 0.004:
            at += G.KEPT + 1
        if rnd.random() < 0.3:
            out.append((at, "deploy the payments service again"))
            continue
        group = rnd.choice("abcd")
        own = rnd.sample([w for w in words if w[4] == group], rnd.randint(3, 5))
        out.append((at, " ".join(own)))
    return out


@pytest.mark.parametrize("cuts", [[], [150], [40, 41, 260]])
def test_entries_equal_a_fold_in_one_and_in_many_batches(spark, tmp_path, cuts):
    rows = prompts(len(cuts), 400)
    sink = G.Sink(str(tmp_path))
    edges = [0, *cuts, len(rows)]
    for n, (a, b) in enumerate(zip(edges, edges[1:])):
        batch = spark.createDataFrame([(k, *rows[k]) for k in range(a, b)], "ord long, at long, prompt string")
        sink(batch, n)
        if n == 1:
            sink(batch, n)  # run again after a failure
    got = {r.key: (tuple(r.tokens), r.first, r.last, r["count"], tuple(r.examples)) for r in sink.entries(spark, len(cuts)).collect()}
    want = fold(rows)
    assert len(want) > 3 and max(v[3] for v in want.values()) > 9
    assert got == want


def test_a_stream_gives_the_same(spark, tmp_path):
    rows = prompts(9, 120)
    path = f"{tmp_path}/asked"
    for k, part in enumerate((rows[:50], rows[50:])):
        spark.createDataFrame([(50 * k + i, *r) for i, r in enumerate(part)], "ord long, at long, prompt string").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("ord long, at long, prompt string").option("maxFilesPerTrigger", 1).parquet(path)
    got = {r.key: r["count"] for r in G.kept_up(stream, str(tmp_path / "s")).collect()}
    assert got == {k: v[3] for k, v in fold(rows).items()}


def test_rekeying_is_planned_then_applied(spark):
    long = [f"t{k:02d}" for k in range(30)]
    rows = [
        ("a b", ["a", "b"], 1, 5, 9, 2, ["x"], None, None),
        (" ".join(long), long, 2, 6, 8, 3, ["y"], None, None),  # long, nothing decided
        ("old one", long, 3, 7, 7, 4, ["z"], True, None),
        ("old two", list(reversed(long)), 4, 8, 12, 5, ["w"], None, "pack"),
    ]
    entries = spark.createDataFrame(rows, "key string, tokens array<string>, born long, first long, last long, count long, examples array<string>, served boolean, installed string")
    plan = G.plan_rekey(entries)
    assert {r.key: r.action for r in plan.collect()} == {"a b": "keep", " ".join(long): "drop", "old one": "rekey", "old two": "rekey"}
    after = {r.key: r for r in G.apply_rekey(plan).collect()}
    assert len(after) == 2 and after["a b"]["count"] == 2
    key = next(k for k in after if k.startswith("intent:"))
    assert (after[key]["count"], after[key].last, after[key].served, after[key].installed) == (9, 12, True, "pack")


def test_nothing_to_fold(spark):
    none = spark.createDataFrame([(1, 5, "the and of"), (2, 6, None), (3, 7, "")], "ord long, at long, prompt string")
    assert G.merged(spark.createDataFrame([], G.ENTRY), none).collect() == []
    held = spark.createDataFrame([("k", ["k"], 1, 2, 3, 4, ["k"])], G.ENTRY)
    assert G.merged(held, none).count() == 1 and G.merged(held, none.where(F.lit(False))).count() == 1
