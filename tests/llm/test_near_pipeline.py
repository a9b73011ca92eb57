import random
from collections import Counter

import pytest

from ferrule.llm import near, packing, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, same long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, 2) for i, t in rows], DOCS)


def words(rnd, n):
    return [f"w{rnd.randrange(5000)}" for _ in range(n)]


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def planted(seed):
    """Texts of 8 to 400 words, near copies of some, a large group of near copies, short ones."""
    rnd, texts = random.Random(seed), []
    for size in [8, 20, 60, 150, 400] * 6:
        base = words(rnd, size)
        texts.append(base)
        for _ in range(3):
            copy = list(base)
            for _ in range(max(1, size // 80)):
                copy[rnd.randrange(size)] = "changed" + str(rnd.randrange(99))
            texts.append(copy)
    base = words(rnd, 200)
    for _ in range(400):  # more than a block of one key
        copy = list(base)
        copy[rnd.randrange(200)] = "other" + str(rnd.randrange(9999))
        texts.append(copy)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [near.BLOCK, 40])
def test_pairs_alike_to_the_least_share_a_group(spark, block, monkeypatch):
    monkeypatch.setattr(near.candidates, "__defaults__", (block, near.FIRST))
    rows = planted(7)
    found = {r.doc_id: r.component_id for r in near.groups(docs_of(spark, rows)).collect()}
    sets = {i: shingles(t) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(pairs) > 1000
    assert sum(found[a] == found[b] for a, b in pairs) >= 0.98 * len(pairs)
    # links hold true: who is in a group has a partner in it that is alike, by sets or by fingerprint
    fps = {i: simhash.fingerprint(t, 5) for i, t in rows}
    members = Counter(found.values())
    for a in sets:
        if members[found[a]] > 1:
            assert any(b != a and found[b] == found[a] and (len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) or (fps[a] ^ fps[b]).bit_count() <= 4) for b in sets)


def test_near_copies_odd_rows(spark):
    long = "lorem ipsum dolor sit amet " * 4000
    odd = docs_of(spark, [(1, None), (2, ""), (3, " \n"), (4, "a b c d e f"), (4, "a b c d e f"), (5, "A b c D e f"), (None, "a b c d e f"), (6, long), (7, long + "end"), (8, "quite another text than these")])
    kept = near.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == {1: 1, 4: 1, 6: 1, 8: 1, None: 1}
    assert near.keep_one(odd.where("false")).collect() == []


def test_shards_follow_pieces_and_fill_is_reported(spark):
    rows = spark.createDataFrame([(i, "x" * 100) for i in range(5)], "doc_id long, text string")
    bins = packing.pack(rows, (8, 16), shard=10)
    assert bins.selectExpr("bin_id div 4294967296 AS s").distinct().count() > 1  # 5 documents, 35 pieces
    r = packing.fill(bins).first()
    assert r.used == 500 and r.held == sum({b.bin_id: b.capacity for b in bins.collect()}.values())
    assert 0 <= r.padded_at_best <= r.padded < 0.2
    assert packing.fill(packing.pack(rows.where("false"))).first().bins == 0


def test_pipeline_on_planted_tables(spark, tmp_path):
    import corpus_pipeline as P

    rnd = random.Random(3)
    vile = ["gronk", "blarf", "skeeze", "vorm"]
    docs, labels, bench = [], [], [(1, " ".join(words(rnd, 30)), )]
    for i in range(240):
        toxic = i % 4 == 0
        docs.append((i, " ".join(words(rnd, 40) + (rnd.choices(vile, k=12) if toxic else [])), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    clean = [i for i in range(240) if i % 4]
    docs += [(1000, docs[clean[0]][1], "en", "s", 0), (1001, docs[clean[1]][1] + " more", "en", "s", 0)]  # copies of clean ones
    docs += [(1002, " ".join(words(rnd, 20)) + " " + bench[0][1] + " " + " ".join(words(rnd, 20)), "en", "s", 0)]
    docs += [(1003, " ".join(words(rnd, 20)) + " write to jo.doe@mail.example now", "en", "s", 0), (1004, None, None, None, None), (1005, "", "en", "s", 0), (None, "no id here", "en", "s", 0)]
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", bench, "item_id long, text string")):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in P.STAGES[:-1]:
        step = spark.createDataFrame(stage(spark, step, str(tmp_path)).collect(), step.schema)
        kept[name] = {r.doc_id: r.text for r in step.collect()}
    assert {0, 4, 8}.isdisjoint(kept["toxicity"]) and len(set(clean) & set(kept["toxicity"])) >= 0.95 * len(clean)
    assert {1000, 1001}.isdisjoint(kept["near_duplicates"]) and 1004 in kept["near_duplicates"] and 1005 not in kept["near_duplicates"]
    assert 1002 not in kept["decontamination"] and set(kept["near_duplicates"]) - set(kept["decontamination"]) == {1002}
    assert "jo.doe@mail.example" not in kept["personal_data"][1003] and set(kept["personal_data"]) == set(kept["decontamination"])
    packed = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {i for i, t in kept["personal_data"].items() if t}
    used = Counter()
    for r in packed:
        used[r.bin_id] += r.length
    assert all(used[r.bin_id] == r.used <= r.capacity for r in packed)
    (tmp_path / "empty").mkdir()
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / "empty" / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path / "empty")).collect() == []


@pytest.mark.parametrize("n", [20, 700])
def test_no_link_within_a_key_is_lost(spark, monkeypatch, n):
    """All classes share a key. Of i, i + n and i + 2n the first two are alike, share no other key, and both agree better with the third."""
    rng = random.Random(5)
    sketches = {}
    for i in range(n):
        base = [1, 2, 3, 4] + [rng.randrange(1 << 30) for _ in range(near.BINS - 4)]
        third = [rng.randrange(1 << 30) if k % 4 == 0 and k else x for k, x in enumerate(base)]
        second = [rng.randrange(1 << 30) if k % 4 == 1 and 1 < k < 32 else x for k, x in enumerate(third)]
        sketches |= {i: base, i + n: second, i + 2 * n: third}
    rows = [(i, rng.getrandbits(63), i, 50, s) for i, s in sketches.items()]
    marked = spark.createDataFrame(rows, "doc_id long, fp long, same long, size long, sketch array<int>")
    true = spark.createDataFrame([(i, i + n) for i in range(n)], "a long, b long")
    monkeypatch.setattr(near, "sketched", lambda *_: marked)
    monkeypatch.setattr(near, "checked", lambda pairs, *_: pairs.join(true, ["a", "b"], "left_semi"))
    found = {r.doc_id: r.component_id for r in near.groups(marked.selectExpr("doc_id", "'' AS text")).collect()}
    assert found == {i: i % n if i < 2 * n else i for i in sketches}


def test_crowds_of_almost_alike_texts_make_few_pairs(spark, monkeypatch):
    """Texts of one origin, most of them alike to 0.6 or 0.7 only: their pairs are compared in place, and the links among them are found there."""
    rng = random.Random(11)
    base, texts = words(rng, 150), []
    for i in range(150):
        copy = list(base)
        for k in rng.sample(range(150), 3):
            copy[k] = f"own{i}of{k}"
        texts.append(copy)
    for i in range(0, 60, 3):
        texts.append([*texts[i][:-1], f"last{i}"])
    sets = [shingles(" ".join(t)) for t in texts]
    fps = [simhash.fingerprint(" ".join(t), 5) for t in texts]
    want = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if want[a] != want[b] and (len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) or (fps[a] ^ fps[b]).bit_count() <= 4):
                want = [min(want[a], want[b]) if w in (want[a], want[b]) else w for w in want]
    given, checked = [], near.checked
    monkeypatch.setattr(near, "candidates", lambda classes, of_key: classes.selectExpr("id AS a", "id AS b").where("false"))
    monkeypatch.setattr(near, "checked", lambda pairs, *rest: given.append(pairs.count()) or checked(pairs, *rest))
    found = {r.doc_id: r.component_id for r in near.groups(docs_of(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    assert [found[i] for i in range(len(texts))] == want and 50 < len(set(want)) <= 150
    assert sum(given) <= 4 * len(texts)
