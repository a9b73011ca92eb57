import hashlib
import io
import random
import re
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.llm import chat, decontam, hosts, packing, pii, repeats, simhash, tokens, toxicity, warc
from ferrule.llm.queries import vocabulary_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, w string"


def frame(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, 0, 0.5, "x", "y") for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, repeated rows, ties, a row without an id, a long text, clashing columns."""
    long = "lorem ipsum dolor " * 5000
    return frame(spark, [(1, None), (2, ""), (3, " \n\t "), (4, "a b c d e"), (4, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (6, long), (7, long)])


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_simhash_odd_rows_and_empty_table(spark, odd):
    got = simhash.query(odd).collect()
    assert len(got) == 9
    comp = {r.doc_id: r.component_id for r in got}
    assert (comp[1], comp[2], comp[3], comp[4], comp[5], comp[6], comp[7], comp[None]) == (1, 1, 1, 4, 4, 6, 6, 4)
    assert {r.fingerprint for r in got if r.doc_id in (1, 2, 3)} == {"0" * 16}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == {1: 1, 4: 1, 6: 1, None: 1}
    assert simhash.query(odd.where("false")).collect() == []


@pytest.mark.parametrize("limit", [256, 3])
def test_simhash_groups_equal_brute_force(spark, limit):
    rnd = random.Random(1)
    centres = [rnd.getrandbits(64) for _ in range(40)]
    fps = {c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 6))) for c in centres for _ in range(12)}
    signed = sorted(int(np.uint64(f).astype(np.int64)) for f in fps)
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), limit)
    root = {f: f for f in signed}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    got = {r.node: r.root for r in simhash.components(found).collect()}
    assert all(got.get(f, f) == top(f) for f in signed)


def test_token_counts_equal_the_library(spark, odd):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary_path())
    rnd = random.Random(2)
    bits = ["'s", "'", " ", "  ", "\n", "a", "the", "Ab", "1", ".", "é", "日本", "<|endoftext|>", "<|", "endoftext", "|>", "z" * 9]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    want = {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    rows = frame(spark, list(enumerate(texts)))
    for chunk in (1 << 16, 17):
        assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(rows, vocabulary_path(), chunk).collect()} == want
    pieces = [(i, k, t[k * 11 : k * 11 + 11]) for i, t in enumerate(texts) for k in range(max(1, -(-len(t) // 11)))]
    dealt = spark.createDataFrame(pieces, "doc_id long, chunk_no long, text string")
    assert {r.doc_id: r.n_tokens for r in tokens.count_chunked(dealt, vocabulary_path()).collect()} == want
    got = by_id(tokens.query(odd, vocabulary_path()))
    assert (got[1].n_tokens, got[1].n_bytes, got[1].over_limit, got[6].over_limit) == (0, 0, False, True)


def test_packing_places_every_byte_once(spark, odd):
    rnd = random.Random(3)
    texts = [(i, "x" * rnd.randint(0, 20000)) for i in range(150)]
    got = packing.pack(frame(spark, texts), shard=50).collect()
    assert {i: len(t) for i, t in texts if t} == dict(sum((Counter({r.doc_id: r.length}) for r in got), Counter()))
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r)
    for rows in bins.values():
        used = sum(r.length for r in rows)
        assert {r.capacity for r in rows} == {min(c for c in packing.CAPACITIES if c >= used)} and {r.used for r in rows} == {used}
        at = 0
        for r in sorted(rows, key=lambda r: r.bin_start):
            assert r.bin_start == at
            at += r.length
    assert sum(r.length for r in packing.pack(odd).collect()) == 4 + 4 * 9 + 2 * 90000
    assert packing.pack(odd.where("false")).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_packing_opens_what_costs_least_for_what_is_left(seed):
    """Best fit and openings against a plain simulation with lists."""
    rnd = random.Random(seed)
    caps = (8, 16, 32, 64)
    lengths = sorted((rnd.choice([rnd.randint(1, 64), rnd.randint(1, 6)]) for _ in range(120)), reverse=True)
    of, final = packing.assign(lengths, caps)
    opened, used = [], []
    for k, (size, number) in enumerate(zip(lengths, of)):
        room = [c - u for c, u in zip(opened, used) if c - u >= size]
        if room:
            assert opened[number] - used[number] == min(room)
        else:
            best = []
            for c in (c for c in caps if c >= size):
                held, rest = size, lengths[k + 1 :]
                for x in rest:  # from the largest down
                    if held + x <= c:
                        held += x
                best.append((packing.cost(c) / held, c))
            opened.append(min(best)[1])
            used.append(0)
            assert number == len(opened) - 1
        used[number] += size
    assert final == [min(c for c in caps if c >= u) for u in used]


def test_packing_mix_of_pieces_decides_the_length():
    assert packing.assign([1024] * 8, (1024, 2048))[1] == [2048] * 4 and packing.assign([1024, 1], (1024, 2048))[1] == [1024, 1024]


def test_packing_spreads_equal_rows(spark):
    rows = spark.createDataFrame([(None, "x" * 100)] * 3000, "doc_id long, text string")
    got = packing.pack(rows, shard=300).selectExpr("bin_id div 4294967296 AS shard").groupBy("shard").count().collect()
    assert sum(r["count"] for r in got) == 3000 and max(r["count"] for r in got) < 600


def test_archives_are_zip_files_and_round_trip(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "u", big), (2, "u", big), (3, "u", "small"), (4, "u", "small"), (5, None, None), (6, "u", big), (6, "u", big), (None, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.query(pages).collect()}
    assert got == {(1, "revisit", 6, 1200), (2, "revisit", 6, 1200), (6, "response", None, 1200), (3, "response", None, 5), (4, "response", None, 5), (5, "response", None, 0), (None, "response", None, 1200)}
    assert warc.query(pages.where("false")).collect() == []
    manifest = warc.write(warc.with_revisits(pages), f"file://{tmp_path}/out").collect()
    for m in manifest:
        with zipfile.ZipFile(m.path.removeprefix("file://")) as z:
            assert z.testzip() is None and set(z.namelist()) == {"archive/data.warc.gz", "indexes/index.jsonl"}
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a", b"abc")
        z.comment = b"PK not an end"
    member = warc.directory(plain, len(plain.getvalue()))[0]
    assert plain.getvalue()[warc.data_start(plain, member) :][: member.size] == b"abc"


def test_chat_folds_events_and_reads_back(spark):
    ev = [(1, 0, 0, 0, "open", "user", "x"), (1, 0, 0, 1, "edit", None, "q<|im_end|>"), (1, 1, 0, 0, "open", "assistant", None), (1, 1, 0, 1, "delta", None, "bad"),
          (1, 1, 0, 2, "regenerate", None, None), (1, 1, 0, 3, "delta", None, "a<\\|"), (1, 1, 0, 4, "delta", None, "b\n")]
    events = spark.createDataFrame(ev, chat._EVENTS)
    got = chat.read_back(chat.format_conversations(events)).collect()[0]
    assert got.n_turns == 2 and got.loss_chars == 6
    assert got.turns_sha256 == hashlib.sha256(b"user\nq<|im_end|>\nassistant\na<\\|b\n\n").hexdigest()
    assert got.loss_sha256 == hashlib.sha256(b"a<\\|b\n").hexdigest()
    rows = spark.createDataFrame([(1, 0, None, None), (1, 0, "user", "z"), (1, 0, "user", "z"), (None, 1, "as\nsistant\\n", "t")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.n_turns for r in chat.query(spark, rows).collect()}
    assert got == {1: 3, None: 1, -1: 2}


@pytest.mark.parametrize("limit", [20000, 2])
def test_repeats_equal_brute_force(spark, limit):
    rnd = random.Random(5)
    parts = ["".join(rnd.choice("abé ") for _ in range(rnd.randint(50, 400))) for _ in range(12)]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 4))) for _ in range(60)] + [None, "", "ab" * 400, "x" * 200, "y" * 201]
    rows = [*enumerate(texts), (0, texts[0]), (None, texts[1])]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.h) for r in repeats.remove(frame(spark, rows), group_limit=limit).withColumn("h", F.sha2("kept", 256)).collect())
    assert got == Counter((i, *x) for (i, _), x in zip(rows, repeats.brute_force([t for _, t in rows])))


@pytest.mark.parametrize("batch", [1, 2, 3])
def test_repeats_do_not_depend_on_batches_and_partitions(spark, batch):
    rnd = random.Random(8)
    parts = ["".join(rnd.choice("abc ") for _ in range(230)) for _ in range(4)]
    tables = [["x" * 100 + "y" * 100] * 2, [parts[0][:200]] * 2, [parts[0]] * 3 + [parts[1]] * 2 + [parts[2] + parts[3], "q" + parts[3]]]
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch), "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for texts in tables:
            got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.h) for r in repeats.remove(frame(spark, [*enumerate(texts)])).withColumn("h", F.sha2("kept", 256)).collect())
            assert got == Counter((i, *x) for i, x in enumerate(repeats.brute_force(texts)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_personal_data(spark, odd):
    rows = frame(spark, [(1, "mail a.b@c.de, 1.2.3.4 and 1.2.3.256"), (2, "card 4111 1111-1111 1111 or 4111111111111112"), (3, "+1 (234) 555-6789 +12"), (4, "é x@y 9")])
    got = by_id(pii.query(rows))
    assert got[1].spans == "email:5:13,ip:15:22" and got[2].spans == "card:5:24" and got[3].spans == "phone:0:17" and got[4].spans == ""
    assert got[1].base_sha256 == hashlib.sha256(b"email:5:13,ip:15:22").hexdigest()
    masked = pii.mask(rows)
    assert masked.columns == rows.columns and by_id(masked)[1].text == "mail [EMAIL], [IP] and 1.2.3.256"
    assert pii.query(odd).count() == 9 and pii.mask(odd).count() == 9 and pii.query(odd.where("false")).count() == 0


def test_personal_data_patterns_find_unseen_strings(spark):
    seeds = [(k, f"call me at +1 (234) 555-67{k:02d} now") for k in range(20)]
    got = by_id(pii.query(frame(spark, [*seeds, (99, "call me at 5550199 now"), (100, "room 5550199 now")])))
    assert got[99].spans == "phone:11:18" and got[99].n_phone == 0 and got[100].spans == ""


def test_toxicity_index_is_exact_and_learns(spark):
    rnd = random.Random(6)
    names = sorted(f"w{k}" for k in range(30))
    counts = [Counter(rnd.choices(range(30), k=rnd.randint(0, 6))) for _ in range(900)]
    starts = np.append(0, np.cumsum([len(c) for c in counts]))
    ids, ns = (np.array([x for c in counts for x in f(sorted(c.items()))]) for f in (lambda c: [i for i, _ in c], lambda c: [float(n) for _, n in c]))
    examples = toxicity.Examples(list(range(900)), np.array([rnd.randint(0, 1) for _ in range(900)]), np.zeros(900), names, starts, ids, ns)
    index = toxicity.Index(examples, np.arange(900))
    v = np.zeros((900, 30))
    for k, c in enumerate(counts):
        i, w = index.vector(np.array(sorted(c), int), np.array([float(c[x]) for x in sorted(c)]))
        v[k, i] = w
    for q in [Counter(rnd.choices(range(30), k=rnd.randint(1, 25))) for _ in range(40)]:
        i = np.array(sorted(q), int)
        n = np.array([float(q[x]) for x in i])
        query = np.zeros(30)
        query[index.vector(i, n)[0]] = index.vector(i, n)[1]
        cos = np.sort(np.round(v @ query, 8))[::-1]
        want = cos[(cos >= cos[toxicity.NEIGHBOURS - 1]) & (cos > 0)]
        near, got = index.nearest(i, n)
        assert np.allclose(np.repeat(np.round(got, 8), index.size[near].astype(int)), want, atol=2e-8)
    rows = [(k, f"plain words here {k}" if k % 4 else f"you utter fool {k}") for k in range(400)] + [(1000, None), (1001, "")]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    got = by_id(toxicity.query(docs, labels))
    assert all(got[k].predicted == (k % 4 == 0) for k in range(400)) and got[1000].predicted == 0 and 0 <= got[1001].score <= 1
    assert toxicity.score(docs, toxicity.fit(docs, labels)).columns.count("score") == 1
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 302
    assert toxicity.query(docs.where("false"), labels).count() == 0 and toxicity.query(docs, labels.where("false")).count() == 402


def test_toxicity_learns_rare_terms_from_few_rows(spark):
    rnd = random.Random(9)
    # 20 slurs, each in three labelled texts or so: none is significant beyond the size of the vocabulary
    texts = [(k, " ".join([f"w{chr(97 + k % 26)}{'x' * rnd.randint(1, 40)}" for _ in range(6)] + ([f"{'abcdefghijklmnopqrst'[j]}slur" for j in rnd.sample(range(20), 2)] if k % 10 == 0 else []))) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(400)], "doc_id long, toxic int")
    got = [r for r in toxicity.query(frame(spark, texts), labels).collect() if r.held_out]
    bad = [r.predicted for r in got if r.doc_id % 10 == 0]
    assert len(bad) >= 5 and sum(bad) >= 0.8 * len(bad) and sum(r.predicted for r in got if r.doc_id % 10) <= 3


def test_toxicity_is_calibrated_and_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = [r for r in toxicity.query(docs, labels).collect()]
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    model = toxicity.fit(docs, labels)
    ix, e = model.index, toxicity.examples_of(docs, labels)
    assert set(e.doc_ids) == {k for k in marks if not next(r.held_out for r in got if r.doc_id == k)}
    words = Counter(t for r in docs.collect() if r.doc_id in set(e.doc_ids) for t in toxicity.terms(r.text))
    assert set(e.names) == set(words)  # no term is left out
    rows = [ix.vector(*e.row(k)) for k in range(len(e.labels))]
    for r in docs.limit(60).collect():
        q = dict(zip(*(x.tolist() for x in ix.vector(*model.counted(r.text)))))
        cos = np.array([sum(q.get(i, 0) * w for i, w in zip(*(x.tolist() for x in v))) for v in rows])
        last = np.sort(cos)[-toxicity.NEIGHBOURS]
        use = (cos >= last - 1e-9) & (cos > 0)
        p = (float((cos[use] ** 2) @ e.labels[use]) + ix.rate) / (float((cos[use] ** 2).sum()) + 1)
        want = float(np.interp(p, *model.steps))
        assert abs(want - next(x.score for x in got if x.doc_id == r.doc_id)) < 1e-6
    held = [(r.score, marks[r.doc_id]) for r in got if r.held_out and r.doc_id in marks]
    assert sum((s - y) ** 2 for s, y in held) / len(held) < 0.09


def test_host_rules(spark, odd):
    got = by_id(hosts.query(odd))
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept and got[6].n_repeat_words == 15000 and got[6].base_failed
    good = " ".join(f"word{k}" for k in range(40))
    rows = frame(spark, [(k, good.replace("word", f"a{k}")) for k in range(50)], "good").unionByName(frame(spark, [(100 + k, "bad" if k else good) for k in range(50)], "bad")).unionByName(frame(spark, [(200, good)], None))
    got = by_id(hosts.query(rows))
    assert all(got[k].kept for k in range(50)) and got[200].kept and not got[100].base_failed and not got[100].kept
    assert hosts.query(odd.where("false")).count() == 0


def test_decontamination_equals_brute_force(spark, odd):
    rnd = random.Random(7)
    vocab = [f"v{k}" for k in range(50)]
    items = [(k, [rnd.choice(vocab) for _ in range(n)]) for k, n in enumerate([40, 20, 12, 8, 4, 2, 1])]
    items[5], items[6] = (5, ["rare", "pair"]), (6, ["unique"])
    docs = []
    for k in range(120):
        words = [rnd.choice(vocab) for _ in range(30)]
        item = list(items[rnd.randrange(7)][1])
        for _ in range(rnd.randint(0, 3)):
            item[rnd.randrange(len(item))] = "zz"
        docs.append((k, words[:15] + item + words[15:]))
    want = set()
    for d, dw in docs:
        for i, iw in items:
            n = len(iw)
            span = min(12, n)
            least = span - (2 if span >= 12 else span // 5 if span >= 6 else 0)
            for shift in range(-n, len(dw)):
                eq = [0 <= j + shift < len(dw) and dw[j + shift] == iw[j] for j in range(n)]
                if any(sum(eq[a : a + span]) >= least for a in range(n - span + 1)):
                    want.add((d, i))
    bench = spark.createDataFrame([(i, " ".join(w).upper() + "!") for i, w in items] + [(99, None)], "item_id long, text string")
    rows = frame(spark, [(d, ", ".join(w)) for d, w in docs] + [(500, None)])
    assert {(r.doc_id, r.item_id) for r in decontam.overlaps(rows, bench).collect()} == want
    assert decontam.overlaps(odd, bench).count() == 0 and decontam.overlaps(rows, bench.where("false")).count() == 0
    assert by_id(decontam.clean(rows, bench)).keys() == {d for d, _ in docs} - {d for d, _ in want} | {500}


def test_pipeline_keeps_columns_and_ends_in_bins(spark, tmp_path):
    import corpus_pipeline as P

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert after.columns == docs.columns
        now = {r.doc_id for r in after.select("doc_id").collect()}
        assert now <= ids and len(now) > 0.5 * len(ids)
        docs, ids = after, now
    assert not [r for r in spark.read.parquet(f"{tmp_path}/3").collect() if re.search(r"[0-9]@mail[0-9]", r.text)]


def test_empty_tables(spark, odd):
    none = odd.where("false")
    assert tokens.query(none, vocabulary_path()).count() == 0 and repeats.query(none).count() == 0
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [(r.conv_id, r.n_turns) for r in chat.query(spark, rows).collect()] == [(-1, 2)]


def test_decontamination_judges_rows_without_ids_on_their_own(spark):
    item = " ".join(f"item{k}" for k in range(20))
    rows = frame(spark, [(1, item), (1, "clean text"), (None, f"before {item} after"), (None, "clean too")])
    kept = decontam.clean(rows, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert kept.columns == rows.columns and sorted(r.text for r in kept.collect()) == ["clean text", "clean too"]


def test_personal_data_in_groups_of_digits_and_by_found_patterns(spark):
    seeds = [(k, f"ring us on +1 (234) 555-6{k:03d} now") for k in range(200)]
    # strings found after the first pattern stand after another one, which no seed has met
    hop = [(1000 + k, f"ring us on 555 123 44{k:02d} now") for k in range(20)] + [(2000 + k, f"our desk: 555 123 44{k:02d} ok") for k in range(20)]
    got = by_id(pii.query(frame(spark, [*seeds, *hop, (300, "our desk: (555) 987-6543 ok"), (301, "lot 555 987 6543 ok")])))
    assert all(got[1000 + k].spans == "phone:11:23" and got[1000 + k].n_phone == 0 for k in range(20))
    assert got[300].spans == "phone:10:24" and got[301].spans == ""


def test_masking_keeps_texts_and_rows_together(spark):
    rows = frame(spark, [(k, f"mail u{k}@host.example or none {k}" if k % 2 else f"none {k}") for k in range(200)])
    dealt = rows.repartition(7).withColumn("doc", F.lit("clash"))
    got = {r.doc_id: r.text for r in pii.mask(dealt).collect()}
    assert got == {k: f"mail [EMAIL] or none {k}" if k % 2 else f"none {k}" for k in range(200)}


def test_archives_are_read_by_several_tasks(spark):
    pages = spark.range(3000).selectExpr("id AS page_id", "'u' AS url", "repeat('x', int(id % 50)) AS html")
    manifest = warc.write(warc.with_revisits(pages), f"{warc.own_folder(spark, 'test')}")
    found = warc.read(manifest, block=100)
    assert found.count() == 3000 and found.select(F.spark_partition_id()).distinct().count() > 1
