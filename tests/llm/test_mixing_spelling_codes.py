import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ferrule.llm import codes, mixing, spelling

DOCS = "doc_id long, text string, lang string, source string, size string, target double, row string, n long, word string"


def docs_of(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, "x", 0.5, "r", 3, "w") for i, t, s in rows], DOCS)


# ---- mixing


def fair_shares(sizes, weights):
    """Targets by sharing out and stopping, source by source."""
    total, out, open_ = float(sum(sizes)), {}, set(range(len(sizes)))
    while open_:
        left = total - sum(out.values())
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > 3 * sizes[i]]
        if not over:
            return [out.get(i, left * weights[i] / w) for i in range(len(sizes))]
        for i in over:
            out[i] = 3.0 * sizes[i]
        open_ -= set(over)
    return [out[i] for i in range(len(sizes))]


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing_meets_the_targets(spark, seed):
    rnd = random.Random(seed)
    names = ["b", "a", None, "é", "z", ""]
    rows = [(i, "w " * (rnd.randint(0, 40) if s != "z" else 1), s) for i, s in enumerate(rnd.choices(names, [50, 5, 3, 2, 1, 30], k=900))]
    rows += [(5000, "long " * 4000, "b")]
    got = {r.doc_id: r for r in mixing.query(docs_of(spark, rows)).collect()}
    order = sorted({s for _, _, s in rows if s is not None}) + [None]
    sizes = [sum(len(t.split()) for _, t, x in rows if x == s) for s in order]
    want = dict(zip(order, fair_shares(sizes, [1 + k % 3 for k in range(len(order))])))
    taken, most = Counter(), Counter()
    for i, text, source in rows:
        r, n = got[i], len(text.split())
        assert (r.size, r.source_size) == (n, dict(zip(order, sizes))[source]) and math.isclose(r.target, want[source])
        assert r.taken <= 3 * n and (n == 0 or r.taken % n == 0)
        taken[source] += r.taken
    for source in order:
        small = max((len(t.split()) for _, t, s in rows if s == source and len(t.split()) <= 0.01 * want[source]), default=None)
        if small:  # the small documents make up for the large ones
            assert abs(taken[source] - want[source]) <= 2 * small + 1


def test_mixed_corpus_holds_what_the_query_counts(spark):
    docs = docs_of(spark, [(i, f"word{i} " * (i % 7), "ab"[i % 3 == 0]) for i in range(60)])
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
    first = {r.doc_id: r.taken for r in mixing.query(docs).collect()}
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in first.items() if v}
    assert {r.doc_id: r.taken for r in mixing.query(docs.repartition(7)).collect()} == first


def test_mixing_odd_rows_and_empty_table(spark):
    odd = [(1, None, "a"), (2, "", "a"), (3, "x y", "a"), (3, "x y", "a"), (None, "x y", None), (4, "lorem ipsum " * 50000, "b")]
    got = mixing.query(docs_of(spark, odd)).collect()
    assert sorted((r.doc_id or 0, r.size) for r in got) == [(0, 2), (1, 0), (2, 0), (3, 2), (3, 2), (4, 100000)]
    assert {r.target for r in got if r.doc_id == 3} == {12.0} and {r.taken for r in got if r.doc_id == 3} == {6}
    assert mixing.query(docs_of(spark, odd[:2])).select("target", "taken").collect() == [(0.0, 0)] * 2
    assert mixing.query(docs_of(spark, odd).where("false")).collect() == []


# ---- spelling


def vocabulary_of(rows):
    lower = str.maketrans(spelling.UPPER, spelling.LOWER)
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants_of(vocabulary):
    near = {a: [b for b in vocabulary if is_near(a, b)] for a in vocabulary}
    form = {}
    for a, n in vocabulary.items():
        best = min(near[a], key=lambda b: (-vocabulary[b], b), default=None)
        form[a] = best if best and vocabulary[best] >= 2 * n else None
    out = {}
    for a, n in vocabulary.items():
        root = a
        while form[root]:
            root = form[root]
        out[a] = (form[a], root, n, len(near[a]), vocabulary.get(form[a]))
    return out


def by_word(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("most", [spelling.PASS_BLOCKS, 2])
def test_variants_equal_brute_force(spark, most):
    rnd = random.Random(3)
    stems = ["colour", "naïveté", "aaaaa", "aaaaaa", "ÀÉÎÕÜ", "grammar", "×÷ßxy", "abcab"]
    text = []
    for stem in stems:
        for _ in range(40):
            word = list(stem)
            for _ in range(rnd.randint(0, 3)):
                at = rnd.randrange(len(word))
                word[at : at + rnd.randint(0, 1)] = rnd.choice(["", "a", "b", "ß", "ü", "ll"])
            text += ["".join(word)] * rnd.randint(1, 30)
    rnd.shuffle(text)
    rows = [(i, "; ".join(text[i * 50 : i * 50 + 50])) for i in range(len(text) // 50 + 1)]
    want = variants_of(vocabulary_of(rows))
    assert len(want) > 100 and any(v[0] and v[0] != v[1] for v in want.values())
    docs = docs_of(spark, [(i, t, "s") for i, t in rows])
    vocabulary = spelling.stored(spelling.occurrences(docs).where("n >= 3"))
    assert by_word(spelling.variants(vocabulary, most)) == want


def test_spelling_odd_rows_and_empty_table(spark):
    rows = [(1, None), (2, ""), (None, "Überfluß überfluß ÜBERFLUß Überfluß"), (3, "hello Hello HELLO hallo hallo hallo 12hello5"), (3, "hello"), (4, "abcde" * 30000 + " short on it " * 2000)] + [(9, "q" * 3000)] * 3
    assert by_word(spelling.query(docs_of(spark, [(i, t, "s") for i, t in rows]))) == variants_of(vocabulary_of(rows))
    assert spelling.query(docs_of(spark, [(1, "hello", "s")])).collect() == []
    assert spelling.query(docs_of(spark, [(1, "hello", "s")]).where("false")).collect() == []


def test_filters_of_all_passes_hold_all_words(spark):
    assert spelling.passes({5: 3, 6: 1, 9: 4}, 3) == [[(5, 0, 3)], [(6, 0, 1), (9, 0, 2)], [(9, 2, 4)]]


# ---- vector codes

VECTORS = "vec_id long, embedding array<float>, label int, error string, part int, code int"


def coded(rows, entries=64, rounds=2):
    """rows: (vec_id, vector, label), in order of vec_id, all whole."""
    v = np.array([[math.floor(256 * float(np.float32(x))) for x in vec] for _, vec, _ in rows], np.int64).reshape(len(rows), 16, -1)
    book = v[:entries].transpose(1, 0, 2).copy()

    def assign():
        far = ((v[:, :, None, :] - book[None]) ** 2).sum(-1)
        return far.argmin(2), far.min(2)

    for _ in range(rounds):
        entry, _ = assign()
        for p in range(16):
            for e in range(book.shape[1]):
                mine = v[entry[:, p] == e, p]
                if len(mine):
                    book[p, e] = [int(x) // len(mine) for x in mine.sum(0)]
    entry, error = assign()
    return ["".join(f"{e:02x}" for e in row) for row in entry], error.sum(1).tolist(), book


@pytest.mark.parametrize("most", [codes.MOST_VALUES, 3])
def test_codes_equal_brute_force(spark, most):
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 0.3) for _ in range(48)], rnd.choice([0, 1, None])) for i in range(300)]
    rows += [(300 + i, rows[7][1], 2) for i in range(100)]  # copies
    want, error, book = coded(rows)
    shuffled = rnd.sample(rows, len(rows)) + [(-1, None, 0), (-2, [None] * 48, 0), (-3, [math.nan] * 48, 1), (-4, [math.inf] + [0.0] * 47, 1), (-5, [], 1), (9999, [0.5] * 32, 1)]
    df = spark.createDataFrame([(i, v, label, "x", 1, 2) for i, v, label in shuffled], VECTORS)
    found, got = codes.compress(df, most=most)
    assert (got == book).all()
    assert {r.vec_id: (r.code, r.error) for r in found.collect()} == {r[0]: (c, e) for r, c, e in zip(rows, want, error)}
    assert (codes.decode(want[3], book).shape) == (48,)
    if most == codes.MOST_VALUES:
        total = Counter()
        for (_, _, label), e in zip(rows, error):
            total[label] += e
        labels = {r[0]: r[2] for r in rows}
        assert all(r.label_error == total[labels[r.vec_id]] for r in codes.query(df).collect())


def test_codes_odd_rows_and_empty_table(spark):
    few = [(5, [0.25] * 16, 1), (5, [0.25] * 16, 1), (None, [0.5] * 16, None), (7, [1e30] + [0.0] * 15, None), (8, None, 3)]
    df = spark.createDataFrame([(i, v, label, "x", 1, 2) for i, v, label in few], VECTORS)
    got = codes.query(df).collect()
    assert sorted((r.vec_id or 0) for r in got) == [0, 5, 5, 7] and {r.error for r in got} == {0} and len({r.codebooks_sha256 for r in got}) == 1
    assert [r.code for r in got if r.vec_id == 5] == ["00" * 16] * 2
    assert codes.query(df.where("vec_id = 8")).collect() == [] and codes.query(df.where("false")).collect() == []
