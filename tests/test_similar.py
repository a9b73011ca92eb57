"""Similar sets: all that is alike is found where it meets, in blocks, and no more than a row for each set comes out."""

from itertools import combinations
import random

import pytest

from ferrule.operators import similar


def _sets(n: int, seed: int = 3) -> dict[str, list[str]]:
    rnd = random.Random(seed)
    base = [[f"w{rnd.randrange(60)}" for _ in range(rnd.choice([2, 5, 9, 14]))] for _ in range(n // 6)]
    out = {}
    for k in range(n):
        words = list(rnd.choice(base))
        for _ in range(rnd.randrange(3)):
            words[rnd.randrange(len(words))] = f"w{rnd.randrange(60)}"
        out[f"s{k:03}"] = sorted(set(words))
    return out


def _overlaps(sets):
    return {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for (a, x), (b, y) in combinations(sorted(sets.items()), 2) if x and y}


@pytest.mark.parametrize("block", [7, 1024])
def test_best_in_blocks_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    sets = _sets(150)
    want: dict[str, tuple[float, str]] = {}
    for (a, b), o in _overlaps(sets).items():
        if o >= 0.6:
            for x, y in ((a, b), (b, a)):
                want[x] = min(want.get(x, (1.0, "~")), (-round(o, 4), y))
    got = {r.id: (-r.overlap, r.other) for r in similar.best(spark.createDataFrame(list(sets.items()), "id string, t array<string>"), 0.6).collect()}
    assert got == want and len(want) > 50


@pytest.mark.parametrize("block", [7, 1024])
def test_links_join_what_all_pairs_join(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    sets = {k: v for k, v in {tuple(v): (k, v) for k, v in _sets(150).items()}.values()}
    asked = {k for n, k in enumerate(sorted(sets)) if n % 3}
    pairs = {p for p, o in _overlaps(sets).items() if o >= 0.6 and (p[0] in asked or p[1] in asked)}
    root = {k: k for k in sets}

    def top(x, root):
        while root[x] != x:
            x = root[x]
        return x

    def groups(edges):
        root = {k: k for k in sets}
        for a, b in edges:
            root[top(a, root)] = top(b, root)
        return {frozenset(k for k in sets if top(k, root) == r) for r in {top(k, root) for k in sets}}

    frame = lambda keep: spark.createDataFrame([(k, v) for k, v in sets.items() if (k in asked) == keep], "set_id string, t array<string>")
    found = {tuple(sorted((r.a, r.b))) for r in similar.links(frame(True), 0.6, frame(False)).collect()}
    assert found <= pairs and groups(found) == groups(pairs)


def test_sets_that_are_all_alike_give_no_pairs_of_all(spark):
    """300 sets of which each two are alike: 44,850 pairs, but links grow with the sets."""
    rows = [(f"s{k:03}", [f"c{i}" for i in range(12)] + [f"d{k}"]) for k in range(300)]
    found = similar.links(spark.createDataFrame(rows, "set_id string, t array<string>"), 0.6)
    assert 299 <= found.count() <= 12 * 2 * 300
