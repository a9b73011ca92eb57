"""Building the index of examples takes little more memory than the index."""

import tracemalloc

import numpy as np

from ferrule.llm import toxicity


def test_index_is_built_in_little_more_than_its_own_memory():
    rnd = np.random.default_rng(3)
    n, each, names = 1000, 400, [f"t{i}" for i in range(50_000)]
    ids = np.concatenate([np.sort(rnd.choice(len(names), each, replace=False)) for _ in range(n)])
    examples = toxicity.Examples(list(range(n)), rnd.integers(0, 2, n), np.zeros(n), names, np.arange(n + 1) * each, ids, rnd.integers(1, 5, n * each))
    tracemalloc.start()
    try:
        index = toxicity.Index(examples, np.arange(n))
        now, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert len(index.postings) == n * each and most < 2 * now
