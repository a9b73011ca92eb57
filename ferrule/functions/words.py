"""Terms of texts, counted where a text is read.

Splitting in the JVM makes a row of every word of every text, and the trimming, the stop words and the
endings are then worked out for each. Here they are worked out once for each spelling of a block of texts,
by Arrow's functions on columns, and Spark gets one row for each text and term. The terms are those of
``text.token_rows``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.functions.vocab import ENDINGS, STOP, VARIANTS

#: Each byte that is no part of a word becomes a blank; texts are lower-cased before.
_BLANKED = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789+#._-" else 0x20 for c in range(256))
_STOP, _SPELT, _COMMON = pa.array(STOP), pa.array(list(VARIANTS)), pa.array(list(VARIANTS.values()))
#: Texts that are counted at a time.
ROWS = 2000


def norm(words: pa.Array) -> pa.Array:
    """``text.norm`` on a column of words."""
    long = pc.greater(pc.utf8_length(words), 4)
    fits = pc.make_struct(*(pc.and_(long, pc.ends_with(words, e)) for e in ENDINGS))
    cut = pc.case_when(fits, *(pc.utf8_slice_codeunits(words, 0, -len(e)) for e in ENDINGS), words)
    return pc.coalesce(_COMMON.cast(words.type).take(pc.index_in(words, _SPELT.cast(words.type))), cut)


def _content(words: pa.Array, least: int) -> pa.Array:
    return pc.and_(pc.greater_equal(pc.utf8_length(words), least), pc.invert(pc.is_in(words, _STOP.cast(words.type))))


def terms(raw: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(which, term) of different runs of word characters: none of stop words and single letters, several of compound words."""
    words = pc.utf8_trim(raw, "._-")
    kept = np.flatnonzero(_content(words, 2))
    words = words.take(pa.array(kept))
    joined = np.flatnonzero(reduce(pc.or_, (pc.match_substring(words, mark) for mark in "-.")))
    parts = pc.split_pattern_regex(words.take(pa.array(joined)), "[-.]")
    of, parts = np.repeat(joined, parts.value_lengths()), parts.flatten()
    good = _content(parts, 3)
    return np.concatenate([kept, kept[of[np.asarray(good)]]]), norm(pa.concat_arrays([words, parts.filter(good)]))


def counts(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, term, n) of lower-cased texts without nulls: the terms of each, and how often it has them."""
    data = texts.buffers()
    blanked = pa.Array.from_buffers(texts.type, len(texts), [None, data[1], pa.py_buffer((data[2] or pa.py_buffer(b"")).to_pybytes().translate(_BLANKED))], 0, texts.offset)
    words = pc.ascii_split_whitespace(blanked)
    row = np.repeat(np.arange(len(texts)), words.value_lengths())
    coded = words.flatten().dictionary_encode()
    which, found = terms(coded.dictionary)
    found = found.dictionary_encode()
    # from each spelling to the numbers of its terms
    order = np.argsort(which, kind="stable")
    numbers, times = np.asarray(found.indices)[order], np.bincount(which, minlength=len(coded.dictionary))
    spelling = np.asarray(coded.indices)
    n = times[spelling]
    at = np.repeat((np.cumsum(times) - times)[spelling] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    size = max(len(found.dictionary), 1)
    pairs, ns = np.unique(np.repeat(row, n) * size + numbers[at], return_counts=True)
    return pairs // size, found.dictionary.take(pa.array(pairs % size)), ns


def marked(row: np.ndarray, term: pa.Array, other_row: np.ndarray, other_term: pa.Array) -> np.ndarray:
    """Which pairs (row, term) are among the others."""
    both = pa.concat_arrays([term, other_term]).dictionary_encode()
    key = np.concatenate([row, other_row]) * max(len(both.dictionary), 1) + np.asarray(both.indices)
    return np.isin(key[: len(row)], key[len(row) :])


def term_counts(rows: DataFrame, text: Column, *keys: str, name: Column | None = None, lengths: bool = False) -> DataFrame:
    """(keys..., term, n, in_name): one row for each row of ``rows`` and term of its text; ``in_name`` where there is a name.

    With ``lengths`` each row of ``rows`` has a row without a term besides, with the number of all terms of its text, which
    is in each row as ``length`` too.
    """
    lower = lambda c: F.lower(F.coalesce(c, F.lit("")))
    named = name is not None
    asked = rows.select(*keys, lower(text).alias("_text"), lower(name if named else F.lit("")).alias("_name"))
    schema = T.StructType([*asked.schema.fields[:-2], T.StructField("term", T.StringType()), T.StructField("n", T.LongType()), T.StructField("in_name", T.BooleanType()), T.StructField("length", T.LongType())][: None if lengths else -1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            row, term, n = counts(batch.column(len(keys)))
            inside = marked(row, term, *counts(batch.column(len(keys) + 1))[:2]) if named else np.zeros(len(row), bool)
            if lengths:
                total = np.bincount(row, weights=n, minlength=batch.num_rows).astype(np.int64)
                row, n = np.append(row, np.arange(batch.num_rows)), np.append(n, total)
                term, inside = pa.concat_arrays([term, pa.nulls(batch.num_rows, term.type)]), np.append(inside, np.zeros(batch.num_rows, bool))
            own = [pa.array(total[row])] if lengths else []
            yield pa.record_batch([*(c.take(pa.array(row)) for c in batch.columns[:-2]), term, pa.array(n, pa.int64()), pa.array(inside), *own], schema.names)

    found = asked.mapInArrow(run, schema)
    return found if named else found.drop("in_name")


def comes_once(rows: DataFrame, key: str) -> bool:
    """Whether each row has a key of its own, so that what is counted by row needs no grouping."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
