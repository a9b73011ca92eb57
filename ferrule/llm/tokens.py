"""Token counts by a compiled finite-state tokenizer.

The byte-level BPE vocabulary is compiled into two deterministic transducers.

* The splitter walks character classes (letter, number, white space, other)
  and marks where a piece of the text ends for certain, whatever stands
  further left or right.
* The piece transducer reads the bytes of a piece. Each of its states is the
  prefix read so far, reduced to the last token of that prefix's encoding, and
  each transition is annotated with the change of the number of emitted
  tokens. A token sequence is an encoding exactly if all its adjacent pairs
  survive on their own, so the last token after one more byte is the one
  vocabulary entry that ends there and survives next to the last token before
  it. States and transitions are compiled when first needed and kept.

A chunk of a text becomes a state map: the stretch before its first certain
cut, the tokens between its first and last cut, the stretch after its last
cut. Entering the chunk in any state changes nothing beyond the first
stretch, so maps compose associatively; chunks are scanned independently and
their maps combined in a balanced tree, within a task for whole texts
(``count_tokens``) or across tasks for texts dealt out in rows
(``count_chunked``).

Counts equal those of the ``tokenizers`` library for the same file: added
special strings inside a text count as one token, none are put around it.

Edge cases: null text counts as empty, with zero tokens; repeated rows give
repeated results; an empty table gives none; other columns are ignored; long
texts are scanned chunk by chunk.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import kept

#: Characters of a chunk.
CHUNK = 1 << 16
#: Pieces and states kept by a Python worker; beyond, it starts compiling anew.
KEPT_PIECES, KEPT_STATES = 600_000, 800_000
#: Longer pieces are not kept.
LONG_PIECE = 100

_SPACE = r"\p{White_Space}"
#: Where the vocabulary's own pre-tokenization splits (fixed value, with the white space of its library).
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|{_SPACE}+(?![^{_SPACE}])|{_SPACE}+")
_CERTAIN = (
    rf"(?<=[^{_SPACE}])(?={_SPACE})|(?<=\p{{L}})(?=[^{_SPACE}\p{{L}}])|(?<=\p{{N}})(?=[^{_SPACE}\p{{N}}])"
    rf"|(?<=[^{_SPACE}\p{{L}}\p{{N}}'])(?=[\p{{L}}\p{{N}}])|(?<=')(?=\p{{N}})"
)
FIRST_CUT, LAST_CUT = regex.compile(_CERTAIN), regex.compile(f"(?r){_CERTAIN}")


class StateMap(NamedTuple):
    """What a chunk does: ``tokens`` is None if it has no certain cut, and then all of it is ``head``."""

    head: str
    tokens: int | None
    tail: str


def load_vocabulary(path: str) -> dict:
    """Vocabulary, merges and special strings of a ``tokenizers`` JSON file."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    model = found["model"]
    if model["type"] != "BPE" or found["pre_tokenizer"]["type"] != "ByteLevel" or found.get("normalizer"):
        raise ValueError("only byte-level BPE without a normalizer is compiled")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return {"vocab": model["vocab"], "merges": merges, "special": [t["content"] for t in found["added_tokens"]]}


@lru_cache(1)
def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class _Pieces(dict):
    """Tokens of each piece, found when first asked for."""

    def __init__(self, find, most: int) -> None:
        self.find, self.most = find, most

    def __missing__(self, piece: str) -> int:
        n = self.find(piece)
        if len(piece) <= LONG_PIECE:
            if len(self) >= self.most:
                self.clear()
            self[piece] = n
        return n


class Transducer:
    """Compiled tokenizer; use one per Python worker. It keeps a share of the pieces and states that are kept at most."""

    def __init__(self, vocabulary: dict, share: int = 1) -> None:
        self.most_pieces, self.most_states = KEPT_PIECES // share, KEPT_STATES // share
        letters = _byte_letters()
        as_bytes = {s: bytes(letters[c] for c in s) for s in vocabulary["vocab"] if all(c in letters for c in s)}
        self.ids = {b: vocabulary["vocab"][s] for s, b in as_bytes.items()}
        n = max(self.ids.values()) + 1
        self.merged: dict[int, int] = {}
        self.born = [-1] * n
        self.parts: list[tuple[int, int] | None] = [None] * n
        vocab = vocabulary["vocab"]
        for rank, (a, b) in enumerate(vocabulary["merges"]):
            self.merged[vocab[a] << 32 | vocab[b]] = rank
            if self.parts[vocab[a + b]] is None:
                self.parts[vocab[a + b]], self.born[vocab[a + b]] = (vocab[a], vocab[b]), rank
        self.suffixes, self.token_at = self._backwards()
        self.special = vocabulary["special"]
        self.context = max([1, *map(len, self.special)]) - 1
        self.cut_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pairs: dict[int, bool] = {}
        self.ends: tuple[dict, dict] = ({}, {})
        self.pieces = _Pieces(self._piece, self.most_pieces)
        self._restart()

    def _restart(self) -> None:
        self.step: dict[int, int] = {}
        self.last, self.emitted = [-1], [0]

    def _backwards(self) -> tuple[dict[int, int], list[int]]:
        """Automaton over bytes read backwards: (state << 8 | byte) -> state, and the token that a state spells, or -1."""
        move: dict[int, int] = {}
        spelled = [-1]
        for raw, token in self.ids.items():
            at = 0
            for byte in reversed(raw):
                nxt = move.get(at << 8 | byte)
                if nxt is None:
                    nxt = move[at << 8 | byte] = len(spelled)
                    spelled.append(-1)
                at = nxt
            spelled[at] = token
        return move, spelled

    def _last_token(self, raw: bytes, i: int, path: list[int]) -> tuple[int, int]:
        """Last token of the encoding of raw[:i], and the state before it."""
        move, spelled, last = self.suffixes.get, self.token_at, self.last
        found, at, k = [], 0, i
        while k:
            k -= 1
            at = move(at << 8 | raw[k])
            if at is None:
                break
            if spelled[at] >= 0:
                found.append((spelled[at], path[k]))
        for token, before in reversed(found):
            if before == 0 or self._survive(last[before], token):
                return token, before
        raise ValueError("the vocabulary lacks a byte")

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at one end of ``token`` while it is built: (token, rank at which it is merged away)."""
        if (known := self.ends[side].get(token)) is not None:
            return known
        out, until, at = [], float("inf"), token
        while True:
            out.append((at, until))
            if self.parts[at] is None:
                self.ends[side][token] = out
                return out
            until, at = self.born[at], self.parts[at][side]

    def _survive(self, a: int, b: int) -> bool:
        """Whether tokens a, b next to each other stay as they are: no merge reaches across while they are built."""
        key = a << 32 | b
        if (known := self.pairs.get(key)) is None:
            known = self._never_joined(self._spine(a, 1), self._spine(b, 0))
            if len(self.pairs) > self.most_pieces:
                self.pairs = {}
            self.pairs[key] = known
        return known

    def _never_joined(self, left: list, right: list) -> bool:
        merged = self.merged.get
        for x, until_x in left:
            x <<= 32
            for y, until_y in right:
                rank = merged(x | y)
                if rank is not None and rank < until_x and rank <= until_y:
                    return False
        return True

    def _piece(self, piece: str) -> int:
        raw = piece.encode("utf-8")
        if len(self.last) > self.most_states:
            self._restart()
        step, last, emitted = self.step, self.last, self.emitted
        path, state = [0], 0
        for i, byte in enumerate(raw, 1):
            key = state << 8 | byte
            nxt = step.get(key)
            if nxt is None:
                token, before = self._last_token(raw, i, path)
                nxt = step[key] = len(last)
                last.append(token)
                emitted.append(emitted[before] + 1)
            path.append(nxt)
            state = nxt
        return emitted[state]

    def _plain(self, text: str) -> int:
        return sum(map(self.pieces.__getitem__, PIECE.findall(text)))

    def count(self, text: str) -> int:
        """Tokens of a stretch that begins and ends at certain cuts."""
        if self.cut_special is None:
            return self._plain(text)
        parts = self.cut_special.split(text)
        return sum(map(self._plain, parts)) + len(parts) - 1

    def _outside(self, text: str, cut: int) -> int:
        """``cut``, or the start of the special string that it would divide."""
        for m in self.cut_special.finditer(text, max(0, cut - self.context), cut + self.context) if self.special else ():
            if m.start() < cut < m.end():
                return m.start()
        return cut

    def state_map(self, chunk: str) -> StateMap:
        first = FIRST_CUT.search(chunk, self.context)
        final = LAST_CUT.search(chunk, 0, max(0, len(chunk) - self.context))
        if first and final:
            a, b = self._outside(chunk, first.start()), self._outside(chunk, final.start())
            if self.context <= a <= b:
                return StateMap(chunk[:a], self.count(chunk[a:b]), chunk[b:])
        return StateMap(chunk, None, "")

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """The map of two neighbouring stretches; associative."""
        if a.tokens is None:
            m = self.state_map(a.head + b.head)
            if b.tokens is None:
                return m
            if m.tokens is None:
                return StateMap(m.head, b.tokens, b.tail)
            return StateMap(m.head, m.tokens + self.count(m.tail) + b.tokens, b.tail)
        if b.tokens is None:
            m = self.state_map(a.tail + b.head)
            if m.tokens is None:
                return StateMap(a.head, a.tokens, m.head)
            return StateMap(a.head, a.tokens + self.count(m.head) + m.tokens, m.tail)
        return StateMap(a.head, a.tokens + self.count(a.tail + b.head) + b.tokens, b.tail)

    def scan(self, maps: list[StateMap]) -> int:
        """Tokens of neighbouring chunks, combined in a balanced tree."""
        while len(maps) > 1:
            odd = maps[len(maps) // 2 * 2 :]
            maps = [self.compose(x, y) for x, y in zip(maps[::2], maps[1::2])] + odd
        return self.count(maps[0].head) + (maps[0].tokens or 0) + self.count(maps[0].tail) if maps else 0

    def tokens(self, text: str, chunk: int = CHUNK) -> int:
        if len(text) <= chunk:
            return self.count(text)
        return self.scan([self.state_map(text[i : i + chunk]) for i in range(0, len(text), chunk)])


def _worker(vocabulary, key: int, share: int = 1) -> Transducer:
    return kept(("tokens", key, share), lambda: Transducer(vocabulary.value, share))


def count_tokens(docs: DataFrame, path: str, chunk: int = CHUNK, keep: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row; no shuffle. Without ``keep`` a task holds a quarter of the states and lets go of them in the end."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    key = hash((path, id(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _worker(vocabulary, key, 1 if keep else 4)
        for batch in batches:
            counts = np.fromiter((t.tokens(x.as_py() or "", chunk) for x in batch.column(2)), np.int64, batch.num_rows)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])
        if not keep:
            del t
            kept("tokens", dict)

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def count_chunked(chunks: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens) of texts dealt out as rows (doc_id, chunk_no, text).

    Each chunk becomes its state map where it is read; only the maps, a few words
    each, are gathered by document and scanned in the order of chunk_no.
    """
    vocabulary = chunks.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    key = hash((path, id(vocabulary)))

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _worker(vocabulary, key)
        for batch in batches:
            found = [t.state_map(x.as_py() or "") for x in batch.column(2)]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([m.head for m in found]), pa.array([m.tokens for m in found], pa.int64()), pa.array([m.tail for m in found])],
                ["doc_id", "chunk_no", "head", "tokens", "tail"],
            )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _worker(vocabulary, key)
        for batch in batches:
            counts = [t.scan([StateMap(m["head"], m["tokens"], m["tail"]) for m in row]) for row in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    rows = chunks.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("chunk_no").cast("long").alias("chunk_no"), "text")
    found = rows.mapInArrow(maps, "doc_id long, chunk_no long, head string, tokens long, tail string")
    ordered = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_no", "head", "tokens", "tail"))).alias("maps"))
    return ordered.mapInArrow(scan, "doc_id long, n_tokens long")


def query(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    return count_tokens(docs, path).withColumn("over_limit", F.col("n_tokens") > limit)
