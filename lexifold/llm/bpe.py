"""BPE encoding by a tokenization automaton.

A byte-level vocabulary with ranked merges is compiled into a deterministic automaton whose words
are exactly the token sequences that BPE gives.  It starts as one state with an arc for each byte.
For the merge of (u, v) into w, in the order of ranks, a merge gadget is put in: the arcs for u lead
to a fresh state, a copy of the one they led to but without the arc for v, and every state with an
arc for u gets one for w, to where v led.  Where an arc leads depends on its token alone, so the
gadgets are six integer tables: for a state its parent, the token it lost and the merge that made
it; for a token its state, its merge and that merge's left part.

A word is encoded by walking two tables.  The labels are a trie, (node, byte) -> node, so that one
walk finds every token that a place of the word can begin with; the transition table, (state,
token) -> state, says where each of them leads, or that the automaton has no such arc.  Rows of it
are made from the gadgets when they are first used.  The longest token with an arc is taken; where
none has one, the walk goes back to the next shorter token before.  Each place of a word is reached
by one path only, as each prefix has one accepted path, so no place is tried twice.  All that a
worker keeps is bounded (``MOVES``, ``CACHE``); beyond that it starts anew, with the same results.
Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: White space as Unicode has it (White_Space), which the pre-splitter's ``\s`` means: fixed values.
_SPACE = "\t-\r \x85\xa0  -     　"
#: The pre-splitter's pattern: a fixed value.
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: The same for texts that are all ASCII.
_ASCII_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: Transitions, and words (of so many characters at most) with their ids, that a worker keeps, twice: some 80 MB.
MOVES, CACHE, CACHED_CHARS = 150_000, 150_000, 24


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary file."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_tokenizer(path: str) -> dict:
    """Labels, byte ids, merges and special tokens of a tokenizer file, ready to be broadcast."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    symbols = byte_symbols()
    raw = lambda token: bytes(symbols[c] for c in token)
    vocab = {raw(k): i for k, i in spec["model"]["vocab"].items()}
    pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
    merges = [(vocab[raw(a)], vocab[raw(b)], vocab[raw(a) + raw(b)]) for a, b in pairs]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return {"labels": {i: k for k, i in vocab.items()} | {i: k.encode() for k, i in special.items()}, "bytes": [vocab[bytes([b])] for b in range(256)], "merges": merges, "special": special}


class Automaton:
    def __init__(self, spec: dict):
        self.labels: dict[int, bytes] = spec["labels"]
        self.special: dict[str, int] = spec["special"]
        size = max(self.labels) + 1
        self.born, self.left = array("i", [-1]) * size, array("i", [-1]) * size
        self.leads_to = array("i", [0]) * size
        self.parent, self.lost, self.made = array("i", [0]), array("i", [-1]), array("i", [-1])
        alive = set(spec["bytes"])
        for r, (u, v, w) in enumerate(spec["merges"]):
            at = self.leads_to[u]
            if u not in alive or v not in alive or not self.has_arc(at, v):
                continue  # BPE never sees u before v
            self.born[w], self.left[w], self.leads_to[w] = r, u, self.leads_to[v]
            self.leads_to[u] = len(self.parent)
            self.parent.append(at)
            self.lost.append(v)
            self.made.append(r)
            alive.add(w)
        # The labels as a trie of bytes, and the token that ends at a node.
        self.trie: dict[int, int] = {}
        self.ends = array("i", [-1])
        self.length = array("i", [0]) * size
        for t in sorted(alive):
            node = 0
            for b in self.labels[t]:
                to = self.trie.get(node << 8 | b)
                if to is None:
                    to = self.trie[node << 8 | b] = len(self.ends)
                    self.ends.append(-1)
                node = to
            self.ends[node] = t
            self.length[t] = len(self.labels[t])
        self.moves: dict[int, int] = {}
        self.cache: dict[str, bytes] = {}  # the words met of late, and those met before them
        self.older: dict[str, bytes] = {}

    def has_arc(self, state: int, token: int) -> bool:
        """Whether ``state`` has an arc for ``token``: back through the gadgets, newest first."""
        while state:  # the first state keeps all arcs
            if self.born[token] >= self.made[state]:
                token = self.left[token]
            elif self.lost[state] == token:
                return False
            else:
                state = self.parent[state]
        return True

    def _move(self, state: int, token: int) -> int:
        """The row of the transition table for (state, token), made and kept: the next state, or -1."""
        if len(self.moves) >= MOVES:
            self.moves.clear()
        to = self.moves[state << 20 | token] = self.leads_to[token] if self.has_arc(state, token) else -1
        return to

    def encode_word(self, word: bytes) -> list[int]:
        """The tokens of one pre-split word."""
        trie, ends, moves = self.trie.get, self.ends, self.moves
        out: list[int] = []
        at, state, n = 0, 0, len(word)
        limit = n  # where the next token ends at the latest
        while at < n:
            node, i, fitting = 0, at, []
            while i < limit:
                node = trie(node << 8 | word[i])
                if node is None:
                    break
                i += 1
                if ends[node] >= 0:
                    fitting.append(ends[node])
            for token in reversed(fitting):
                to = moves.get(state << 20 | token)
                if to is None:
                    to = self._move(state, token)
                if to >= 0:
                    out.append(token)
                    at, state, limit = at + self.length[token], to, n
                    break
            else:  # the token before must be a shorter one
                limit = at - 1
                at -= self.length[out.pop()]
                state = self.leads_to[out[-1]] if out else 0
        return out

    def _word(self, word: str) -> bytes:
        known = self.older.get(word)
        if known is None:
            known = array("I", self.encode_word(word.encode())).tobytes()
        if len(word) <= CACHED_CHARS:
            if len(self.cache) >= CACHE:
                self.cache, self.older = {}, self.cache
            self.cache[word] = known
        return known

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers; special tokens in the text count as such."""
        held = [s for s in self.special if s in text]
        if held:
            parts = re.split("(" + "|".join(sorted(map(re.escape, held), key=len, reverse=True)) + ")", text)
            return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self.encode(p) for p in parts if p)
        known, word = self.cache.get, self._word
        return b"".join([known(w) or word(w) for w in (_ASCII_WORDS if text.isascii() else _WORDS).findall(text)])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_compiled: dict[str, Automaton] = {}


def _automaton(spec: dict, name: str) -> Automaton:
    """One automaton for each Python worker and tokenizer."""
    if name not in _compiled:
        _compiled.clear()
        _compiled[name] = Automaton(spec)
    return _compiled[name]


def _mapper(docs: DataFrame, path: str, make, names: list[str]):
    spec = read_tokenizer(path)  # bounded by the vocabulary
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared.value, path)
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index("text"))
            made = make(automaton, ["" if t is None else t for t in texts.to_pylist()])
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, *names])

    return run


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, ids array<int>, decoded string); a null text is empty and has no ids."""

    def make(automaton: Automaton, texts: list[str]) -> list[pa.Array]:
        encoded = [automaton.encode(t) for t in texts]
        ids = pa.array([np.frombuffer(e, "<i4") for e in encoded], pa.list_(pa.int32()))
        return [ids, pa.array([automaton.decode(e) for e in encoded], pa.string())]

    return docs.select("doc_id", "text").mapInArrow(_mapper(docs, path, make, ["ids", "decoded"]), "doc_id long, ids array<int>, decoded string")


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, then decoded again."""

    def make(automaton: Automaton, texts: list[str]) -> list[pa.Array]:
        encoded = [automaton.encode(t) for t in texts]
        return [
            pa.array([len(e) // 4 for e in encoded], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in encoded], pa.string()),
            pa.array([hashlib.sha256(automaton.decode(e).encode()).hexdigest() for e in encoded], pa.string()),
        ]

    source = docs.select(F.col("doc_id").cast("long"), "text")
    return source.mapInArrow(_mapper(docs, path, make, ["n_tokens", "ids_sha256", "decoded_sha256"]), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
