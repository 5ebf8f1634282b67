from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexifold.llm import bpe

from .fixtures import ROWS, edge, empty, plain

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return bpe.Automaton(bpe.read_tokenizer(PATH)), Tokenizer.from_file(PATH)


def agree(both, text):
    own, library = both
    ids = own.encode(text)
    expected = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == expected
    assert own.decode(ids) == library.decode(expected, skip_special_tokens=False)


@given(st.text(alphabet="abcdehilnorstTHE019 .,'\n\t-_é中😀", max_size=60))
@settings(max_examples=400, deadline=None)
def test_like_the_library(both, text):
    agree(both, text)


def test_long_words_spaces_and_specials(both):
    rng = random.Random(1)
    for text in ["", " ", "a" * 3_000, " " * 400 + "x", "\n\n \n a", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "　\xa0 x", "".join(rng.choice("aehint") for _ in range(5_000))]:
        agree(both, text)


def test_a_small_automaton():
    """(a, a) before (aa, b): runs of a are paired from the left, and no arc follows that BPE would not give."""
    spec = {"labels": {0: b"a", 1: b"b", 2: b"aa", 3: b"aab"}, "bytes": [0, 1], "merges": [(0, 0, 2), (2, 1, 3)], "special": {}}
    own = bpe.Automaton(spec)
    assert own.encode_word(b"aaab") == [2, 0, 1] and own.encode_word(b"aaaab") == [2, 3] and own.encode_word(b"baa") == [1, 2]


def test_documents(spark, both):
    rows = {(r.doc_id, tuple(r.ids)): r.decoded for r in bpe.encode_documents(edge(spark), PATH).collect()}
    for i, t, *_ in ROWS:
        assert rows[i, tuple(both[1].encode(t or "", add_special_tokens=False).ids)] == (t or "")
    assert bpe.encode_documents(empty(spark), PATH).collect() == [] and bpe.encoded_digests(empty(spark), PATH).collect() == []


def test_digests_are_the_library_s(spark, both):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = table.unionByName(edge(spark).select("doc_id", "text"))
    expected = []
    for r in docs.collect():
        ids = both[1].encode(r.text or "", add_special_tokens=False).ids
        decoded = both[1].decode(ids, skip_special_tokens=False)
        expected.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert plain(bpe.encoded_digests(docs, PATH), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=repr)


def test_what_is_kept_moves_no_ids(both, monkeypatch):
    for name in ("MOVES", "CACHE"):
        monkeypatch.setattr(bpe, name, 3)
    small = bpe.Automaton(bpe.read_tokenizer(PATH))
    for text in ("the theater of therapists, then: thermal aaaaaaa", " erreth was ofretihaou the that edouhe"):
        assert small.encode(text) == both[0].encode(text)
    assert len(small.moves) <= 3 and len(small.cache) <= 3


def test_backtracking_against_plain_merging(both):
    """Words in which the longest token is often wrong, against merging pairs by rank."""
    rng = random.Random(4)
    spec = {"labels": {0: b"a", 1: b"b", 2: b"ab", 3: b"ba", 4: b"aba", 5: b"abab", 6: b"bb"}, "bytes": [0, 1], "merges": [(1, 0, 3), (0, 1, 2), (2, 0, 4), (2, 2, 5), (1, 1, 6)], "special": {}}
    own = bpe.Automaton(spec)
    for _ in range(300):
        word = bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 14)))
        ids = [b - 97 for b in word]
        while True:
            pairs = [(r, i) for i in range(len(ids) - 1) for r, (u, v, _) in enumerate(spec["merges"]) if (u, v) == (ids[i], ids[i + 1])]
            if not pairs:
                break
            r, i = min(pairs)
            ids[i : i + 2] = [spec["merges"][r][2]]
        assert own.encode_word(word) == ids
