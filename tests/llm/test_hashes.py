"""Hashes of words, units and runs, on strings that linear hashes cannot tell apart."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from ledgerlink.llm import attention_lm, near_copies, repeats, sp_lattice
from ledgerlink.llm.word_hashes import Rolling, hashed_runs, word_hashes


def complements(n, a="a", b="b"):
    """Two strings of n letters that any polynomial with an odd base hashes alike modulo 2 ** 64."""
    odd = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(b if x else a for x in odd), "".join(a if x else b for x in odd)


def test_words_of_every_length_have_their_own_hash():
    rng = random.Random(1)
    words = {bytes(rng.choice(b"ab\x00\xff") for _ in range(n)) for n in range(1, 80) for _ in range(60)}
    words |= {s.encode() for n in (8, 16, 32, 64, 1024, 2048) for s in complements(n)}
    words = [w for w in words if not set(w) & set(b" \t\n\v\f\r")]
    for kind in (0, 1):
        found = np.concatenate(word_hashes([b" ".join(words), words[0], b""], kind))
        assert len(set(found[: len(words)].tolist())) == len(words) and found[len(words)] == found[0]
    assert not set(word_hashes([b" ".join(words)], 0)[0].tolist()) & set(word_hashes([b" ".join(words)], 1)[0].tolist())


def test_runs_of_alternating_words_differ():
    for n in (4, 8, 16, 64):
        x, y = (word_hashes([" ".join(s).encode()])[0] for s in complements(n))
        assert Rolling(x).at(n)[0] != Rolling(y).at(n)[0]
        both = np.concatenate((x, y))
        for size in (1, 2, 3, 5, n):
            runs = [tuple(both[k : k + size].tolist()) for k in range(len(both) - size + 1)]
            assert len(set(Rolling(both).at(size).tolist())) == len(set(runs))


def test_units_beyond_two_bytes_differ():
    points = np.array([ord(c) for c in "a\U0001f600b\U0001f601ab\U0001f600"], np.uint32)
    begin = np.array([0, 2, 4, 6])
    assert len(set(sp_lattice._hashes(points, begin, np.array([2, 4, 6, 7])).tolist())) == 4
    assert hashed_runs(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


@pytest.mark.parametrize("n", [1024, 2048])
def test_operators_tell_complementary_words_apart(spark, n):
    x, y = complements(n)
    common = " ".join(f"w{i}" for i in range(10))
    rows = [(1, f"{common} {x} {common}"), (2, f"{common} {y} {common}"), (3, f"{x} one two three four five"), (4, f"{y} one two three four five"), (5, x), (6, y)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in repeats.remove_repeats(docs).collect()} == dict.fromkeys(range(1, 7), 0)
    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in sp_lattice.Encoding(docs, public_tokenizers.path("piece_bpe_32k.model")).documents().collect():
        assert r.round_trip and list(r.ids) == m.encode(rows[r.doc_id - 1][1])
    known = {r.doc_id: r.n_known for r in attention_lm.score_documents(docs.filter("doc_id > 4"), public_tokenizers.path("byte_bpe_50k.json"), F.col("doc_id") == 5).collect()}
    assert known == {5: 2, 6: 1}  # the end of a text is known to all
    assert near_copies.near_copies(docs.filter("doc_id > 4")).count() == 0
