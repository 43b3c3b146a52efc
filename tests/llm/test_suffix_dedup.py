"""Removal of repeated byte strings, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from ledgerlink.llm import suffix_dedup
from ledgerlink.llm.suffix_dedup import LENGTH, remove_substrings, suffix_order


def brute(rows):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[k : k + LENGTH] for t in texts for k in range(len(t) - LENGTH + 1))
    out = Counter()
    for (i, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - LENGTH + 1):
            if seen[t[k : k + LENGTH]] > 1:
                gone[k : k + LENGTH] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int)))))
        out[i, len(t), int(gone.sum()), tuple(edge.tolist()), bytes(b for b, g in zip(t, gone) if not g)] += 1
    return out


def result(spark, rows, parts=3):
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, id int, shard int, segment int").repartition(parts)
    return Counter((r.doc_id, r.n_bytes, r.n_removed, tuple(x for s in r.spans for x in s), bytes(r.kept)) for r in remove_substrings(df).collect())


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "été", "of", "x", "naïve", "longer-word", "日本", "\x00", "\n", "a", "b"]
    text = lambda k: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(k))
    hot, short, near = text(45), text(24), text(200).split()
    rows = []
    for i in range(n):
        t = text(rng.choice([3, 30, 90]))
        kind = rng.randrange(7)
        if kind == 0:
            t = t + hot + text(rng.choice([0, 5, 40]))
        elif kind == 1:
            t = text(rng.choice([0, 9])) + short + t
        elif kind == 2:  # near copies with random edits
            w = list(near)
            for _ in range(rng.choice([0, 1, 5])):
                w[rng.randrange(len(w))] = text(1)
            t = " ".join(w)
        elif kind == 3 and rows:
            t = rng.choice(rows)[1]
        elif kind == 4 and rows:
            other = rng.choice(rows)[1] or ""
            at = rng.randrange(len(other) + 1)
            t = t[: rng.randrange(60)] + other[at : at + rng.randrange(100, 400)] + t
        rows.append((i, t))
    rows += [(n, None), (n + 1, ""), (n + 2, "ab" * 700), (n + 3, "a" * 900), (n + 4, text(1)[0] * 199), (5, rows[5][1]), (None, hot), (None, "q" * 200), (n + 5, "z" * 200)]
    return rows


@pytest.mark.parametrize("seed, piece, crowded, bucket", [(1, 1 << 15, 2000, 20000), (2, 64, 4, 40), (3, 500, 1, 7)])
def test_equals_brute_force(spark, monkeypatch, seed, piece, crowded, bucket):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 20_000)
    rows = corpus(seed, 120)
    assert result(spark, rows) == brute(rows)


def test_small_tables(spark):
    assert result(spark, []) == Counter() and result(spark, [(1, None)]) == Counter({(1, 0, 0, (), b""): 1})
    rows = [(1, "x" * 201), (2, "y" * 201 + "z"), (3, "w" * 5000)]
    assert result(spark, rows) == brute(rows)


def test_suffix_order_is_the_order_of_bytes():
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randrange(40))) for _ in range(300)]
    size = np.array([len(t) for t in texts])
    order, common = suffix_order(np.frombuffer(b"".join(texts) + bytes(8), np.uint8), np.cumsum(size) - size, size, 40)
    padded = [t.ljust(40, b"\0") for t in texts]
    assert [padded[k] for k in order] == sorted(padded)
    for k in range(1, len(order)):
        a, b = padded[order[k - 1]], padded[order[k]]
        assert common[k] == next((n for n in range(40) if a[n] != b[n]), 40)
