"""Token files, SentencePiece and the language model, against the libraries and brute force."""

import math
import random
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlink.llm import attention_lm, elias_fano, sp_lattice
from ledgerlink.llm.common import shared_dir
from ledgerlink.llm.queries import op7_sentencepiece
from ledgerlink.llm.sp_lattice import UNKNOWN, Encoding, decode, merge_long, text_of
from ledgerlink.llm.token_shards import encoder, read_token_shards, write_token_shards

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "a  b", "a \nb", "a\n b c", "it's a 'test' <|endoftext|> b", "a\tb c ", "　a", "a \x1f b", "1 2 34  5", "don't  stop", "x.y, z."]


@pytest.mark.parametrize("n", [0, 1, 2, 513, 4000])
def test_elias_fano(n):
    rng = np.random.default_rng(n)
    for spread in (1, 3, 900, 10**9):
        v = np.cumsum(rng.integers(0, spread, n)) - 37 if n else np.zeros(0, np.int64)
        data = elias_fano.encode(v)
        e = elias_fano.EliasFano(data)
        assert (e.select_run(0, n) == v).all() and all(e.select(i) == v[i] for i in range(0, n, 7))
        assert all((e.select_run(i, k) == v[i : i + k]).all() for i in range(0, n, 97) for k in (1, 40, 513))
        if n > 1000:
            assert len(data) * 8 < n * (3 + math.log2(max(2, (v[-1] - v[0]) / n)))
    with pytest.raises(ValueError):
        elias_fano.encode(np.array([2, 1]))


def test_encoder_equals_the_library():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(" ab1'.\n\t é　\x1f\x85,$") for _ in range(rng.randrange(12))) for _ in range(3000)]
    texts += ["".join(rng.choice(["Zürich", "λόγος", "мир", "世界", "ſt", "ª", "½", "****", "'s", "…", "–", ")", "##", " ", " ", "\n"]) for _ in range(rng.randrange(9))) for _ in range(1000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]
    assert encoder(BPE).encode(texts) == want


def test_token_shards_round_trip(spark):
    docs = [(i * 3 % 100, f"text {i} of the corpus. " * (i % 7)) for i in range(100)] + [(200, None), (201, ""), (None, "no id"), (202, "word " * 3000)]
    path = f"{shared_dir(spark)}/shards-test-{uuid.uuid4().hex}"
    write_token_shards(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, ids int"), path, BPE)
    got = {r.doc_id: r for r in read_token_shards(spark, path).collect()}
    tokenizer, at = Tokenizer.from_file(BPE), 0
    for i, t in sorted(d for d in docs if d[0] is not None):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (at, len(ids) // 4, zlib.crc32(ids), ids)
        at += len(ids) // 4
    empty = path + "-empty"
    write_token_shards(spark.createDataFrame([], "doc_id long, text string"), empty, BPE)
    assert read_token_shards(spark, empty).count() == 0


def test_sentencepiece_equals_the_library_and_decodes(spark):
    rng = random.Random(5)
    bits = [" ", "  ", "a", "the", "ing", "\n", "é", "\t", ".", ",", "Hello", "世", "😀", "\x00", "x▁y", "0", "   "]
    docs = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(30)))) for i in range(150)]
    docs += [(900, None), (901, ""), (902, " "), (903, "a" * 300), (904, "thequickbrownfox" * 30), (905, "\n"), (906, " \n a"), (907, "long\n\ntext of lines\n" * 8000), (908, "a\n\n\nb c\n\n"), (909, "x\ty\nz")]
    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    enc = Encoding(spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, unit int"), PIECES)
    ids = enc.documents(decoded=True).cache()
    got = {r.doc_id: list(r.ids) for r in ids.collect()}
    assert got == {i: m.encode(t or "") for i, t in docs}
    back = {r.doc_id: r.t for r in decode(ids, enc.pieces, ["doc_id"]).select("doc_id", text_of(F.col("decoded")).alias("t")).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in docs}
    assert {r.doc_id: r.decoded for r in ids.collect()} == back
    assert {r.doc_id for r in ids.filter("not round_trip").collect()} == {i for i, t in docs if "▁" in (t or "")}


def test_sentencepiece_query_returns_ids_and_compares_whole_texts(spark, tmp_path):
    docs = [(1, "Hello the  world"), (2, None), (3, ""), (4, " a\nb "), (5, "x▁y"), (6, "the world " * 400), (7, "😀\x00é" * 30)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r for r in op7_sentencepiece(spark, str(tmp_path)).collect()}
    assert {i: list(r.ids) for i, r in got.items()} == {i: m.encode(t or "") for i, t in docs}
    assert all(r.n_pieces == len(r.ids) for r in got.values())
    assert {i for i, r in got.items() if not r.round_trip} == {5}  # the sign for a space comes back as a space


def test_unigram_fold_is_the_best_path(spark):
    rng = random.Random(8)
    table = [(i, p, -rng.random() * 9, None) for i, p in enumerate(["a", "b", "ab", "ba", "aba", "▁", "▁a", "bb", "abba", "▁ab"], 300)] + [(b, None, 0.0, b) for b in range(256)]
    score, least = {p: (x, i) for i, p, x, _ in table if p}, min(x for _, p, x, _ in table) - sp_lattice.UNKNOWN_PENALTY
    names = {"".join(rng.choice("ab▁é") for _ in range(rng.randrange(1, 11))) for _ in range(80)} | {"ab" * 40 + "é"}

    def best(u):
        at = [(0.0, [])]
        for e in range(1, len(u) + 1):
            options = [(at[s][0] + score[u[s:e]][0], at[s][1] + [score[u[s:e]][1]]) for s in range(e) if u[s:e] in score]
            if u[e - 1] not in score:
                options.append((at[e - 1][0] + least, at[e - 1][1] + list(u[e - 1].encode())))
            at.append(max(options, key=lambda o: o[0]))  # of equal sums the first
        return at[-1][1]

    pieces = spark.createDataFrame(table, "id int, piece string, score double, byte int")
    parts = sp_lattice.encode_units(spark.createDataFrame([(u, 1) for u in sorted(names)], "unit string, n long"), pieces, 4, 0, unigram=True)
    assert {r.unit: list(r.ids) for part in parts for r in part.collect()} == {u: best(u) for u in names}


def test_units_are_cut_where_no_piece_reaches():
    pairs = frozenset(["▁a", "ab"])
    assert sp_lattice.units_of("ab,ab", pairs) == ["▁ab", ",", "ab"] and sp_lattice.units_of("\nab", pairs) == ["\n", "ab"]
    assert sp_lattice.units_of("", pairs) == ["▁"] and sp_lattice.words_of("") == []
    assert sp_lattice.words_of("a \nb") == ["a", "", "\nb"] and sp_lattice.words_of("a  b") == ["\n\n▁a", "\n\n▁▁b"]


def test_long_units_merge_like_short_ones():
    edges = [{"s": i, "e": i + 1, "rank": 0, "id": 1} for i in range(4)] + [{"s": i, "e": i + 2, "rank": 5, "id": 2} for i in range(3)] + [{"s": 0, "e": 4, "rank": 9, "id": 3}]
    assert merge_long("aaaa", edges, 3) == [3]
    assert merge_long("aé", [{"s": 0, "e": 1, "rank": 0, "id": 7}, {"s": 1, "e": 2, "rank": 0, "id": UNKNOWN}], 3) == [7, 0xC3 + 3, 0xA9 + 3]


def test_attention_gradients_are_right():
    rng = np.random.default_rng(1)
    m = {n: p.astype(np.float64) for n, p in attention_lm.initial(np.full(attention_lm.CLASSES, 1 / attention_lm.CLASSES)).items()}
    windows, _, _ = attention_lm.windows_of([rng.integers(0, attention_lm.CLASSES, n).astype(np.uint8) for n in (7, 60)])
    real = windows[:, attention_lm.FIRST + 1 :] < attention_lm.CLASSES
    loss = lambda: -attention_lm.log_probs(m, windows)[real].mean()
    g = attention_lm.gradients(m, windows)
    for n in attention_lm.NAMES:
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in m[n].shape) if n != "emb" else (windows[0, rng.integers(0, 12)], rng.integers(0, attention_lm.DIM))
            m[n][at] += 1e-4
            up = loss()
            m[n][at] -= 2e-4
            down = loss()
            m[n][at] += 1e-4
            assert abs((up - down) / 2e-4 - g[n][at]) < 1e-5


def test_windows_score_each_token_once():
    m = attention_lm.initial(np.full(attention_lm.CLASSES, 1 / attention_lm.CLASSES))
    m = {n: (p * 0 if n in ("out", "pos") else p) for n, p in m.items()}  # without context, every token costs the same
    lens = [1, 23, 24, 25, 48, 49, 100]
    sequences = [np.arange(n).astype(np.uint8) % attention_lm.CLASSES for n in lens]
    assert np.allclose(attention_lm.sums(m, sequences), [-n * math.log10(attention_lm.CLASSES) for n in lens], atol=1e-3)
    windows, owner, _ = attention_lm.windows_of(sequences)
    targets = windows[:, attention_lm.FIRST + 1 :]
    for i, s in enumerate(sequences):
        assert targets[owner == i].ravel()[: len(s)].tolist() == s.tolist()


def plain_score(lm, text):
    """log10 probability of a text, one token at a time."""
    m, enc = lm.model, encoder(BPE)
    ids = [int(i) for w in attention_lm.split(text.encode()) for i in np.frombuffer(enc.word(w.decode()), np.uint32)]
    classes = [int(lm.subwords.cls[i]) for i in ids] + [attention_lm.END]
    total = sum(float(lm.subwords.inside[i]) for i in ids)
    past = [attention_lm.START] * (attention_lm.FIRST + 1) + classes
    for t, c in enumerate(classes):
        start = t // attention_lm.STRIDE * attention_lm.STRIDE
        x = np.array([m["emb"][k] + m["pos"][j] for j, k in enumerate(past[start : t + attention_lm.FIRST + 1])])
        weights = [math.exp(float(x[-1] @ m["q"] @ (row @ m["k"])) / math.sqrt(attention_lm.DIM)) for row in x]
        mixed = sum(w * (row @ m["v"]) for w, row in zip(weights, x, strict=True)) / sum(weights)
        z = (x[-1] + mixed @ m["o"]) @ m["out"] + m["bias"]
        total += (float(z[c]) - math.log(sum(math.exp(float(v)) for v in z))) / math.log(10)
    return total


def test_language_model(spark):
    rng = random.Random(3)
    tongues = [["sun", "sea", "sand", "sky"], ["rock", "rain", "road", "roof"]]
    docs = [(i, " ".join(rng.choice(tongues[i % 2]) for _ in range(60)) + f" Once{i}") for i in range(400)] + [(900, None), (901, ""), (902, "sea " * 5000)]
    training = F.col("doc_id") % 10 != 0
    got = {r.doc_id: r for r in attention_lm.score_documents(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, train int"), BPE, training).collect()}
    count = Counter()
    for i, t in docs:
        if i % 10:
            count.update([*(t or "").lower().split(), None])
    n, v = sum(count.values()), len(count)
    for i, t in docs:
        words = [*(t or "").lower().split(), None]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(count[w] > 0 for w in words), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
    assert attention_lm.score_documents(spark.createDataFrame([], "doc_id long, text string"), BPE, training).count() == 0


def test_language_model_scores_are_those_of_a_plain_loop(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["sun", "Sea", "sand,", "überall", "世界", "unbelievable", "x\x00y"]) for _ in range(rng.choice([0, 1, 5, 40, 200])))) for i in range(80)]
    lm = attention_lm.LanguageModel(spark.createDataFrame(docs, "doc_id long, text string"), BPE, F.col("doc_id") % 10 != 0)
    got = {r.doc_id: r.score for r in lm.scores().collect()}
    for i, t in docs[:40]:
        want = plain_score(lm, t)
        assert abs(got[i] - want) < 1e-3 * max(1, abs(want))
    of = lm.subwords
    inside = np.bincount(of.cls, 10.0**of.inside, attention_lm.CLASSES)
    assert np.allclose(inside[1:], 1) and inside[attention_lm.END] == 0 and len(of.cls) == encoder(BPE).size  # all ids that may follow sum to one
    longer, start = 0.0, np.array([5, 9, 40], np.uint8)
    for c in range(attention_lm.CLASSES):
        longer += 10 ** float(attention_lm.sums(lm.model, [np.append(start, np.uint8(c))])[0])
    assert abs(longer / 10 ** float(attention_lm.sums(lm.model, [start])[0]) - 1) < 1e-4
    # the model knows the order of what it was trained on better than the counts do
    zero = {**lm.model, "out": lm.model["out"] * 0, "bias": np.log(of.prior)}
    seen = [np.frombuffer(r.classes, np.uint8) for r in lm.documents.filter("train and classes is not null").collect()]
    assert attention_lm.sums(lm.model, seen).sum() > attention_lm.sums(zero, seen).sum()


def test_language_model_counts_words_with_zeros(spark):
    docs = [(1, "sun \x00123 \x00123"), (123, "sun moon"), (10, "\x00123 never")]
    got = {r.doc_id: r for r in attention_lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), BPE, F.col("doc_id") % 10 != 0).collect()}
    n, v = 7, 4
    p = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    assert {i: (r.n_tokens, r.n_known) for i, r in got.items()} == {1: (4, 4), 123: (3, 3), 10: (3, 2)}
    assert abs(got[123].base_score - (p(2) + p(1) + p(2))) < 1e-9 and abs(got[10].base_score - (p(2) + p(0) + p(2))) < 1e-9


def test_attention_trains_on_every_window_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    fit = attention_lm.Trainer.fit

    def trainer(now, turn):
        def counting(self, windows, r):
            seen.add(len(windows))
            fit(self, windows, r)

        inner = given(now, turn)

        def train(batches):
            attention_lm.Trainer.fit = counting
            yield from inner(batches)
            attention_lm.Trainer.fit = fit

        return train

    given = attention_lm._trainer
    monkeypatch.setattr(attention_lm, "_trainer", trainer)
    docs = [(i, "the same words in a copy " * 20) for i in range(50)] + [(90, None), (91, "a " * 23), (92, "a " * 24)]
    lm = attention_lm.LanguageModel(spark.createDataFrame(docs, "doc_id long, text string"), BPE, F.lit(True))
    assert lm.n == 50 * 121 + 1 + 24 + 25
    assert seen.value == 50 * 6 + 1 + 1 + 2


def small_tree(rng, size=200):
    counts = rng.integers(0, 50, size)
    return attention_lm.Tree(attention_lm.Subwords(counts, rng.integers(0, 2, size).astype(bool), 3).cls, counts)


def test_ids_have_gradients_and_sum_to_one():
    rng = np.random.default_rng(1)
    tree = small_tree(rng)
    m = {n: p.astype(np.float64) for n, p in (attention_lm.initial(np.full(attention_lm.CLASSES, 1 / attention_lm.CLASSES)) | tree.tables()).items()}
    m |= {n: rng.standard_normal(m[n].shape) * 0.3 for n in attention_lm.TABLES} | {"tree": tree}
    windows, _, _ = attention_lm.windows_of([rng.integers(0, tree.end + 1, n) for n in (7, 60)], tree.begin, tree.pad, tree.kind)
    real = windows[:, attention_lm.FIRST + 1 :] <= tree.end
    loss = lambda: -attention_lm.log_probs(m, windows)[real].mean()
    g = attention_lm.gradients(m, windows)
    for n in (*attention_lm.NAMES, *attention_lm.TABLES):
        for _ in range(4):
            k = rng.integers(0, len(g[n][0])) if n in attention_lm.TABLES else None
            at = tuple(rng.integers(0, s) for s in m[n].shape) if k is None else (g[n][0][k], rng.integers(0, attention_lm.DIM))
            given = g[n][at] if k is None else g[n][1][k, at[1]]
            m[n][at] += 1e-4
            up = loss()
            m[n][at] -= 2e-4
            down = loss()
            m[n][at] += 1e-4
            assert abs((up - down) / 2e-4 - given) < 1e-5
    past = rng.integers(0, tree.end, 40)
    longer = sum(10 ** float(attention_lm.sums(m, [np.append(past, i)])[0]) for i in range(tree.end + 1))
    assert abs(longer / 10 ** float(attention_lm.sums(m, [past])[0]) - 1) < 1e-4


def test_scores_know_which_id_of_a_class_follows(spark):
    rng = random.Random(5)
    many = [w for w in (f"{a}{b}" for a in ("sun", "sea", "rock", "rain", "road", "moon", "fire", "wind") for b in ("", "s", "y", "ed", "er", "ing", "light", "side", "man", "way"))]
    follow = dict(zip(many, rng.sample(many, len(many)), strict=True))

    def text(real: bool) -> str:
        out = []
        for _ in range(30):
            w = rng.choice(many)
            out += [w, follow[w] if real else follow[rng.choice(many)]]
        return " ".join(out)

    docs = [(i, text(i % 20 != 10)) for i in range(3000)]  # those of i % 10 == 0 are held out, every second one with other pairs
    frame, training = spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id") % 10 != 0
    got = {r.doc_id: r for r in attention_lm.score_documents(frame, BPE, training).collect()}
    classes = {r.doc_id: r for r in attention_lm.LanguageModel(frame, BPE, training).scores().collect()}
    mean = lambda of, k: sum(of[i].score for i, _ in docs if i % 20 == k) / 150
    assert mean(got, 0) > mean(got, 10) + 5 and mean(got, 0) > mean(classes, 0) + 5


def test_a_shard_becomes_ids_in_slices(spark, monkeypatch):
    monkeypatch.setattr("ledgerlink.llm.sp_lattice.SLICE_BYTES", 300)
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice(["sun", "  two", "überall", "世界", "x\n", "unbelievable", "\U0001f600", f"w{i}"]) for _ in range(rng.choice([0, 1, 5, 40, 200])))) for i in range(60)] + [(90, None)]
    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r.ids for r in Encoding(spark.createDataFrame(docs, "doc_id long, text string"), public_tokenizers.path("piece_bpe_32k.model")).documents().collect()}
    assert got == {i: m.encode(t or "") for i, t in docs}
