"""Language-model scores of documents: causal self-attention over subword ids.

A text is the sequence of the subword ids of its words (a public tokenizer's, each word with a space before
it) and one end. The model's probability of an id is that of its class given the ids before it, times that of
the id in its class, given them too. Classes part the whole vocabulary: the end, the SINGLE most common ids, and
groups of about equal weight for ids that begin a word and for others. A single-head causal self-attention model
in numpy reads the ids, each by a vector of its own and its class's, in overlapping windows: each token is scored
once, with at least WINDOW - STRIDE tokens before it (or the start). Its state gives the class by a softmax, and
the id by the turns in a Huffman tree of the class (Tree), whose nodes have learnt vectors and start from the
counts; so the probabilities of all ids that may follow sum to one. LanguageModel is the model over classes alone,
with ids in a class by their counts; SubwordModel is the whole one.

Attention weights are learnt by rounds of parameter averaging: each round takes its share of the windows of all
training documents, every partition trains its own copy, and their mean goes on; vectors of ids and nodes are
averaged over the copies that met them, by how often. Over all rounds every window of every training document is used once. Counts cover every training document. Only the FREQUENT most common words are
sent to workers, for the base score; all others are joined.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .token_shards import encoder
from .word_hashes import places, word_blocks, word_hashes

DIM, WINDOW, STRIDE = 16, 32, 24
SINGLE, GROUPS = 31, 16
CLASSES = 1 + SINGLE + 2 * GROUPS
END, START, PAD = 0, CLASSES, CLASSES + 1
FIRST = WINDOW - STRIDE
FREQUENT = 600_000
#: Words whose ids a worker keeps.
CACHE_WORDS = 400_000
#: The rate of each round; as many rounds as rates.
RATES = (4e-3, 2e-3, 1e-3, 5e-4)
#: Windows of a training step, and windows that are shuffled together.
BATCH, CHUNK = 64, 16_384
#: Documents, and windows, that are scored at a time.
DOCUMENTS, WINDOWS = 256, 128
MASK = np.tril(np.ones((WINDOW, WINDOW), np.float32))[FIRST:]
ONES = np.ones((max(WINDOW, CLASSES), 1), np.float32)
NAMES = ("emb", "pos", "q", "k", "v", "o", "out", "bias")
#: Tables with a row for each id and for each node; what a round's rate is multiplied by for them; rows of a table that are averaged together.
TABLES, ROW_RATE, ROWS = ("ide", "node"), 30, 1024


def split(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # bytes: only A-Z are lowered, only [\x20\x09-\x0D] split


# the attention model


def initial(prior: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    w = lambda *shape: (r.standard_normal(shape) / math.sqrt(shape[-1])).astype(np.float32)
    return {"emb": w(CLASSES + 2, DIM), "pos": w(WINDOW, DIM) * 0.1, "q": w(DIM, DIM), "k": w(DIM, DIM), "v": w(DIM, DIM), "o": w(DIM, DIM), "out": w(DIM, CLASSES) * 0.1, "bias": np.log(prior).astype(np.float32)}


class Tree:
    """Ids as paths of turns in the Huffman tree of their class; the codes after the ids stand for END, START and PAD.

    A turn at a node is taken with the logistic of sign * (state * the node's vector + bias); the bias is that of the counts.
    """

    def __init__(self, cls: np.ndarray, counts: np.ndarray):
        size = len(cls)
        self.cls = np.concatenate((cls, [END, START, PAD])).astype(np.uint8)
        self.end, self.begin, self.pad = size, size + 1, size + 2
        self.kind = np.uint16 if size + 3 <= 1 << 16 else np.uint32
        up, sign, bias = [-1] * size, [0] * size, []
        for k in range(1, CLASSES):
            heap = [(float(counts[i]) + 0.1, i) for i in np.flatnonzero(cls == k).tolist()]
            heapq.heapify(heap)
            while len(heap) > 1:
                (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
                up[left], up[right], sign[left], sign[right] = (len(bias),) * 2 + (1, -1)
                heapq.heappush(heap, (a + b, size + len(bias)))
                up.append(-1)
                sign.append(0)
                bias.append(math.log(a / b))
        up, sign = np.array(up, np.int64), np.array(sign, np.float32)
        leaves = [np.zeros(0, np.int64)]
        nodes, signs = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        leaf = at = np.flatnonzero(up[:size] >= 0)
        while len(at):
            leaves.append(leaf)
            nodes.append(up[at])
            signs.append(sign[at])
            at = size + up[at]
            more = up[at] >= 0
            leaf, at = leaf[more], at[more]
        leaf = np.concatenate(leaves)
        order = np.argsort(leaf, kind="stable")
        self.nodes, self.signs = np.concatenate(nodes)[order].astype(np.int32), np.concatenate(signs)[order]
        self.bias = np.array(bias, np.float32)
        self.count = np.bincount(leaf, minlength=size + 3)
        self.start = np.cumsum(self.count) - self.count

    def turns(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every turn: whose it is, its node and its sign."""
        n = self.count[codes]
        at = places(self.start[codes], n)
        return np.repeat(np.arange(len(codes)), n), self.nodes[at], self.signs[at]

    def tables(self) -> dict[str, np.ndarray]:
        return {"ide": np.zeros((self.pad + 1, DIM), np.float32), "node": np.zeros((len(self.bias), DIM), np.float32)}


def by_row(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows, the sum of the values of each, and how many there are."""
    order = np.argsort(at, kind="stable")
    rows, first, many = np.unique(at[order], return_index=True, return_counts=True)
    return rows, np.add.reduceat(values[order], first, axis=0) if len(rows) else values, many


def windows_of(sequences: list[np.ndarray], start: int = START, pad: int = PAD, kind=np.uint8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of WINDOW + 1 classes or codes, of which the last STRIDE are targets; the sequence of each, and its number there.

    A sequence has FIRST + 1 starts before it and is filled up with PAD; every place of it is a target once.
    """
    lens = np.array([len(s) for s in sequences], np.int64)
    many = -(-lens // STRIDE)
    size = many * STRIDE + FIRST + 1
    begin = np.cumsum(size) - size
    flat = np.full(int(size.sum()), pad, kind)
    for b, s in zip(begin.tolist(), sequences, strict=True):
        flat[b : b + FIRST + 1] = start
        flat[b + FIRST + 1 : b + FIRST + 1 + len(s)] = s
    owner = np.repeat(np.arange(len(sequences)), many)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    if not len(owner):
        return np.zeros((0, WINDOW + 1), kind), owner, nth
    return np.lib.stride_tricks.sliding_window_view(flat, WINDOW + 1)[begin[owner] + nth * STRIDE], owner, nth


def flat(t: np.ndarray) -> np.ndarray:
    return t.reshape(-1, t.shape[-1])


def forward(m: dict[str, np.ndarray], inputs: np.ndarray, codes: np.ndarray | None = None):
    """Scores of the classes at the last STRIDE places of each window, and what backward needs; codes are those of the ids, if they count.

    All products with weights are those of two matrices, and keys and values are made by one. Exponents are
    bounded from above, so that they need no shift; masked weights are zero.
    """
    n = len(inputs)
    x = m["emb"][inputs]
    x += m["pos"]
    if codes is not None:
        x += m["ide"][codes]
    xq = x[:, FIRST:].reshape(-1, DIM)
    q = (xq @ (m["q"] * m["q"].dtype.type(1 / math.sqrt(DIM)))).reshape(n, STRIDE, DIM)
    kv = (flat(x) @ np.concatenate((m["k"], m["v"]), axis=1)).reshape(n, WINDOW, 2 * DIM)
    k, v = kv[:, :, :DIM], kv[:, :, DIM:]
    a = q @ k.transpose(0, 2, 1)
    np.minimum(a, 60, out=a)
    np.exp(a, out=a)
    a *= MASK
    norm = flat(a) @ ONES[:WINDOW].astype(a.dtype)
    c = flat(a @ v)
    c /= norm
    h = c @ m["o"]
    h += xq
    z = h @ m["out"]
    z += m["bias"]
    np.minimum(z, 60, out=z)
    return x, xq, q, k, v, a, norm, c, h, z


def log_probs(m: dict[str, np.ndarray], windows: np.ndarray) -> np.ndarray:
    """Natural log-probability of the targets of each window."""
    codes, tree = windows, m.get("tree")
    windows = windows if tree is None else tree.cls[codes]
    *_, h, z = forward(m, windows[:, :-1], None if tree is None else codes[:, :-1])
    hit = z[np.arange(len(z)), np.minimum(windows[:, FIRST + 1 :], CLASSES - 1).ravel()]
    np.exp(z, out=z)
    out = hit - np.log(z @ ONES[:CLASSES].astype(z.dtype))[:, 0]
    if tree is not None:
        out -= inside(m, h, codes[:, FIRST + 1 :].ravel())
    return out.reshape(len(windows), STRIDE)


def turned(m: dict, h: np.ndarray, codes: np.ndarray):
    """Of every turn on the ways to these codes: whose it is, its node and sign, its state and vector, and its sign * score."""
    whose, nodes, signs = m["tree"].turns(codes)
    state, v = h[whose], m["node"][nodes]
    t = np.einsum("ij,ij->i", state, v)
    t += m["tree"].bias[nodes]
    t *= signs
    np.clip(t, -60, 60, out=t)
    return whose, nodes, signs, state, v, t


def inside(m: dict, h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Negative natural log-probability of the codes in their classes."""
    whose, *_, t = turned(m, h, codes)
    np.negative(t, out=t)
    np.exp(t, out=t)
    return np.bincount(whose, np.log1p(t), len(codes))


def gradients(m: dict[str, np.ndarray], windows: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean negative log-probability of the targets that are not PAD; of tables: rows, gradients, occurrences."""
    codes, tree = windows, m.get("tree")
    windows = windows if tree is None else tree.cls[codes]
    inputs, targets = windows[:, :-1], windows[:, FIRST + 1 :].ravel()
    x, xq, q, k, v, a, norm, c, h, z = forward(m, inputs, None if tree is None else codes[:, :-1])
    n, kind = len(inputs), z.dtype
    np.exp(z, out=z)
    real = targets < CLASSES
    weight = (real / max(1, int(real.sum()))).astype(kind)[:, None]
    z *= weight / (z @ ONES[:CLASSES].astype(kind))
    z[np.arange(len(z)), np.minimum(targets, CLASSES - 1)] -= weight[:, 0]
    g = {"out": h.T @ z, "bias": np.ones(len(z), kind) @ z}
    dh = z @ m["out"].T
    if tree is not None:
        whose, nodes, signs, state, vectors, t = turned(m, h, codes[:, FIRST + 1 :].ravel())
        dt = (-signs / (1 + np.exp(t)) * weight[whose, 0]).astype(kind)[:, None]
        if len(whose):
            first = np.flatnonzero(np.concatenate(([True], whose[1:] != whose[:-1])))
            vectors *= dt
            dh[whose[first]] += np.add.reduceat(vectors, first, axis=0)
        state *= dt
        g["node"] = by_row(nodes, state)
    g["o"] = c.T @ dh
    dc = dh @ m["o"].T
    flat(a)[:] /= norm
    of_v = np.einsum("ij,ij->i", dc, c).reshape(n, STRIDE, 1)
    dc = dc.reshape(n, STRIDE, DIM)
    ds = dc @ v.transpose(0, 2, 1)
    ds -= of_v
    ds *= a
    scale = kind.type(1 / math.sqrt(DIM))
    dq = flat(ds @ k)
    dq *= scale
    dkv = np.empty((n, WINDOW, 2 * DIM), kind)
    np.matmul(ds.transpose(0, 2, 1), q, out=dkv[:, :, :DIM])
    np.matmul(a.transpose(0, 2, 1), dc, out=dkv[:, :, DIM:])
    both = flat(x).T @ flat(dkv)
    g |= {"q": xq.T @ dq, "k": both[:, :DIM], "v": both[:, DIM:]}
    dx = (flat(dkv) @ np.concatenate((m["k"], m["v"]), axis=1).T).reshape(n, WINDOW, DIM)
    dh += dq @ m["q"].T
    dx[:, FIRST:] += dh.reshape(n, STRIDE, DIM)
    g["pos"] = (np.ones(n, kind) @ dx.reshape(n, -1)).reshape(WINDOW, DIM)
    order = np.argsort(inputs.ravel(), kind="stable")
    classes, first = np.unique(inputs.ravel()[order], return_index=True)
    g["emb"] = np.zeros_like(m["emb"])
    g["emb"][classes] = np.add.reduceat(flat(dx)[order], first, axis=0)
    if tree is not None:
        g["ide"] = by_row(codes[:, :-1].ravel(), flat(dx))
    return g


class Trainer:
    """Adam over batches of windows; tables by Adagrad, with one step size for each row that a batch meets."""

    def __init__(self, m: dict[str, np.ndarray], rate: float):
        self.m, self.rate, self.step = {n: p if n == "tree" else p.copy() for n, p in m.items()}, rate, 0
        self.s1, self.s2 = ({n: np.zeros_like(m[n]) for n in NAMES} for _ in range(2))
        self.s3, self.met = ({n: np.zeros(len(m[n]), t) for n in TABLES if n in m} for t in (np.float32, np.int64))

    def fit(self, windows: np.ndarray, r: np.random.Generator) -> None:
        """One pass over the windows, in random order."""
        for at in np.array_split(r.permutation(len(windows)), max(1, round(len(windows) / BATCH))):
            g = gradients(self.m, windows[at])
            self.step += 1
            for n in NAMES:
                self.s1[n] += (g[n] - self.s1[n]) * np.float32(0.1)
                self.s2[n] += (g[n] ** 2 - self.s2[n]) * np.float32(0.01)
                self.m[n] -= np.float32(self.rate / (1 - 0.9**self.step)) * self.s1[n] / (np.sqrt(self.s2[n] / np.float32(1 - 0.99**self.step)) + np.float32(1e-8))
            for n in self.s3:
                rows, d, many = g[n]
                self.met[n][rows] += many
                self.s3[n][rows] += np.einsum("ij,ij->i", d, d) / np.float32(DIM)
                self.m[n][rows] -= np.float32(ROW_RATE * self.rate) * d / (np.sqrt(self.s3[n][rows]) + np.float32(1e-12))[:, None]


def vector(m: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([m[n].ravel() for n in NAMES])


def unvector(p: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    ends = np.cumsum([like[n].size for n in NAMES])
    return {n: p[e - like[n].size : e].reshape(like[n].shape).astype(np.float32) for n, e in zip(NAMES, ends, strict=True)}


def sums(m: dict[str, np.ndarray], sequences: list[np.ndarray]) -> np.ndarray:
    """Sums of log10 class probabilities of sequences, their windows batched."""
    out = np.zeros(len(sequences))
    tree = m.get("tree")
    windows, owner, _ = windows_of(sequences) if tree is None else windows_of(sequences, tree.begin, tree.pad, tree.kind)
    last = CLASSES - 1 if tree is None else tree.end
    for at in range(0, len(windows), WINDOWS):
        w = windows[at : at + WINDOWS]
        out += np.bincount(owner[at : at + WINDOWS], (log_probs(m, w) * (w[:, FIRST + 1 :] <= last)).sum(axis=1), len(out))
    return out / math.log(10)


# the vocabulary


class Subwords:
    """The class of every id of the vocabulary, and the log10 of its share in its class."""

    def __init__(self, counts: np.ndarray, begins: np.ndarray, ends: int):
        c = counts + 0.1
        order = np.lexsort((np.arange(len(c)), -counts))
        self.cls = np.zeros(len(c), np.uint8)
        self.cls[order[:SINGLE]] = np.arange(1, 1 + min(SINGLE, len(c)))
        for kind in (0, 1):
            ids = order[SINGLE:][begins[order[SINGLE:]] == kind]
            share = np.cumsum(c[ids]) - c[ids]
            self.cls[ids] = 1 + SINGLE + kind * GROUPS + np.minimum(GROUPS - 1, share * GROUPS / max(1e-9, c[ids].sum())).astype(int)
        self.code, self.end = self.cls, bytes([END])  # what stands for an id, and for the end, in a document
        size = np.bincount(self.cls, c, CLASSES)
        self.counts, self.inside = counts, np.log10(c / size[self.cls])
        size[END] = ends
        self.prior = (size + 1) / (size.sum() + CLASSES)


class RareWords(dict):
    """The number of ids of words (bytes), their codes, and the sum of their shares."""

    def __init__(self, path: str, subwords: Subwords):
        self.encoder, self.code, self.inside = encoder(path), subwords.code, subwords.inside

    def __missing__(self, word: bytes) -> tuple[int, bytes, float]:
        if len(self) > CACHE_WORDS:
            self.clear()
        ids = np.frombuffer(self.encoder.word(word.decode("utf-8", "replace")), np.uint32)
        found = self[word] = len(ids), self.code[ids].tobytes(), float(self.inside[ids].sum())
        return found


class Frequent:
    """The frequent words by their 64-bit hash and length: log10 base probability, codes and shares of their ids."""

    def __init__(self, words: list[bytes], ids: list[bytes], base: np.ndarray, subwords: Subwords):
        h = word_hashes([b" ".join(words)])[0]
        order = np.argsort(h)
        self.hashes = np.append(h[order], np.uint64(0xFFFFFFFFFFFFFFFF))
        self.bucket = np.searchsorted(self.hashes[:-1], np.arange(1 << 20, dtype=np.uint64) << np.uint64(44)).astype(np.int32)
        number = np.append(order, len(words))  # the last one stands for all words that are not found
        self.size = np.array([*map(len, words), 0], np.int32)[number]
        self.base = np.append(base, 0.0)[number]
        lens = np.array([*map(len, ids), 0], np.int64) // 4
        self.count, self.start = lens[number], (np.cumsum(lens) - lens)[number]
        flat_ids = np.frombuffer(b"".join(ids), np.uint32)
        self.flat = subwords.code[flat_ids]
        sums_of = np.append(0.0, np.cumsum(subwords.inside[flat_ids]))
        self.inside = sums_of[self.start + self.count] - sums_of[self.start]

    def find(self, h: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each word, or -1."""
        at = self.bucket[h >> np.uint64(44)].astype(np.int64)
        found, left = np.full(len(h), -1, np.int64), np.arange(len(h))
        while len(left):
            q = at[left]
            there, wanted = self.hashes[q], h[left]
            hit = (there == wanted) & (self.size[q] == size[left])
            found[left[hit]] = q[hit]
            left = left[~hit & (there < wanted)]
            at[left] += 1
        return found


# the corpus

DOCUMENT = pa.schema([("id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("inside", pa.float64()), ("classes", pa.binary()), ("word", pa.binary()), ("tf", pa.int64())])


class LanguageModel:
    def __init__(self, docs: DataFrame, tokenizer: str, training: Column, id_col: str = "doc_id", text_col: str = "text"):
        self.id_col, self.tokenizer = id_col, tokenizer
        self.docs = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), training.alias("train"))
        self.words = written(self._counted(), "lm-words")
        totals = self.words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
        self.ends = self.docs.filter("train").count()
        self.n, self.v = totals[0] + self.ends, totals[1] + (self.ends > 0)
        self._code(self._subwords())
        self._frequent()
        self.documents = written(self._documents(), "lm-documents", compression="zstd")
        self._attention()

    def _code(self, subwords: Subwords) -> None:
        self.subwords = subwords

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1)))

    def _counted(self) -> DataFrame:
        """(word, c): occurrences in training documents."""

        def of(batches):
            for b in batches:
                seen: Counter = Counter()
                for text in b.column(0).cast(pa.binary()).to_pylist():
                    seen.update(split(text))
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        return self.docs.filter("train").select("text").mapInArrow(of, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))

    def _subwords(self) -> Subwords:
        path = self.tokenizer
        size = encoder(path).size
        begins = encoder(path).begins

        def of(batches):
            enc, n = encoder(path), np.zeros(size, np.int64)
            for b in batches:
                ids = [np.frombuffer(enc.word(w.decode("utf-8", "replace")), np.uint32) for w in b.column(0).to_pylist()]
                c = np.repeat(b.column(1).to_numpy(), [len(i) for i in ids])
                np.add.at(n, np.concatenate(ids) if ids else np.zeros(0, np.uint32), c)
            yield pa.RecordBatch.from_pydict({"i": np.flatnonzero(n), "n": n[n > 0]})

        counts = np.zeros(size, np.int64)
        for r in self.words.mapInArrow(of, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
            counts[r.i] = r.n
        return Subwords(counts, begins, self.ends)

    def _frequent(self) -> None:
        """At most FREQUENT words: those whose counts lie above a step of 2 ** (1 / 8), from the number of words at each step."""
        step = F.floor(8 * F.log2(F.col("c")))
        left, least = FREQUENT, None
        for r in self.words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect():  # a few hundred steps
            left -= r.words
            if left < 0:
                break
            least = r.step
        self.common = step >= least if least is not None else F.lit(False)
        path = self.tokenizer

        def of(batches):
            enc = encoder(path)
            for b in batches:
                ids = [enc.word(w.decode("utf-8", "replace")) for w in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.binary())], ["word", "c", "ids"])

        found = self.words.filter(self.common).mapInArrow(of, "word binary, c long, ids binary").toArrow()  # at most FREQUENT rows
        self.frequent = Frequent(found.column("word").to_pylist(), found.column("ids").to_pylist(), self.base(found.column("c").to_numpy()), self.subwords)

    def _documents(self) -> DataFrame:
        """Per document what its words add up to, and its classes; and rows (id, word, tf) of words that are not frequent."""
        shared = self.docs.sparkSession.sparkContext.broadcast((self.frequent, self.subwords))
        path, ends, end_base = self.tokenizer, self.ends, float(self.base(np.array([self.ends]))[0])

        def of(batches):
            frequent, subwords = shared.value
            rare_words = RareWords(path, subwords)
            for b in (b.slice(at, DOCUMENTS) for b in batches for at in range(0, b.num_rows, DOCUMENTS)):
                texts = [(t or b"").lower() for t in b.column(2).cast(pa.binary()).to_pylist()]
                docs = [[i, train, 1, int(ends > 0), end_base, 0.0, [], None, None] for i, train in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
                rare: list[Counter] = [Counter() for _ in docs]
                for first, data, h, begin, end, cuts in word_blocks(texts):
                    number = frequent.find(h, end - begin)
                    odd = np.flatnonzero(number < 0)
                    words = [data[a:z] for a, z in zip(begin[odd].tolist(), end[odd].tolist(), strict=True)]
                    found = [rare_words[w] for w in words]
                    count, inside = frequent.count[number], frequent.inside[number]
                    count[odd], inside[odd] = [x for x, _, _ in found], [x for _, _, x in found]
                    place = np.concatenate((np.zeros(1, np.int64), np.cumsum(count)))
                    classes = np.empty(int(place[-1]), subwords.code.dtype)
                    known = np.flatnonzero(number >= 0)
                    classes[places(place[known], count[known])] = frequent.flat[places(frequent.start[number[known]], count[known])]
                    classes[places(place[odd], count[odd])] = np.frombuffer(b"".join([x for _, x, _ in found]), classes.dtype)
                    sums_of = [np.concatenate((np.zeros(1), np.cumsum(x))) for x in (number >= 0, frequent.base[number], inside)]
                    odd_cuts = np.searchsorted(odd, cuts).tolist()
                    for n, (a, z, oa, oz) in enumerate(zip([0, *cuts[:-1]], cuts, [0, *odd_cuts[:-1]], odd_cuts, strict=True), first):
                        d = docs[n]
                        d[2] += z - a
                        d[3] += int(sums_of[0][z] - sums_of[0][a])
                        d[4] += float(sums_of[1][z] - sums_of[1][a])
                        d[5] += float(sums_of[2][z] - sums_of[2][a])
                        d[6].append(classes[place[a] : place[z]].tobytes())
                        rare[n].update(words[oa:oz])
                for d in docs:
                    d[6] = b"".join([*d[6], subwords.end])
                yield _rows(docs)
                yield _rows([(d[0], None, None, None, None, None, None, w, c) for d, n in zip(docs, rare, strict=True) for w, c in n.items()])

        return self.docs.select("id", "train", "text").mapInArrow(of, "id long, train boolean, n_tokens long, n_known long, base double, inside double, classes binary, word binary, tf long")

    def _attention(self) -> None:
        spark = self.docs.sparkSession
        sequences = self.documents.filter("train and classes is not null").select("id", "classes")
        model = initial(self.subwords.prior)
        for turn in range(len(RATES) if self.ends else 0):
            trained = sequences.mapInArrow(_trainer(spark.sparkContext.broadcast(model), turn), "at long, p double, n double")
            mean = trained.groupBy("at").agg((F.sum("p") / F.sum("n")).alias("p")).orderBy("at").collect()  # as many as parameters
            if mean:
                model = unvector(np.array([r.p for r in mean]), model)
        self.model = model

    def scores(self) -> DataFrame:
        """id_col, n_tokens, n_known, base_score, score: one row per document."""
        model, kind = self.docs.sparkSession.sparkContext.broadcast(self.model), self.subwords.code.dtype

        def of(batches):
            for b in batches:
                for lo in range(0, b.num_rows, DOCUMENTS):
                    part = b.slice(lo, DOCUMENTS)
                    found = sums(model.value, [np.frombuffer(c, kind) for c in part.column("classes").to_pylist()])
                    yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(part.column("inside").to_numpy() + found)], ["id", "n_tokens", "n_known", "base", "model"])

        whole = self.documents.filter("classes is not null").select("id", "n_tokens", "n_known", "base", "inside", "classes").mapInArrow(of, "id long, n_tokens long, n_known long, base double, model double")
        # words that no training document has are in no row of the table: their count is zero
        joined = self.documents.filter("word is not null").select("id", "word", "tf").join(self.words.filter(~self.common), "word", "left")
        c = F.coalesce("c", F.lit(0))
        base = F.log10((c + F.lit(0.1)) / F.lit(float(self.n + 0.1 * (self.v + 1))))
        rare = joined.select("id", F.lit(0).cast("long").alias("n_tokens"), F.when(c > 0, F.col("tf")).otherwise(0).alias("n_known"), (F.col("tf") * base).alias("base"), F.lit(0.0).alias("model"))
        return whole.unionByName(rare).groupBy(F.col("id").alias(self.id_col)).agg(
            F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("model").alias("score")
        )


class SubwordModel(LanguageModel):
    """The model whose state is that of the ids, and which tells the ids of a class apart by their context."""

    def _code(self, subwords: Subwords) -> None:
        self.tree = Tree(subwords.cls, subwords.counts)
        subwords.code, subwords.end = np.arange(self.tree.end, dtype=self.tree.kind), self.tree.kind(self.tree.end).tobytes()
        subwords.inside = np.zeros(len(subwords.cls))  # the model gives the whole probability
        self.subwords = subwords

    def _attention(self) -> None:
        spark = self.docs.sparkSession
        sequences = self.documents.filter("train and classes is not null").select("id", "classes")
        model = initial(self.subwords.prior) | self.tree.tables() | {"tree": self.tree}
        for turn in range(len(RATES) if self.ends else 0):
            trained = sequences.mapInArrow(_trainer(spark.sparkContext.broadcast(model), turn), "part string, blob binary")
            model = model | {n: model[n].copy() for n in TABLES}
            for r in trained.groupBy("part").applyInArrow(_mean, "part string, blob binary").collect():  # a table in parts of ROWS rows
                name, _, at = r.part.partition(":")
                if name == "all":
                    model |= unvector(np.frombuffer(r.blob), model)
                else:
                    change = np.frombuffer(r.blob, np.float32).reshape(-1, DIM)
                    model[name][int(at) * ROWS : int(at) * ROWS + len(change)] += change
        self.model = model


def _rows(rows: list) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(DOCUMENT)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, DOCUMENT, strict=True)], schema=DOCUMENT)


def _trainer(now, turn: int):
    """A round's windows of a partition, shuffled in chunks, train a copy of the model; rows (at, parameter * windows, windows)."""

    def train(batches):
        t, r, held, n = Trainer(now.value, RATES[turn]), np.random.default_rng(turn), [], 0
        tree = now.value.get("tree")
        how = () if tree is None else (tree.begin, tree.pad, tree.kind)
        for b in batches:
            for lo in range(0, b.num_rows, DOCUMENTS):
                part = b.slice(lo, DOCUMENTS)
                windows, owner, nth = windows_of([np.frombuffer(c, how[-1] if how else np.uint8) for c in part.column(1).to_pylist()], *how)
                deal = np.array([xxhash.xxh32_intdigest(str(i)) for i in part.column(0).to_pylist()], np.int64)
                held.append(windows[(deal[owner] + nth) % len(RATES) == turn])
                if sum(map(len, held)) >= CHUNK:
                    n += sum(map(len, held))
                    t.fit(np.concatenate(held), r)
                    held = []
        if sum(map(len, held)):
            n += sum(map(len, held))
            t.fit(np.concatenate(held), r)
        if n and tree is not None:
            yield from _changes(t, now.value, n)
        elif n:
            p = vector(t.m)
            yield pa.RecordBatch.from_pydict({"at": np.arange(len(p)), "p": p.astype(np.float64) * n, "n": np.full(len(p), float(n))})

    return train


def _changes(t: Trainer, was: dict, n: int):
    """(part, blob): n and the parameters; and of each part of a table the rows that were met, how often, and their change."""
    parts, blobs = ["all"], [np.append(vector(t.m), n).astype(np.float64).tobytes()]
    for name, met in t.met.items():
        rows = np.flatnonzero(met)
        for some in np.split(rows, np.searchsorted(rows, np.arange(ROWS, len(met), ROWS))):
            if len(some):
                parts.append(f"{name}:{some[0] // ROWS}")
                change = (t.m[name][some] - was[name][some]).astype(np.float16)
                blobs.append(np.uint32(len(some)).tobytes() + (some % ROWS).astype(np.uint32).tobytes() + met[some].astype(np.uint32).tobytes() + change.tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(blobs, pa.binary())], ["part", "blob"])


def _mean(found: pa.Table) -> pa.Table:
    """The mean of the copies' parameters by their windows, or of a part's changes by how often they met each row."""
    part, blobs = found.column("part")[0].as_py(), found.column("blob")
    if part == "all":
        total = 0.0
        for b in blobs:
            p = np.frombuffer(b.as_buffer())
            total = total + np.append(p[:-1] * p[-1], p[-1])
        out = total[:-1] / total[-1]
    else:
        total, times = np.zeros((ROWS, DIM)), np.zeros(ROWS)
        for b in blobs:
            b = b.as_buffer()
            n = int(np.frombuffer(b, np.uint32, 1)[0])
            rows, many = np.frombuffer(b, np.uint32, n, 4), np.frombuffer(b, np.uint32, n, 4 + 4 * n)
            total[rows] += np.frombuffer(b, np.float16, n * DIM, 4 + 8 * n).reshape(n, DIM) * many[:, None].astype(np.float64)
            times[rows] += many
        last = np.flatnonzero(times)[-1] + 1
        out = (total / np.maximum(times, 1)[:, None])[:last].astype(np.float32)
    return pa.table({"part": [part], "blob": pa.array([out.tobytes()], pa.binary())})


def score_documents(docs: DataFrame, tokenizer: str, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_tokens, n_known, train_tokens, base_score, score (log10).

    training tells the rows to learn from. Null texts count as empty: one token, the end. Without training
    rows all counts are zero, and classes are equally likely. Ids should be distinct: rows that repeat an id
    are added up. Rows without an id are dropped; other columns are ignored; an empty table gives an empty
    result.
    """
    lm = SubwordModel(docs, tokenizer, training, id_col, text_col)
    return lm.scores().select(id_col, "n_tokens", "n_known", F.lit(lm.n).cast("long").alias("train_tokens"), "base_score", "score")
