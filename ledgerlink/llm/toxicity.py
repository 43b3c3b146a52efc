"""Toxicity scores after noisy-channel deobfuscation.

Odd tokens (letters mixed with look-alike signs, long repetitions, letters set apart) are lattices of what
their writer may have meant. Viterbi decodes the most likely letters under a character trigram model and a
channel model. Restored words are then scored by weights of words and character n-grams, learnt from
labelled documents; a logistic function of a document's strongest words gives its score.

The character model counts the letters of every document. Labels are learnt from a bounded sample of at most
about TRAIN_ROWS labelled rows, two thirds for weights and one third for the logistic function.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lean

TRAIN_ROWS = 15_000
#: Words whose scores a worker keeps; longer ones than CACHED_LENGTH are scored each time, so that the cache stays small.
CACHE_WORDS = 150_000
CACHED_LENGTH = 80
#: Distinct tokens of a task that are counted together.
COUNTED_WORDS = 200_000
MIN_WEIGHT = 1.5
#: A feature counts if this share of the toxic documents of the sample has it, and three of them. So there are at
#: most as many features as a document has on average, divided by this share.
LEAST_SHARE = 0.003
#: The trigrams that workers get: the most common ones of the corpus. Those of four languages are some 30,000.
MOST_GRAMS = 1 << 20
#: Marks of a word's ends in its features.
FRONT, BACK = "\x02", "\x03"

# Signs that stand for letters.
LOOKALIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "ß": "ßb", "*": "aeiou"}
JOINERS = " .-_*~"
EDGE = ".,;:!?\"'()[]{}|*%&#~-_=+…«»“”‘’"
FRONT_EDGE = EDGE.replace("|", "").replace("!", "").replace("(", "")
REPEATED = re.compile(r"(\w)\1\1")
APART = re.compile(rf"\w(?:[{re.escape(JOINERS)}]\w){{2,}}")
SPELLED = re.compile(r"(?<!\S)\w(?: \w){3,}(?=$|[\s.,;:!?])")
MIXED = re.compile(r"[^\W\d_][0-9@$!|+(€£¡*]+[^\W\d_]|^[0-9@$!|+(€£¡]{1,2}[^\W\d_]{2}|[^\W\d_]{2}[0-9@$€£]$|(\w)\1\1")


class Channel:
    """Character trigrams of clean words, and the Viterbi decoder."""

    def __init__(self, counts: dict[str, int]):
        self.three, self.two, self.total = counts, Counter(), max(1, sum(counts.values()))
        self.one: Counter = Counter()
        self.pair: Counter = Counter()
        for g, n in counts.items():
            self.two[g[:2]] += n
            self.pair[g[1:]] += n
            self.one[g[2]] += n
        self.mid = Counter()
        for g, n in self.pair.items():
            self.mid[g[0]] += n
        self.size = len(self.one) + 1
        self.known: dict[tuple[str, str, str], float] = {}

    def log_p(self, a: str, b: str, c: str) -> float:
        p = self.known.get((a, b, c))
        if p is None:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            p = self.known[a, b, c] = self._log_p(a, b, c)
        return p

    def _log_p(self, a: str, b: str, c: str) -> float:
        p1 = (self.one.get(c, 0) + 0.5) / (self.total + 0.5 * self.size)
        p2 = (self.pair.get(b + c, 0) + 2 * p1) / (self.mid.get(b, 0) + 2)
        return math.log((self.three.get(a + b + c, 0) + 2 * p2) / (self.two.get(a + b, 0) + 2))

    @staticmethod
    def lattice(token: str) -> list[list[tuple[str, float]]]:
        """For each run of equal signs, what it may stand for, with log costs."""
        out = []
        for m in re.finditer(r"(.)\1*", token, re.S):
            sign, n = m[1], len(m[0])
            means = [(c, -0.7) for c in LOOKALIKE.get(sign, "")]
            if sign.isalpha():
                means.append((sign, 0.0))
            elif sign in JOINERS:
                means.append(("", -0.5))
            elif not means:
                means.append(("", -3.0))
            options = []
            for letter, cost in means:
                options.append((letter, cost - (0.0 if n == 1 else 0.4 if n > 2 else 1.0)))
                if n > 1 and letter:
                    options.append((letter * 2, cost - (0.0 if n == 2 else 0.7)))
            out.append(options)
        return out

    def decode(self, token: str) -> str:
        """The most likely letters of the whole token; of equally likely ones the last in order."""
        best: dict[tuple[str, str], tuple[float, tuple]] = {("^", "^"): (0.0, ())}
        for options in self.lattice(token):
            found: dict[tuple[str, str], tuple[float, tuple]] = {}
            for (a, b), (score, path) in best.items():
                for letters, cost in options:
                    s, x, y = score + cost, a, b
                    for c in letters:
                        s += self.log_p(x, y, c)
                        x, y = y, c
                    if (x, y) not in found or s > found[x, y][0]:
                        found[x, y] = (s, (path, letters) if letters else path)
            best = found
        ends = [(s + self.log_p(a, b, "$"), path) for (a, b), (s, path) in best.items()]
        top = max(s for s, _ in ends)
        return max(_spelt(path) for s, path in ends if s == top)


def _spelt(path: tuple) -> str:
    """The letters of a path, which is (path before, letters)."""
    out = []
    while path:
        path, letters = path
        out.append(letters)
    return "".join(reversed(out))


def words_of(token: str) -> str:
    """The word in a lower-case token, without signs around it; look-alikes at its front stay."""
    return token.rstrip(EDGE).lstrip(FRONT_EDGE)


def restored(token: str, channel: Channel) -> str:
    word = token if token.isalpha() else words_of(token)
    if word.isalpha():
        return channel.decode(word) if REPEATED.search(word) else word
    return channel.decode(word) if APART.fullmatch(word) or MIXED.search(word) else word.strip(EDGE)


def restore(text: str, channel: Channel) -> str:
    """The text with odd tokens decoded, in lower case."""
    return " ".join(restored(t, channel) for t in tokens(text))


def features(word: str) -> set[str]:
    """The word, of any length, and its 4- to 6-character pieces with edges, and longer beginnings."""
    if len(word) < 3:
        return set()
    w = FRONT + word + BACK
    return {w, *(w[i : i + n] for n in (4, 5, 6) for i in range(len(w) - n + 1)), w[:7], w[:8], w[:9]}


def automaton_of(names) -> ahocorasick.Automaton:
    """Finds features in marked words: what it finds in one are just those of features() that are among the names."""
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, name in enumerate(names):
        found.add_word(name, i)
    if len(found):
        found.make_automaton()
    return found


def tokens(text: str) -> list[str]:
    """Lower-case tokens; letters that are set apart by spaces are one token, with dots between them."""
    low = text.lower()
    words = low.split()
    apart = 0
    for size in map(len, words):
        apart = apart + 1 if size == 1 else 0
        if apart == 3:
            return SPELLED.sub(lambda m: m[0].replace(" ", "."), low).split()
    return words


def _role() -> Column:
    return F.pmod(F.xxhash64("id", F.lit("role")), F.lit(3)) == 0


class Scores(dict):
    """Scores of tokens, made when they are first asked for."""

    def __init__(self, channel: Channel, weights: dict[str, float]):
        self.channel, self.found, self.values = channel, automaton_of(weights), list(weights.values())

    def __missing__(self, token: str) -> float:
        word, score = restored(token, self.channel), 0.0
        if len(word) >= 3 and self.values:
            score = max([self.values[i] for _, i in self.found.iter(FRONT + word + BACK)], default=0.0)
        if len(token) <= CACHED_LENGTH:
            if len(self) > CACHE_WORDS:
                self.clear()
            self[token] = score
        return score


class Model:
    def __init__(self, channel: Channel, weights: dict[str, float], curve: list[float]):
        self.channel, self.weights, self.curve = channel, weights, curve
        self.scores: Scores | None = None

    def __getstate__(self):
        return self.__dict__ | {"scores": None}  # workers build their own

    def statistics(self, text: str) -> list[float]:
        """Constant, the strongest word, the second, the sum of the five strongest, the evidence of all strong words."""
        if self.scores is None:
            self.scores = Scores(self.channel, self.weights)
        strong = sorted(filter(None, map(self.scores.__getitem__, tokens(text))), reverse=True)
        second = strong[1] if len(strong) > 1 else 0.0
        return [1.0, strong[0] if strong else 0.0, second, sum(strong[:5]), math.log1p(sum(s for s in strong if s > 2 * MIN_WEIGHT))]

    def score(self, text: str) -> float:
        z = sum(a * b for a, b in zip(self.curve, self.statistics(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> list[float]:
    """Coefficients by Newton's method; the constant is not shrunk."""
    w, shrink = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    shrink[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink, x.T @ (p - y) + shrink @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: Column | None = None, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most about rows labelled rows, chosen by a hash of their ids; ids where held_out holds are never used."""
    given = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if held_out is not None:
        given = given.filter(~held_out)
    given = given.groupBy(F.col(id_col).cast("long").alias("id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    share = min(1.0, rows / max(1, given.count()))
    chosen = given.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))  # bounded by rows
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = cut(slim.join(F.broadcast(chosen), "id").select("text", "label", _role().alias("curve")))
    fit = sample.filter(~F.col("curve"))

    def letters(batches):
        words: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                words.update(text.lower().split())
                if len(words) > COUNTED_WORDS:
                    yield _grams(words)
                    words = Counter()
        yield _grams(words)

    grams = slim.select("text").mapInArrow(lean(letters), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    channel = Channel({r.gram: r.n for r in grams.orderBy(F.desc("n"), "gram").limit(MOST_GRAMS).collect()})

    def toxic_features(batches):
        for b in batches:
            n: Counter = Counter()
            for text in b.column(0).to_pylist():
                found: set[str] = set()
                for w in {restored(t, channel) for t in set(tokens(text))}:
                    found |= features(w)
                n.update(found)
                if len(n) > 1_000_000:
                    yield _counted(n)
                    n = Counter()
            yield _counted(n)

    docs_of = {r.label: r.n for r in fit.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = docs_of.get(1, 0), docs_of.get(0, 0)
    if not n1 or not n0:
        p = (n1 + 1) / (n1 + n0 + 2)
        return Model(channel, {}, [math.log(p / (1 - p)), 0.0, 0.0, 0.0, 0.0])
    toxic = (
        fit.filter("label = 1").select("text").mapInArrow(lean(toxic_features), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= max(3, round(LEAST_SHARE * n1))).orderBy("feature").collect()
    )
    names = [r.feature for r in toxic]

    def clean_features(batches):
        found, n = automaton_of(names), np.zeros(len(names), np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                marked = (BACK + FRONT).join([w for w in {restored(t, channel) for t in set(tokens(text))} if len(w) >= 3])
                here = {i for _, i in found.iter(FRONT + marked + BACK)} if len(found) else ()
                n[list(here)] += 1
        yield pa.RecordBatch.from_pydict({"i": np.flatnonzero(n), "n": n[n > 0]})

    clean = {r.i: r.n for r in fit.filter("label = 0").select("text").mapInArrow(lean(clean_features), "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    weights = {r.feature: math.log((r.n + 0.5) / (n1 + 1)) - math.log((clean.get(i, 0) + 0.5) / (n0 + 1)) for i, r in enumerate(toxic)}
    model = Model(channel, {f: w for f, w in weights.items() if w >= MIN_WEIGHT}, [])

    def stats(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"x": pa.array([model.statistics(t) for t in b.column(0).to_pylist()], pa.list_(pa.float64())), "label": b.column(1)})

    seen = sample.filter("curve").select("text", "label").mapInArrow(lean(stats), "x array<double>, label int").collect()  # a third of the sample
    x, y = np.array([r.x for r in seen]).reshape(-1, 5), np.array([r.label for r in seen], float)
    model.curve = logistic(x, y) if len(y) else [math.log(n1 / n0), 0.0, 0.0, 0.0, 0.0]
    return model


def _grams(words: Counter) -> pa.RecordBatch:
    n: Counter = Counter()
    for token, times in words.items():
        w = words_of(token)
        if w.isalpha():
            w = f"^^{w}$"
            for i in range(len(w) - 2):
                n[w[i : i + 3]] += times
    return pa.RecordBatch.from_pydict({"gram": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64())})


def _counted(n: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"feature": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64())})


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per row of docs: id_col, score (0 to 1), predicted (1 from the threshold on).

    Null texts count as empty; empty texts get the score of a text without strong words. Ids may be null or
    repeat; other columns are ignored. An empty table gives an empty result. With no labelled rows of one
    class the score is the share of the other class, smoothed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: see LEAST_SHARE and MOST_GRAMS

    def of(batches):
        m = shared.value
        for b in batches:
            scores = np.array([m.score(t or "") for t in b.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores)], ["id", "score"])

    return (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(lean(of), "id long, score double")
        .select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
    )


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns unchanged, whose text scores below the threshold; null texts count as empty."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def of(batches):
        m = shared.value
        for b in batches:
            yield b.filter(pa.array([m.score(t or "") < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(lean(of), docs.schema)


def in_held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3, is 1."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1
