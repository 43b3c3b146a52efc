"""SentencePiece encoding and decoding as relations.

Texts are cut into units at which no piece of the vocabulary ends inside: between two characters that stand
side by side in no piece. Only distinct units are encoded: their substrings of bounded length are exploded,
equi-joined to the piece table and grouped by unit into a lattice of edges; a higher-order aggregate folds
the lattice. Models of the unigram type take the path of the greatest sum of scores (Viterbi). The public
model is of the BPE type, for which that path is not the library's answer: its fold applies the model's
merges in order of score, as such models are defined. Its state is the set of cut points, and each step
removes the one inside the best edge whose ends are cut points with a single cut between them. The tests hold
the result against the library's.

Documents travel compressed, once, to shards of about SHARD_BYTES of text. The FREQUENT most common units
are sent to all workers, whatever the corpus; a shard gets the ids of its other units by a join. There whole
texts become ids, and ids are decoded again and compared with the text.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, gathered, lean, release, written
from .repeats import pack, unpack
from .word_hashes import BLOCK, hashed_runs, places

SPACE = "▁"
FREQUENT = 300_000
#: Units that a task keeps what it has found out about.
CACHE_UNITS = 150_000
#: Documents whose words are read at a time.
DOCUMENTS = 1000
#: Rare units of a task that are packed together.
PACKED_UNITS = 10_000
#: Text of a shard, which one task holds: the number of shards follows the corpus.
SHARD_BYTES = 5 << 20
#: Text of a shard that becomes ids at a time.
SLICE_BYTES = 1 << 20
#: Cut points of a unit are bits of a long; longer units fold in Python over the same edges.
LONGEST = 60
#: Units of a partition while their lattices are built: a unit has some twenty edges, which are sorted in memory.
UNITS_PER_PARTITION = 20_000
#: The id of a character that is no piece; ids of pieces are smaller.
UNKNOWN = (1 << 17) - 1
#: What a character that is no piece costs in a unigram model, below the least score.
UNKNOWN_PENALTY = 10.0


def piece_table(spark: SparkSession, model_file: str) -> DataFrame:
    """(id, piece, score, byte) of the model's pieces that can occur in a text; a vocabulary is small and of fixed size."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    rows = []
    for i in range(m.get_piece_size()):
        if m.is_byte(i):
            rows.append((i, None, 0.0, int(m.id_to_piece(i)[3:5], 16)))
        elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
            rows.append((i, m.id_to_piece(i), float(m.get_score(i)), None))
    return spark.createDataFrame(rows, "id int, piece string, score double, byte int")


ODD = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


def words_of(text: str) -> list[str]:
    """Keys of a text's words, in order, for units_of: what follows a space (or the front), as it is; what
    follows a line feed, with it; where spaces are repeated or the sign for a space occurs, two line feeds and a unit."""
    if not text:
        return []
    if "  " in text or text[0] == " " or SPACE in text:
        return ["\n\n" + u for u in ODD.findall(SPACE + text.replace(" ", SPACE))]
    return text.replace("\n", " \n").split(" ")


def units_of(word: str, pairs: frozenset[str]) -> list[str]:
    """The units of a word, cut where no piece has the two characters side by side."""
    if word[:2] == "\n\n":
        word = word[2:]
    elif word[:1] != "\n":
        word = SPACE + word
    ends = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in pairs]
    return [word[a:z] for a, z in zip([0, *ends], [*ends, len(word)], strict=True)]


#: Code points whose pairs are looked up in a table; others are searched.
LATIN = 0x250
#: Keys of the units that are a line feed or a space by themselves, and what sets units with a space before them apart.
FEED_KEY, SPACE_KEY, LED = np.uint64(1), np.uint64(2), np.uint64(0xA3B195354A39B70D)


class Pairs:
    """Which characters stand side by side in some piece."""

    def __init__(self, pieces):
        self.pairs = frozenset(p[k : k + 2] for p in pieces for k in range(len(p) - 1))
        self.table = np.zeros((LATIN, LATIN), bool)
        codes = []
        for a, b in (map(ord, p) for p in self.pairs):
            codes.append(a << 21 | b)
            if max(a, b) < LATIN:
                self.table[a, b] = True
        self.codes = np.array(sorted(codes), np.int64)
        self.led = np.array([SPACE + chr(c) in self.pairs for c in range(LATIN)] + [False])

    def meet(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(a) or max(a.max(), b.max()) < LATIN:
            return self.table.ravel()[a * np.uint32(LATIN) + b]
        out = self.table[np.minimum(a, LATIN - 1), np.minimum(b, LATIN - 1)]
        far = np.flatnonzero(np.maximum(a, b) >= LATIN)
        code = a[far].astype(np.int64) << 21 | b[far]
        out[far] = len(self.codes) and self.codes[np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)] == code
        return out

    def first(self, a: np.ndarray) -> np.ndarray:
        """Whether some piece has each of these characters after a space."""
        out = self.led[np.minimum(a, LATIN)]
        far = np.flatnonzero(a >= LATIN)
        out[far] = self.meet(np.full(len(far), ord(SPACE), np.uint32), a[far])
        return out


def _hashes(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of runs of code points, two bytes each; runs with others go through xxh3 whole."""
    wide = np.concatenate((np.zeros(1, np.int64), np.cumsum(points > 0xFFFF)))
    odd = wide[end] > wide[begin] if wide[-1] else None
    h = hashed_runs(points.astype(np.uint16), begin, end, 0, odd)
    if odd is not None:
        for k in np.flatnonzero(odd).tolist():
            h[k] = xxhash.xxh3_64_intdigest(points[begin[k] : end[k]].tobytes())
    return h


def keys_of(units: list[str]) -> np.ndarray:
    """The keys that Units gives to these units; zero for those that only irregular texts have."""
    out = np.zeros(len(units), np.uint64)
    for at in range(0, len(units), 4096):
        some = units[at : at + 4096]
        led = np.array([u[:1] == SPACE for u in some])
        bodies = [u[1:] if x else u for u, x in zip(some, led.tolist(), strict=True)]
        good = np.array([bool(b) and not (SPACE in b or " " in b or "\n" in b) for b in bodies])
        if good.any():
            kept = [b for b, x in zip(bodies, good.tolist(), strict=True) if x]
            lens = np.array(list(map(len, kept)))
            points = np.frombuffer(" ".join(kept).encode("utf-32-le", "replace"), np.uint32)
            begin = np.cumsum(lens + 1) - lens - 1
            out[at + np.flatnonzero(good)] = _hashes(points, begin, begin + lens) ^ (LED * led[good]) ^ (lens.astype(np.uint64) << np.uint64(40))
        for i, u in enumerate(some):
            if u in ("\n", SPACE):
                out[at + i] = FEED_KEY if u == "\n" else SPACE_KEY
    return out


class Common:
    """Ids of the frequent units by key, as arrays; those without a key by name."""

    def __init__(self, units: list[str], ids: list[list[int]]):
        key = keys_of(units)
        order = np.argsort(key, kind="stable")
        count = np.array(list(map(len, ids)), np.int64)
        self.key, self.count, self.start = key[order], count[order], (np.cumsum(count) - count)[order]
        self.flat = np.concatenate([np.array(i, np.int32) for i in ids]) if ids else np.zeros(0, np.int32)
        self.named = {u: np.array(i, np.int32) for u, i, k in zip(units, ids, key.tolist(), strict=True) if not k}

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        if not len(self.key):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return np.where((self.key[at] == keys) & (keys > 0), at, -1)

    def ids(self, at: int) -> np.ndarray:
        return self.flat[self.start[at] : self.start[at] + self.count[at]]


class Units:
    """The units of many texts: distinct ones as Python values, all others as numbers.

    Regular texts have one space, or line feeds, between two words, and are read by hashes of 64 bits; units of
    equal hash and different length are told apart. Other texts, and very long ones, are left to words_of (odd).
    """

    def __init__(self, texts: list[str], pairs: Pairs):
        self.odd = [i for i, t in enumerate(texts) if len(t) > BLOCK or t[:1] in (" ", "\n") or t[-1:] == " " or "  " in t or " \n" in t or "\n " in t or SPACE in t]
        self.size, self.data = np.zeros(len(texts), np.int64), []
        odd, keys, where, self.seen = set(self.odd), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
        block: list[int] = []
        length = 0
        for i, t in enumerate(texts):
            if i not in odd and t:
                if length + len(t) > BLOCK and block:
                    self._read(texts, block, pairs, keys, where)
                    block, length = [], 0
                block.append(i)
                length += len(t) + 1
        if block:
            self._read(texts, block, pairs, keys, where)
        self.key, first, self.of, self.times = np.unique(np.concatenate(keys), return_index=True, return_inverse=True, return_counts=True)
        self.at = np.concatenate(where)[first]

    def _read(self, texts, block, pairs, keys, where) -> None:
        data = " ".join([texts[i] for i in block])
        points = np.frombuffer(data.encode("utf-32-le", "replace"), np.uint32)
        feed = points == 10
        inside = np.zeros(len(points) + 2, bool)
        inside[1:-1] = (points != 32) & ~feed
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        begins, ends = edge[::2], edge[1::2]  # of words
        feeds = np.concatenate((np.zeros(1, np.int64), np.cumsum(feed)))
        lens = np.array([len(texts[i]) for i in block])
        text_at = np.cumsum(lens + 1) - lens - 1
        text_of = np.searchsorted(text_at, begins, "right") - 1
        before = feeds[begins] - feeds[np.maximum(text_at[text_of], np.concatenate((np.zeros(1, np.int64), ends[:-1])))]
        tail = feeds[text_at + lens] - feeds[text_at] - np.bincount(text_of, before, len(block)).astype(np.int64)
        spaced = before == 0
        alone = spaced & ~pairs.first(points[begins])  # a space that no piece has before this sign
        cut = np.zeros(len(points) + 1, bool)
        cut[1:-1] = ~pairs.meet(points[:-1], points[1:])
        cut[:-1] &= inside[1:-1]
        cut[begins] = True
        begin = np.flatnonzero(cut)
        word = np.cumsum(np.bincount(begins, minlength=len(points) + 1)[:-1])[begin] - 1
        end = np.minimum(np.append(begin[1:], len(points)), ends[word])
        opens = begins[word] == begin  # the first unit of its word
        led = opens & (spaced & ~alone)[word]
        h = _hashes(points, begin, end)
        h ^= LED * led
        h ^= (end - begin).astype(np.uint64) << np.uint64(40)
        # line feeds and single spaces stand before the units they belong to, or at the end of their text
        extra = np.where(opens, (before + alone)[word], 0)
        tails = np.concatenate((np.zeros(1, np.int64), np.cumsum(tail)))
        at = np.cumsum(extra + 1) - 1 + tails[text_of[word]]
        key = np.full(int(len(begin) + extra.sum() + tail.sum()), FEED_KEY)
        key[at] = h
        key[at[opens & alone[word]] - 1] = SPACE_KEY
        place = np.zeros(len(key), np.int64)  # a unit's number in its block, and above it the block's
        place[at] = np.arange(len(begin)) + (len(self.data) << 32)
        self.size[block] = np.bincount(text_of[word], extra + 1, len(block)).astype(np.int64) + tail
        self.data.append(data)
        self.seen.append((begin, end, led))
        keys.append(key)
        where.append(place)

    def names(self, wanted: np.ndarray | None = None) -> list[str]:
        """The distinct units, in order of their keys; only those wanted, if given, others empty."""
        out = [""] * len(self.key)
        block = self.at >> 32 if wanted is None else np.where(wanted, self.at >> 32, -1)
        for n, (data, seen) in enumerate(zip(self.data, self.seen, strict=True)):
            here = np.flatnonzero(block == n)
            at = self.at[here] & 0xFFFFFFFF
            for i, a, z, led in zip(here.tolist(), *(x[at].tolist() for x in seen), strict=True):
                out[i] = SPACE + data[a:z] if led else data[a:z]
        for key, text in ((FEED_KEY, "\n"), (SPACE_KEY, SPACE)):
            i = int(np.searchsorted(self.key, key))
            if i < len(out) and self.key[i] == key and (wanted is None or wanted[i]):
                out[i] = text
        return out


def edges_of(distinct: DataFrame, pieces: DataFrame, longest_piece: int, parts: int) -> DataFrame:
    """(h, unit, n, s, e, rank, id) of distinct units (unit, n): one row per substring that is a piece.

    Single characters without a piece have id UNKNOWN and rank 0. The units are dealt once; grouping and
    all that follows stays in the same partitions (h only makes sorting them cheap). n, the unit's number of occurrences, is carried along.
    """
    places = distinct.filter(F.length("unit") > 0).repartition(parts, "unit").withColumn("h", F.xxhash64("unit")).select("h", "unit", "n", F.explode(F.sequence(F.lit(1), F.length("unit"))).alias("s"))
    longest = F.least(F.lit(longest_piece), F.length("unit") - F.col("s") + 1)
    subs = places.select("h", "unit", "n", "s", F.explode(F.sequence(F.lit(1), longest)).alias("l"))
    subs = subs.select("h", "unit", "n", (F.col("s") - 1).alias("s"), (F.col("s") - 1 + F.col("l")).alias("e"), F.col("unit").substr(F.col("s"), F.col("l")).alias("piece"))
    known = pieces.filter("piece is not null").select("piece", "id", F.dense_rank().over(Window.orderBy(F.desc("score"))).alias("rank"))  # a vocabulary: one small table
    return (
        subs.join(F.broadcast(known), "piece", "left")
        .filter("id is not null or e = s + 1")
        .select("h", "unit", "n", "s", "e", F.coalesce("rank", F.lit(0)).alias("rank"), F.coalesce("id", F.lit(UNKNOWN)).alias("id"))
    )


def lattice(distinct: DataFrame, pieces: DataFrame, longest_piece: int, parts: int) -> DataFrame:
    """(h, unit, n, edges) of units up to LONGEST: edges packed as longs (rank, start, end, id), so that they sort by rank, then start."""
    packed = F.expr("shiftleft(cast(rank as bigint), 29) + shiftleft(cast(s as bigint), 23) + shiftleft(cast(e as bigint), 17) + id")
    return edges_of(distinct, pieces, longest_piece, parts).groupBy("h", "unit", "n").agg(F.sort_array(F.collect_list(packed)).alias("edges"))


def folded(lat: DataFrame) -> DataFrame:
    """(h, unit, n, kept) of units up to LONGEST: the edges (s, id) of the final pieces, in order, packed as longs.

    One higher-order aggregate over the edges in order of merge rank, then place: a merge is done if both its
    ends are cut points with a single one between them, which it removes. A merge that is done never makes a
    better-ranked one possible: that piece was learnt earlier, from the same characters, and so was merged
    before or is cut by another; one pass in order is the whole procedure. The cut points before the end of an
    edge are b % 2 ** end, and those from its start on b >> start: two of them are a merge, one is a piece.
    """
    start, end = "cast(shiftright(x, 23) & 63 as int)", "cast(shiftright(x, 17) & 63 as int)"
    inner = f"shiftright(b & (shiftleft(1L, {end} + 1) - 1), {start})"  # the cut points from start to end
    whole = f"shiftleft(1L, {end} - {start}) + 1"  # both ends
    ends = f"(shiftleft(1L, {end}) | shiftleft(1L, {start}))"
    mid = f"(shiftleft(1L, {end}) - shiftleft(1L, {start} + 1))"
    cuts = F.expr(f"aggregate(edges, shiftleft(1L, length(unit) + 1) - 1, (b, x) -> if(bit_count({inner}) = 3 AND ({inner} & ({whole})) = {whole}, b & ~{mid}, b))")
    df = lat.select("h", "unit", "n", "edges", cuts.alias("b"))
    # b stands twice here, so that it is not put in place of its name and worked out for every edge
    return df.select("h", "unit", "n", F.expr(f"sort_array(transform(filter(edges, x -> (b & {ends}) = {ends} AND (b & {mid}) = 0), x -> shiftleft(shiftright(x, 23) & 63, 17) | (x & 131071)))").alias("kept"))


def scored(distinct: DataFrame, pieces: DataFrame, longest_piece: int, parts: int) -> DataFrame:
    """(h, unit, n, edges) for a unigram model: edges (e, s, score, id), so that they sort by end, then start."""
    least = pieces.agg(F.min("score")).first()[0] or 0.0
    by_id = F.broadcast(pieces.select("id", "score"))
    edges = edges_of(distinct, pieces, longest_piece, parts).join(by_id, "id", "left")
    return edges.groupBy("h", "unit", "n").agg(F.array_sort(F.collect_list(F.struct("e", "s", F.coalesce("score", F.lit(least - UNKNOWN_PENALTY)).alias("score"), "id"))).alias("edges"))


def viterbi(lat: DataFrame) -> DataFrame:
    """(h, unit, n, kept) of scored lattices: the edges (s, id) of the path with the greatest sum of scores, in order.

    The state has, for every place so far, the best sum that reaches it and the edge by which it does; edges
    come by end, so that only the last place changes. Of equal sums the edge that starts first stays.
    """
    reached = """aggregate(edges, named_struct('sums', array(0D), 'came', array(named_struct('s', -1, 'id', -1))), (a, x) ->
        if(size(a.sums) <= x.e,
           named_struct('sums', a.sums || array(get(a.sums, x.s) + x.score), 'came', a.came || array(named_struct('s', x.s, 'id', x.id))),
           if(get(a.sums, x.s) + x.score > element_at(a.sums, -1),
              named_struct('sums', slice(a.sums, 1, x.e) || array(get(a.sums, x.s) + x.score), 'came', slice(a.came, 1, x.e) || array(named_struct('s', x.s, 'id', x.id))),
              a)), a -> a.came)"""
    back = """aggregate(sequence(1, length(unit)), named_struct('at', length(unit), 'kept', cast(array() as array<struct<s:int,id:int>>)), (a, k) ->
        if(a.at > 0, named_struct('at', get(came, a.at).s, 'kept', array(get(came, a.at)) || a.kept), a), a -> a.kept)"""
    return lat.select("h", "unit", "n", F.expr(reached).alias("came")).select("h", "unit", "n", F.expr(back).alias("kept"))


def with_bytes(df: DataFrame, first_byte: int) -> DataFrame:
    """ids of the kept edges; a character without a piece becomes the ids of its UTF-8 bytes."""
    if dict(df.dtypes)["kept"] == "array<bigint>":
        s, i, none = "cast(shiftright(x, 17) as int)", "cast(x & 131071 as int)", f"exists(kept, x -> (x & 131071) = {UNKNOWN})"
    else:
        s, i, none = "x.s", "x.id", f"exists(kept, x -> x.id = {UNKNOWN})"
    hexed = f"hex(encode(substring(unit, {s} + 1, 1), 'UTF-8'))"
    byte_ids = f"transform(sequence(1, length({hexed}), 2), k -> cast(conv(substring({hexed}, k, 2), 16, 10) as int) + {first_byte})"
    return df.select("h", "unit", "n", F.expr(f"if({none}, flatten(transform(kept, x -> if({i} <> {UNKNOWN}, array({i}), {byte_ids}))), transform(kept, x -> {i}))").alias("ids"))


def best_long(unit: str, edges: list[dict], first_byte: int) -> list[int]:
    """The same path as viterbi's, for one long unit."""
    sums, came = [0.0] + [-np.inf] * len(unit), [(-1, -1)] * (len(unit) + 1)
    for x in sorted(edges, key=lambda x: (x["e"], x["s"])):
        if sums[x["s"]] + x["score"] > sums[x["e"]]:
            sums[x["e"]], came[x["e"]] = sums[x["s"]] + x["score"], (x["s"], x["id"])
    out, e = [], len(unit)
    while e > 0:
        s, i = came[e]
        out.append([i] if i != UNKNOWN else [b + first_byte for b in unit[s:e].encode()])
        e = s
    return [i for part in reversed(out) for i in part]


def merge_long(unit: str, edges: list[dict], first_byte: int) -> list[int]:
    """The same merges with a heap, for one long unit."""
    n = len(unit)
    found = {(e["s"], e["e"]): (e["rank"], e["id"]) for e in edges}
    left, right = list(range(-1, n)), list(range(1, n + 2))  # neighbours of each cut point
    alive = [True] * (n + 1)
    heap: list[tuple[float, int, int, int]] = []

    def offer(m: int) -> None:
        if 0 < m < n and (left[m], right[m]) in found:
            heapq.heappush(heap, (found[left[m], right[m]][0], left[m], m, right[m]))

    for m in range(1, n):
        offer(m)
    while heap:
        _, s, m, e = heapq.heappop(heap)
        if alive[m] and left[m] == s and right[m] == e:
            alive[m] = False
            right[s], left[e] = e, s
            offer(s)
            offer(e)
    out, s = [], 0
    while s < n:
        e = right[s]
        i = found[s, e][1]
        out += [i] if i != UNKNOWN else [b + first_byte for b in unit[s:e].encode()]
        s = e
    return out


def encode_units(counts: DataFrame, pieces: DataFrame, longest_piece: int, first_byte: int, unigram: bool = False) -> list[DataFrame]:
    """(unit, ids) of units (unit, n), in two parts: those up to LONGEST, dealt by unit, and longer ones."""
    fold = best_long if unigram else merge_long
    least = pieces.agg(F.min("score")).first()[0] or 0.0

    def long_ones(batches):
        for b in batches:
            names = b.column("unit").to_pylist()
            ids = [fold(u, e, first_byte) for u, e in zip(names, b.column("edges").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("unit"), pa.array(ids, pa.list_(pa.int32()))], ["unit", "ids"])

    parts = max(1, counts.count() // UNITS_PER_PARTITION)
    short, long = counts.filter(F.length("unit") <= LONGEST), counts.filter(F.length("unit") > LONGEST)
    kept = viterbi(scored(short, pieces, longest_piece, parts)) if unigram else folded(lattice(short, pieces, longest_piece, parts))
    edges = edges_of(long, pieces, longest_piece, max(1, parts // 16)).join(F.broadcast(pieces.select("id", "score")), "id", "left")
    rows = edges.groupBy("unit").agg(F.collect_list(F.struct("s", "e", "rank", "id", F.coalesce("score", F.lit(least - UNKNOWN_PENALTY)).alias("score"))).alias("edges"))
    return [with_bytes(kept, first_byte).select("unit", "ids"), rows.mapInArrow(long_ones, "unit string, ids array<int>")]


def decode(encoded: DataFrame, pieces: DataFrame, keys: list[str], ids_col: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """(keys, carry, decoded) of rows with ids: ids are exploded, joined to the piece table and put together as bytes.

    Keys should be distinct. Spaces are left as the sign that stands for them; text_of removes it. Ids outside
    the table add nothing; a null or empty array gives the empty text; malformed bytes become U+FFFD. Rows
    that are already dealt by one of the keys are not shuffled.
    """
    carry = carry or []
    table = pieces.select("id", F.coalesce(F.hex(F.encode("piece", "UTF-8")), F.lpad(F.hex("byte"), 2, "0")).alias("_h"))
    return (
        encoded.select(*keys, *carry, F.posexplode_outer(ids_col).alias("_p", "id"))
        .join(F.broadcast(table), "id", "left")
        .groupBy(*keys)
        .agg(*[F.first(x).alias(x) for x in carry], F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", F.coalesce("_h", F.lit("")).alias("_h")))), lambda x: x["_h"]), "").alias("_h"))
        .select(*keys, *carry, F.decode(F.unhex("_h"), "UTF-8").alias("decoded"))
    )


def text_of(decoded: Column) -> Column:
    """Decoded pieces of a whole text with real spaces, without the dummy one."""
    return F.translate(F.regexp_replace(decoded, f"^{SPACE}", ""), SPACE, " ")


class Encoding:
    """The dictionary of a corpus's units, and its documents over it."""

    def __init__(self, docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text"):
        spark = docs.sparkSession
        self.id_col = id_col
        self.pieces = cut(piece_table(spark, model_file).coalesce(1))
        self.vocabulary = self.pieces.collect()  # of fixed size, whatever the corpus
        self.longest = max(len(r.piece or "") for r in self.vocabulary)
        self.first_byte = min((r.id for r in self.vocabulary if r.byte == 0), default=0)
        pairs = self.pairs = Pairs([r.piece for r in self.vocabulary if r.piece])
        self.docs = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

        def counted(batches):
            times, names = {}, {}
            odd: Counter = Counter()
            for b in (b.slice(at, DOCUMENTS) for b in batches for at in range(0, b.num_rows, DOCUMENTS)):
                texts = [t or "" for t in b.column(0).to_pylist()]
                units = Units(texts, pairs)
                for k, c, u in zip(units.key.tolist(), units.times.tolist(), units.names(), strict=True):
                    if k in times:
                        times[k] += c
                    else:
                        times[k], names[k] = c, u
                odd.update(u for i in units.odd for w in words_of(texts[i]) for u in units_of(w, pairs.pairs))
                if len(times) + len(odd) > CACHE_UNITS:
                    yield _counts(times, names, odd)
                    times, names, odd = {}, {}, Counter()
            yield _counts(times, names, odd)

        rows = self.docs.select("text").mapInArrow(lean(counted), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
        self.counts = written(rows, "sp-units", compression="zstd")
        self.longest_unit = self.counts.agg(F.max(F.length("unit"))).first()[0] or 0
        self.common = self._common()

    def _common(self) -> Column:
        """A filter for at most FREQUENT units: those whose occurrences lie above a step of 2 ** (1 / 8)."""
        step = F.floor(8 * F.log2(F.col("n")))
        left, least = FREQUENT, None
        for r in self.counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("units")).orderBy(F.desc("step")).collect():  # a few hundred steps
            left -= r.units
            if left < 0:
                break
            least = r.step
        return step >= least if least is not None else F.lit(False)

    def encoded(self, counts: DataFrame) -> DataFrame:
        short, long = encode_units(counts, self.pieces, self.longest, self.first_byte)
        return short.unionByName(long) if self.longest_unit > LONGEST else short  # without long ones the units stay dealt as they are

    def documents(self, decoded: bool = False) -> DataFrame:
        """(id_col, ids, round_trip, and decoded if asked for): one row per row of docs.

        ids are those of the whole text; round_trip tells whether decoding them gives the text back. Null and
        empty texts have no ids. Rows that repeat an id are encoded each; rows without an id are dropped. Other
        columns are ignored; an empty table gives an empty result.
        """
        spark, pairs = self.docs.sparkSession, self.pairs
        top = self.encoded(self.counts.filter(self.common)).toArrow()  # at most FREQUENT rows
        frequent = spark.sparkContext.broadcast(Common(top.column(0).to_pylist(), top.column(1).to_pylist()))
        pieces = {r.id: r.piece.encode() if r.piece is not None else bytes([r.byte]) for r in self.vocabulary}
        texts_of = [pieces.get(i, b"") for i in range(max(pieces, default=-1) + 1)]
        lens = np.array([len(x) for x in texts_of], np.int64)
        table = spark.sparkContext.broadcast((lens, np.cumsum(lens) - lens, np.frombuffer(b"".join(texts_of), np.uint8)))

        size = self.docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(1, size // SHARD_BYTES)
        texts = self.docs.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "text")

        def rare_units(batches):
            common = frequent.value
            for b in (b.slice(at, DOCUMENTS) for b in batches for at in range(0, b.num_rows, DOCUMENTS)):
                texts, shard_of = [t or "" for t in b.column(2).to_pylist()], b.column(0).to_numpy()
                units = Units(texts, pairs)
                rare = common.find(units.key) < 0
                names = units.names(rare)
                at = np.flatnonzero(rare[units.of])
                met = np.unique(np.repeat(shard_of, units.size)[at].astype(np.int64) << 32 | units.of[at])
                rows = {(names[n], s) for s, n in zip((met >> 32).tolist(), (met & 0xFFFFFFFF).tolist(), strict=True)}
                # units of irregular texts are asked for whether they are frequent or not: only rare ones are answered
                rows.update((u, int(shard_of[i])) for i in units.odd for w in set(words_of(texts[i])) for u in units_of(w, pairs.pairs))
                rare_names, shards_of = zip(*rows, strict=True) if rows else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(rare_names, pa.string()), pa.array(shards_of, pa.int32())], ["unit", "shard"])

        rare = self.encoded(self.counts.filter(~self.common))
        found = texts.mapInArrow(lean(rare_units), "unit string, shard int").join(rare, "unit").select("shard", "unit", "ids").mapInArrow(lean(_packed_units), "shard int, blob binary")

        def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
            common, rare = frequent.value, dict(x for blob in right.column("blob").to_pylist() for x in _unpacked(blob))
            names, given = zip(*unpack(left.column("blob").to_pylist()), strict=True)
            ends = np.cumsum([len(t) for t in given]) // SLICE_BYTES
            at = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(given)]
            out = pa.concat_tables([put_together(common, rare, names[a:z], given[a:z]) for a, z in zip(at[:-1], at[1:], strict=True)])
            release()
            return out

        def put_together(common: Common, rare: dict, names: tuple, given: tuple) -> pa.Table:
            texts = [t.decode("utf-8", "replace") for t in given]
            units = Units(texts, pairs)
            # ids of the distinct units: the frequent ones stand in an array already, the others behind them
            at = common.find(units.key)
            far = [rare[u] for u in units.names(at < 0) if u]  # no unit is empty
            lens = np.array([len(x) for x in far], np.int64) // 4
            count, start = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            count[at >= 0], start[at >= 0] = common.count[at[at >= 0]], common.start[at[at >= 0]]
            count[at < 0], start[at < 0] = lens, len(common.flat) + np.cumsum(lens) - lens
            flat = np.concatenate((common.flat, np.frombuffer(b"".join(far), np.int32)))

            def of(unit: str) -> bytes:
                if unit in rare:
                    return rare[unit]
                found = int(common.find(keys_of([unit]))[0])
                return (common.ids(found) if found >= 0 else common.named[unit]).tobytes()

            whole = flat[places(start[units.of], count[units.of])]
            cuts = np.concatenate((np.zeros(1, np.int64), np.cumsum(count[units.of])))[np.concatenate((np.zeros(1, np.int64), np.cumsum(units.size)))]
            ids = [whole[a:z] for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            for i in units.odd:
                ids[i] = np.frombuffer(b"".join([of(u) for w in words_of(texts[i]) for u in units_of(w, pairs.pairs)]), np.int32)
            lens, starts, letters = table.value
            back, same = [], []
            for some, t in zip(ids, given, strict=True):
                again = plain_text(letters[places(starts[some], lens[some])].tobytes())
                same.append(again == t)
                if decoded:
                    back.append(again.decode("utf-8", "replace"))
            ends = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(x) for x in ids]))).astype(np.int32)
            out = {"id": pa.array(names, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))), "round_trip": pa.array(same, pa.bool_())}
            return pa.table(out | ({"decoded": pa.array(back, pa.string())} if decoded else {}))

        packed = texts.mapInArrow(lean(_packed_texts), "shard int, blob binary")
        schema = "id long, ids array<int>, round_trip boolean" + ", decoded string" * decoded
        return packed.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(assemble, schema).withColumnRenamed("id", self.id_col)


def _counts(times: dict[int, int], names: dict[int, str], odd: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([*names.values(), *odd], pa.string()), pa.array([*times.values(), *odd.values()], pa.int64())], ["unit", "n"])


def plain_text(decoded: bytes) -> bytes:
    """Decoded pieces of a whole text with real spaces, without the dummy one."""
    return decoded.removeprefix(SPACE.encode()).replace(SPACE.encode(), b" ")


def _packed_texts(batches):
    for b in batches:
        found: dict[int, tuple[list, list]] = {}
        for s, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
            ids, texts = found.setdefault(s, ([], []))
            ids.append(i)
            texts.append(t or b"")
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([pack(*v) for v in found.values()], pa.binary())], ["shard", "blob"])


def _packed_units(batches):
    """Units and their ids by shard, a blob for each shard among PACKED_UNITS rows."""
    for b in gathered(batches, PACKED_UNITS):
        order = np.argsort(b.column(0).to_numpy(), kind="stable")
        b = b.take(pa.array(order))
        shards = b.column(0).to_numpy()
        at = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1]))) if len(shards) else np.zeros(0, int)
        names, ids, blobs = b.column(1).to_pylist(), [np.array(i, np.int32).tobytes() for i in b.column(2).to_pylist()], []
        for a, z in zip(at.tolist(), [*at[1:].tolist(), len(shards)], strict=True):
            blobs.append(pack([len(i) for i in ids[a:z]], [n.encode() + i for n, i in zip(names[a:z], ids[a:z], strict=True)]))
        yield pa.RecordBatch.from_arrays([pa.array(shards[at], pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])


def _unpacked(blob: bytes):
    for n, both in unpack([blob]):
        yield both[:-n].decode(), both[-n:]
