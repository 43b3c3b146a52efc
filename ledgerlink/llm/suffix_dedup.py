"""Removal of byte strings that occur more than once, by a sparse suffix array over the corpus.

A window is LENGTH bytes of one document. Its anchor is the place of the phrase (PHRASE bytes) whose hash is least in
it, the leftmost of equal ones: equal windows have their anchors at the same distance from their start. So only
suffixes that begin at anchors are sorted, some one in 90, each with the text that its windows need on either side
(a segment).

1. Count: phrases of anchors are counted by hash; only segments of phrases that recur go on. Equal segments of a
   shard (about SHARD_BYTES of text) are one row, and their windows are known to repeat.
2. Partition: sampled splitters (those of Spark's range exchange) part the suffixes by their leading bytes, so that
   a bucket has all suffixes of its phrases.
3. Sort: a bucket sorts its suffixes by multikey quicksort, 8 bytes a key, and the texts before the anchors,
   read backwards, likewise. A window repeats if another suffix agrees with its own in both orders as far as the
   window reaches; agreement is a range of each order, found from what neighbours have in common. Bytes are
   compared, never hashes.
4. Compare across boundaries: a phrase of more than CROWDED segments would fill a bucket by itself. Its segments are
   dealt over many buckets; each keeps one suffix of LENGTH bytes for every different window. These are range-
   partitioned by content and place, sorted by multikey quicksort and compared with their neighbours, the last of
   a bucket with the first of the next.
5. Remove: spans of repeated windows go back to the shards, which drop the bytes that they cover.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_ids, written
from .repeats import sliding
from .word_hashes import mixed

LENGTH, PHRASE = 200, 24
SPREAD = LENGTH - PHRASE + 1
#: Text of a shard, which one task holds: the number of shards follows the corpus.
SHARD_BYTES = 5 << 20
#: Suffixes of a bucket, about (some 6 MB); and the number of segments from which a phrase is dealt over many buckets.
BUCKET, CROWDED = 20_000, 20_000
#: Windows of a text that are hashed at a time, and the bits that hold their places.
PIECE, PLACE_BITS = 1 << 15, 16
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)]
#: The first r of 8 bytes, as a mask.
_FRONT = np.array([((1 << 8 * r) - 1) << 8 * (8 - r) for r in range(9)], np.uint64)


def phrase_hashes(x: np.ndarray) -> np.ndarray:
    """A hash of the PHRASE bytes at every place of x."""
    n = len(x) - PHRASE + 1
    at = lambda k: np.ndarray((n,), "<u8", x, 8 * k, (1,))
    h = mixed(at(0) * _FACTORS[0])
    for k in (1, 2):
        h = mixed((h ^ at(k)) * _FACTORS[k])
    return h


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per anchor of a text: the hash of its phrase, its place, the first of its windows and their number."""
    parts, whole = [], np.frombuffer(text, np.uint8)
    low = np.uint64((1 << PLACE_BITS) - 1)
    for s in range(0, len(text) - LENGTH + 1, PIECE):
        x = whole[s : s + PIECE + LENGTH - 1]
        h = phrase_hashes(x)
        least = sliding((h & ~low) | np.arange(len(h), dtype=np.uint64), SPREAD, np.minimum) & low
        at = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        place = least[at].astype(np.int64)
        parts.append((h[place], place + s, at + s, np.diff(np.append(at, len(least)))))
    if not parts:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _keys(data: np.ndarray, at: np.ndarray, size: np.ndarray, depth: int) -> np.ndarray:
    """Eight bytes of each text from depth on, as numbers that sort like them; zero beyond its size."""
    eight = np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))
    key = eight[np.minimum(at + depth, len(data) - 8)].astype(np.uint64)
    return key & _FRONT[np.clip(size - depth, 0, 8)]


def suffix_order(data: np.ndarray, at: np.ndarray, size: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the texts that begin at `at`, and how many bytes each has in common with the one before (most: all).

    Multikey quicksort by keys of 8 bytes: all groups that agree so far are sorted by their next key and parted
    into those of equal keys; groups of one are done. data ends with 8 zeros; a text counts as followed by zeros.
    """
    order, common = np.arange(len(at)), np.full(len(at), most)
    common[:1] = 0
    open_, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    for depth in range(0, most, 8):
        if len(open_) < 2:
            break
        rows = order[open_]
        key = _keys(data, at[rows], size[rows], depth)
        by = np.lexsort((key, group))
        order[open_], key = rows[by], key[by]
        inside = group[1:] == group[:-1]
        parted = inside & (key[1:] != key[:-1])
        x = key[1:][parted] ^ key[:-1][parted]
        same = sum((x >> np.uint64(64 - 8 * b) == 0).astype(np.int64) for b in range(1, 8))
        common[open_[1:][parted]] = np.minimum(depth + same, most)
        new = np.concatenate(([True], ~inside | parted))
        group = np.cumsum(new) - 1
        more = np.bincount(group)[group] > 1
        open_, group = open_[more], group[more]
    return order, common


def window_classes(segments: list[bytes], left: np.ndarray, count: np.ndarray, weight: np.ndarray):
    """For each distance j between a window's start and its anchor: (j, rows, class of each row's window, weight of the classes).

    Only windows that may have an equal are given: those that reach no further than the texts that the suffix
    has in common with its neighbours, on either side. A segment's anchor is `left` bytes from its start.
    """
    text = np.frombuffer(b"".join(segments), np.uint8)
    size = np.array([len(s) for s in segments])
    anchor = np.cumsum(size) - size + left
    pad = np.zeros(8, np.uint8)
    ranks, commons, reach = [], [], []
    for data, at, long, most in (
        (np.concatenate((text, pad)), anchor, np.minimum(size - left, LENGTH), LENGTH), (np.concatenate((text[::-1], pad)), len(text) - anchor, left, LENGTH - PHRASE)
    ):
        order, common = suffix_order(data, at, long, most)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ranks.append(rank)
        commons.append(common)
        reach.append(np.maximum(common, np.append(common[1:], 0))[rank])
    # a row of weight 2 has an equal already, whatever its neighbours
    reach = [np.where(weight > 1, LENGTH, r) for r in reach]
    least, most = np.maximum(left - count + 1, LENGTH - reach[0]), np.minimum(left, reach[1])
    for j in range(max(0, int(least.min(initial=LENGTH))), int(most.max(initial=-1)) + 1):
        rows = np.flatnonzero((least <= j) & (most >= j))
        if len(rows):
            after, before = (np.cumsum(c < reach_)[r[rows]] for c, r, reach_ in zip(commons, ranks, (LENGTH - j, j), strict=True))
            _, of = np.unique(after * (len(left) + 1) + before, return_inverse=True)
            yield j, rows, of, np.bincount(of, weight[rows])


SPAN = "shard int, slot int, pos int, n int"


def _spans(shard: np.ndarray, slot: np.ndarray, pos: np.ndarray, n: np.ndarray) -> dict:
    """Spans of windows as columns, adjoining ones joined."""
    order = np.lexsort((pos, slot, shard))
    shard, slot, pos, n = (np.asarray(x)[order] for x in (shard, slot, pos, n))
    new = np.ones(len(pos), bool)
    new[1:] = (shard[1:] != shard[:-1]) | (slot[1:] != slot[:-1]) | (pos[1:] != (pos + n)[:-1])
    at = np.flatnonzero(new)
    total = np.add.reduceat(n, at) if len(at) else n
    return {k: np.asarray(v).astype(np.int32) for k, v in (("shard", shard[at]), ("slot", slot[at]), ("pos", pos[at]), ("n", total))}


def pack(rows: list[tuple]) -> bytes:
    return zstandard.compress(pickle.dumps(rows, 5), 1)


def unpack(blobs) -> list[tuple]:
    """(id, text) of a shard, in the same order every time; a row's place is its slot."""
    rows = [r for b in blobs for r in pickle.loads(zstandard.decompress(b))]
    return sorted(rows, key=lambda r: (r[0] is None, 0 if r[0] is None else r[0], r[1]))


def _rows(batch) -> list[tuple]:
    return list(zip(*(batch.column(k).to_pylist() for k in (0, 1)), (t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()), strict=True))


def _phrases(texts: DataFrame) -> DataFrame:
    """(phrase, shard, n) of a batch's texts: n is 2 if the phrase has more than one anchor there."""

    def of(batches):
        for b in batches:
            found: dict[int, list] = {}
            for s, _, t in _rows(b):
                if len(t) >= LENGTH:
                    found.setdefault(s, []).append(anchors(t)[0])
            for s, parts in found.items():
                p, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_pydict({"phrase": p.view(np.int64), "shard": np.full(len(p), s, np.int32), "n": np.minimum(n, 2).astype(np.int32)})

    return texts.mapInArrow(of, "phrase long, shard int, n int")


def _packed(texts: DataFrame) -> DataFrame:
    def of(batches):
        for b in batches:
            found: dict[int, list] = {}
            for s, i, t in _rows(b):
                found.setdefault(s, []).append((i, t))
            yield pa.RecordBatch.from_pydict({"shard": pa.array(list(found), pa.int32()), "blob": pa.array([pack(v) for v in found.values()], pa.binary())})

    return texts.mapInArrow(of, "shard int, blob binary")


SEGMENTS = pa.schema([*((c, pa.int32()) for c in ("shard", "slot", "pos", "n", "left", "weight")), ("lead", pa.int64()), ("phrase", pa.int64()), ("segment", pa.binary())])


def _locate(left: pa.Table, right: pa.Table) -> pa.Table:
    """Segments of a shard's recurring phrases: one row for equal ones (weight 2), and the spans that are known to repeat (no segment)."""
    if not len(right) or not len(left):
        return SEGMENTS.empty_table()
    shard = left.column("shard")[0].as_py()
    recurring = np.unique(right.column("phrase").to_numpy().view(np.uint64))
    first: dict[tuple, list] = {}
    known = []
    for slot, (_, text) in enumerate(unpack(left.column("blob").to_pylist())):
        if len(text) < LENGTH:
            continue
        h, place, start, count = anchors(text)
        near = recurring[np.minimum(np.searchsorted(recurring, h), len(recurring) - 1)]
        for k in np.flatnonzero(near == h).tolist():
            s, c = int(start[k]), int(count[k])
            key = (text[s : s + c - 1 + LENGTH], int(place[k]) - s)
            row = first.get(key)
            if row is None:
                lead = int.from_bytes(text[s + key[1] : s + key[1] + 8], "big") - (1 << 63)  # sorts like the bytes
                first[key] = [slot, s, c, 1, lead, int(h[k].view(np.int64))]
                continue
            if row[3] == 1:
                row[3] = 2
                known.append((row[0], row[1], c))
            known.append((slot, s, c))
    rows = [(shard, slot, s, c, key[1], w, lead, phrase, key[0]) for key, (slot, s, c, w, lead, phrase) in first.items()]
    if known:
        spans = _spans(np.full(len(known), shard), *(np.array(c) for c in zip(*known, strict=True)))
        rows += [(*r, None, 0, None, None, None) for r in zip(*(spans[c].tolist() for c in ("shard", "slot", "pos", "n")), strict=True)]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SEGMENTS, strict=True)], schema=SEGMENTS) if rows else SEGMENTS.empty_table()


def _gathered(batches):
    """All rows of a bucket: its columns as arrays, and its byte strings."""
    table = pa.Table.from_batches(list(batches))
    ints = {c: table.column(c).to_numpy().astype(np.int64) for c in table.column_names if c != "segment"}
    return ints, table.column("segment").to_pylist()


def _found(b: dict, rows: np.ndarray, j: np.ndarray) -> dict:
    """Windows of rows, j bytes before their anchors, as spans; rows of weight 2 are known to repeat already."""
    one = b["weight"][rows] == 1
    rows, j = rows[one], j[one]
    return _spans(b["shard"][rows], b["slot"][rows], b["pos"][rows] + b["left"][rows] - j, np.ones(len(rows), np.int64))


def _bucket(batches):
    """Spans of the windows that repeat, of a bucket that has all suffixes of its phrases."""
    batches = [b for b in batches if b.num_rows]
    if batches:
        b, segments = _gathered(batches)
        hits = [(rows[total[of] > 1], j) for j, rows, of, total in window_classes(segments, b["left"], b["n"], b["weight"])]
        if hits:
            yield pa.RecordBatch.from_pydict(_found(b, np.concatenate([r for r, _ in hits]), np.concatenate([np.full(len(r), j) for r, j in hits])))


def _representatives(batches):
    """Of some of the segments of crowded phrases: one suffix of LENGTH bytes for each different window; spans of the others.

    Windows that reach further than any neighbour here may still have equals in other buckets, so every window is given.
    """
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    b, segments = _gathered(batches)
    seen = np.zeros((len(segments), SPREAD), bool)
    rows_, js, hits, hit_js, weights = [], [], [], [], []
    for j, rows, of, total in window_classes(segments, b["left"], b["n"], b["weight"]):
        seen[rows, j] = True
        _, first = np.unique(of, return_index=True)
        rows_.append(rows[first])
        js.append(np.full(len(first), j))
        weights.append(np.minimum(total, 2))
        again = total[of] > 1
        hits.append(rows[again])
        hit_js.append(np.full(int(again.sum()), j))
    j = np.arange(SPREAD)
    lone = (j >= (b["left"] - b["n"] + 1)[:, None]) & (j <= b["left"][:, None]) & ~seen
    r, j = np.nonzero(lone)
    rows_.append(r)
    js.append(j)
    weights.append(b["weight"][r])
    rows, j, weight = (np.concatenate(x) for x in (rows_, js, weights))
    spans = _found(b, np.concatenate(hits), np.concatenate(hit_js)) if hits else _spans(*(np.zeros(0, np.int64) for _ in range(4)))
    yield pa.RecordBatch.from_pydict(spans | {"weight": pa.array([0] * len(spans["n"]), pa.int32()), "segment": pa.nulls(len(spans["n"]), pa.binary())})
    pos = b["pos"][rows] + b["left"][rows] - j
    for at in range(0, len(rows), BUCKET):
        r, p = rows[at : at + BUCKET], pos[at : at + BUCKET]
        off = (p - b["pos"][r]).tolist()
        yield pa.RecordBatch.from_pydict({
            "shard": b["shard"][r].astype(np.int32), "slot": b["slot"][r].astype(np.int32), "pos": p.astype(np.int32), "n": np.ones(len(r), np.int32),
            "weight": weight[at : at + BUCKET].astype(np.int32), "segment": pa.array([segments[k][o : o + LENGTH] for k, o in zip(r.tolist(), off, strict=True)], pa.binary()),
        })


def _suffixes(batches):
    """Spans of the suffixes that equal a neighbour in this bucket (side null), and the bucket's first (0) and last (1)."""
    from pyspark import TaskContext

    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    b, segments = _gathered(batches)
    data = np.frombuffer(b"".join(segments) + bytes(8), np.uint8)
    order, common = suffix_order(data, np.arange(len(segments)) * LENGTH, np.full(len(segments), LENGTH), LENGTH)
    equal = (common >= LENGTH) | np.append(common[1:] >= LENGTH, False)
    hit = order[equal & (b["weight"][order] == 1)]
    spans = _spans(b["shard"][hit], b["slot"][hit], b["pos"][hit], np.ones(len(hit), np.int64))
    none = len(spans["n"])
    yield pa.RecordBatch.from_pydict(spans | {"weight": pa.nulls(none, pa.int32()), "bucket": pa.nulls(none, pa.int32()), "side": pa.nulls(none, pa.int32()), "segment": pa.nulls(none, pa.binary())})
    edge = order[[0, -1]]
    ints = {c: b[c][edge].astype(np.int32) for c in ("shard", "slot", "pos", "n", "weight")}
    yield pa.RecordBatch.from_pydict(ints | {"bucket": pa.array([TaskContext.get().partitionId()] * 2, pa.int32()), "side": pa.array([0, 1], pa.int32()), "segment": pa.array([segments[k] for k in edge.tolist()], pa.binary())})


def _crowded_spans(segments: DataFrame) -> DataFrame:
    """Repeated windows of segments of crowded phrases, whatever buckets they are in."""
    names = ["shard", "slot", "pos", "n"]
    n = segments.count() // BUCKET + 1
    dealt = segments.repartitionByRange(n, "lead", "phrase", "shard", "slot", "pos")
    windows = written(dealt.mapInArrow(_representatives, f"{SPAN}, weight int, segment binary"), "suffix-windows", compression="zstd")
    suffixes = windows.filter("segment is not null")
    buckets = suffixes.count() // (2 * BUCKET) + 1
    # equal suffixes may part between buckets, by their places: no suffix is too common
    sorted_ = suffixes.repartitionByRange(buckets, "segment", "shard", "slot", "pos").mapInArrow(_suffixes, f"{SPAN}, weight int, bucket int, side int, segment binary")
    found = written(sorted_, "suffix-sorted", compression="zstd")
    edges = Window.orderBy("bucket", "side")  # two rows a bucket
    beside = F.when(F.col("side") == 0, F.lag("segment").over(edges)).otherwise(F.lead("segment").over(edges))
    across = found.filter("side is not null").withColumn("_beside", beside).filter((F.col("_beside") == F.col("segment")) & (F.col("weight") == 1)).select(*names)
    return windows.filter("segment is null").select(*names).unionByName(found.filter("side is null").select(*names)).unionByName(across)


def _remover(kind: pa.DataType):
    kept = pa.schema([("id", kind), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def of(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.lexsort((right.column("pos").to_numpy(), right.column("slot").to_numpy()))
        slot, pos, n = (right.column(c).to_numpy().astype(np.int64)[order] for c in ("slot", "pos", "n"))
        rows = []
        for k, (i, text) in enumerate(unpack(left.column("blob").to_pylist())):
            a, z = np.searchsorted(slot, (k, k + 1))
            spans: list[dict] = []
            for start, end in zip(pos[a:z].tolist(), (pos + n + LENGTH - 1)[a:z].tolist(), strict=True):
                if spans and start <= spans[-1]["end"]:
                    spans[-1]["end"] = max(end, spans[-1]["end"])
                else:
                    spans.append({"start": start, "end": end})
            cuts = [0, *(x for s in spans for x in (s["start"], s["end"])), len(text)]
            rows.append((i, len(text), sum(s["end"] - s["start"] for s in spans), spans, b"".join(text[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True))))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kept, strict=True)], schema=kept) if rows else kept.empty_table()

    return of


def remove_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_removed, spans (start, end of the removed runs of bytes), kept (binary).

    Texts are their UTF-8 bytes; null counts as empty. A byte goes if LENGTH bytes that cover it also begin anywhere
    else, in the same document or another; all of the occurrences go. What is kept may begin or end inside a
    character, so it is binary. Every row is a document of its own, also if it repeats an id or has none; rows alike
    in all are copies of each other. Shorter texts are kept whole. Ids are whole numbers. Other columns are ignored.
    An empty table gives an empty result.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards = max(1, size // SHARD_BYTES)
    own = F.pmod(F.xxhash64(F.col(id_col), F.octet_length(text_col)), F.lit(shards)).cast("int")
    texts = docs.select(own.alias("shard"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    phrases = written(_phrases(texts), "suffix-phrases", compression="zstd")  # read twice, made once
    recurring = phrases.groupBy("phrase").agg(F.sum("n").alias("n")).filter("n > 1").select("phrase")
    wanted = phrases.select("phrase", "shard").join(recurring, "phrase", "left_semi")
    packed = _packed(texts)
    located = packed.groupBy("shard").cogroup(wanted.groupBy("shard")).applyInArrow(_locate, f"{SPAN}, left int, weight int, lead long, phrase long, segment binary")
    found = written(located, "suffix-segments", compression="zstd")
    segments = found.filter("segment is not null")
    number, crowds = segments.count(), segments.groupBy("phrase").count().filter(F.col("count") > CROWDED).select("phrase")
    crowded = checked_ids(crowds)
    buckets = segments.join(crowded, "phrase", "left_anti").repartitionByRange(number // BUCKET + 1, "lead", "phrase")
    spans = (
        found.filter("segment is null").select("shard", "slot", "pos", "n")
        .unionByName(buckets.mapInArrow(_bucket, SPAN))
        .unionByName(_crowded_spans(segments.join(crowded, "phrase", "left_semi")))
    )
    out = packed.groupBy("shard").cogroup(spans.groupBy("shard")).applyInArrow(
        _remover(pa.int64()), "id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"
    )
    return out.withColumnRenamed("id", id_col)
