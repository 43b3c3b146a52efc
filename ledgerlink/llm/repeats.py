"""Removal of repeated passages with sharded automata of recurring phrases.

A window is WINDOW consecutive words. Every window contains the phrase (PHRASE consecutive words) whose hash
is least in it, so a window that recurs has a recurring phrase of this kind: one in six phrases is enough.

1. Confirm: least phrases are counted over the corpus (pre-aggregated per batch and per task); those that
   occur twice or more are sent to the document shards that hold them.
2. Compile and stream: each shard compiles its recurring phrases into one Aho-Corasick automaton over word
   ids and streams its documents through it, which locates every occurrence. A shard is about SHARD_BYTES of
   text, whatever the corpus, so automata stay small, and the work is linear in the corpus.
3. Judge: the windows around the located phrases travel in runs that share their least phrase and their
   greatest one, and meet on both and a 96-bit hash of their words; of each shard only the first of equal
   windows takes part, so no window has more rows than there are shards, and a phrase that is common in many
   surroundings is dealt over many tasks.
4. Remove: the shards get back the windows that start earlier elsewhere and drop the words they cover.
"""

from __future__ import annotations

import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .word_hashes import Rolling, word_hashes

WINDOW, PHRASE = 20, 8
#: Text of a shard, which one task holds: the number of shards follows the corpus.
SHARD_BYTES = 5 << 20
#: A word in the automata's alphabet: SIGNS characters of as many kinds, each with 32 values, from its hash.
SIGNS = 4
_PAIRS = [np.array([[(k + 1) * 0x1000 + (v & 31), (k + 2) * 0x1000 + (v >> 5)] for v in range(1024)], np.uint32).view(np.uint64).ravel() for k in (0, 2)]


def signs(h: np.ndarray) -> str:
    """Words as characters; different words may look alike, as one in a million does, which only adds candidates."""
    out = np.empty((len(h), 2), np.uint64)
    out[:, 0] = _PAIRS[0][(h >> np.uint64(44)) & np.uint64(1023)]
    out[:, 1] = _PAIRS[1][h >> np.uint64(54)]
    return out.tobytes().decode("utf-32-le")


def sliding(a: np.ndarray, size: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of every run of size values, by doubling."""
    done = 1
    while done < size:
        step = min(done, size - done)
        a = best(a[:-step], a[step:])
        done += step
    return a


def least_places(p: np.ndarray) -> np.ndarray:
    """Places of the phrases that are least in some window, given the hashes of all phrases of a text."""
    spread = WINDOW - PHRASE + 1
    least = sliding(p, spread, np.minimum)
    pad = np.zeros(spread - 1, np.uint64)
    return np.flatnonzero(p == sliding(np.concatenate((pad, least, pad)), spread, np.maximum))


def pack(ids: list[int], texts: list[bytes]) -> bytes:
    lens = np.array([len(t) for t in texts], np.uint32)
    return zstandard.compress(struct.pack("<I", len(ids)) + np.array(ids, np.int64).tobytes() + lens.tobytes() + b"".join(texts), 1)


def unpack(blobs) -> list[tuple[int, bytes]]:
    out = []
    for blob in blobs:
        data = zstandard.decompress(blob)
        n = struct.unpack_from("<I", data)[0]
        ends = np.cumsum(np.frombuffer(data, np.uint32, n, 4 + 8 * n).astype(np.int64)) + 4 + 12 * n
        at = 4 + 12 * n
        for i, end in zip(np.frombuffer(data, np.int64, n, 4).tolist(), ends.tolist(), strict=True):
            out.append((i, data[at:end]))
            at = end
    return sorted(out)


def _shard_of(doc_id, shards: int):
    return F.pmod(F.xxhash64(doc_id.cast("long")), F.lit(shards)).cast("int")


def _by_shard(docs: DataFrame, id_col: str, text_col: str, shards: int) -> DataFrame:
    return docs.filter(F.col(id_col).isNotNull()).select(
        _shard_of(F.col(id_col), shards).alias("shard"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")
    )


def _phrases(docs: DataFrame) -> DataFrame:
    """(phrase, shard, n): n is 2 if the phrase repeats within the batch's documents of the shard."""

    def of(batches):
        for b in batches:
            found: dict[int, list] = {}
            for s, h in zip(b.column(0).to_pylist(), word_hashes([t or b"" for t in b.column(2).cast(pa.binary()).to_pylist()]), strict=True):
                if len(h) >= WINDOW:
                    p = Rolling(h).at(PHRASE)
                    found.setdefault(s, []).append(p[least_places(p)])
            for s, parts in found.items():
                p, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_pydict({"phrase": p.view(np.int64), "shard": np.full(len(p), s, np.int32), "n": np.minimum(n, 2).astype(np.int32)})

    return docs.mapInArrow(of, "phrase long, shard int, n int")


def _packed(docs: DataFrame) -> DataFrame:
    """(shard, blob): compressed texts, as the corpus is shuffled twice."""

    def of(batches):
        for b in batches:
            found: dict[int, tuple[list, list]] = {}
            for s, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                ids, texts = found.setdefault(s, ([], []))
                ids.append(i)
                texts.append(t or b"")
            yield pa.RecordBatch.from_pydict({"shard": pa.array(list(found), pa.int32()), "blob": pa.array([pack(*v) for v in found.values()], pa.binary())})

    return docs.mapInArrow(of, "shard int, blob binary")


FOUND = pa.schema([("phrase", pa.int64()), ("deal", pa.int32()), ("id", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("hashes", pa.list_(pa.int64())), ("checks", pa.list_(pa.int32()))])


def automaton_of(phrases) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in phrases:
        automaton.add_word(p)
    automaton.make_automaton()
    return automaton


def _locate(left: pa.Table, right: pa.Table) -> pa.Table:
    """Candidate windows of a shard, in runs that share their least phrase, and windows that repeat in the shard.

    Of equal windows in the shard only the first is a candidate (hashes, checks: one of each per window); the
    others are runs without hashes. deal spreads the runs of one phrase by what else their windows have in common.
    """
    if not len(right) or not len(left):
        return FOUND.empty_table()
    recurring = np.unique(right.column("phrase").to_numpy().view(np.uint64))
    sieve = np.zeros(1 << 20, bool)
    sieve[recurring >> np.uint64(44)] = True
    names, texts = zip(*unpack(left.column("blob").to_pylist()), strict=True)
    words, docs, places, hashes = word_hashes(texts), [], [], []
    for n, h in enumerate(words):
        if len(h) < WINDOW:
            continue
        p = Rolling(h).at(PHRASE)
        maybe = np.flatnonzero(sieve[p >> np.uint64(44)])
        at = np.minimum(np.searchsorted(recurring, p[maybe]), len(recurring) - 1)
        maybe = maybe[recurring[at] == p[maybe]]
        docs.append(n)
        places.append(np.stack((np.full(len(maybe), n), maybe)))
        hashes.append(p[maybe])
    if not docs:
        return FOUND.empty_table()
    # one occurrence gives the phrase; the automaton locates all
    where = np.concatenate(places, axis=1)[:, np.unique(np.concatenate(hashes), return_index=True)[1]]
    automaton = automaton_of(signs(words[n][k : k + PHRASE]) for n, k in where.T.tolist())
    if not len(automaton):
        return FOUND.empty_table()
    parts, spread = [], WINDOW - PHRASE + 1
    for n in docs:
        h = words[n]
        ends = [e for e, _ in automaton.iter(signs(h))]
        if not ends:
            continue
        starts = len(h) - WINDOW + 1
        e = np.array(ends) // SIGNS
        marks = np.bincount(np.maximum(e - WINDOW + 1, 0), minlength=len(h) + 1) - np.bincount(e - PHRASE + 2, minlength=len(h) + 1)
        pos = np.flatnonzero(np.cumsum(marks)[:starts] > 0)  # windows that hold a located phrase whole
        if len(pos):
            rolling = Rolling(h)
            phrase = rolling.at(PHRASE)
            x = Rolling(word_hashes([texts[n]], 1)[0], 1).at(WINDOW, pos)
            parts.append((rolling.at(WINDOW, pos), (x >> np.uint64(32)).astype(np.uint32).view(np.int32), sliding(phrase, spread, np.minimum)[pos], sliding(phrase, spread, np.maximum)[pos], np.full(len(pos), n), pos))
    if not parts:
        return FOUND.empty_table()
    w, x, least, most, n, pos = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((x, w))  # stable: equal windows stay in order of document and place
    same = (w[order][1:] == w[order][:-1]) & (x[order][1:] == x[order][:-1])
    first = np.ones(len(w), bool)
    first[order[1:][same]] = False
    names = np.array(names)
    rn, rp, rl = runs(n[~first], pos[~first])
    w, x, least, most, n, pos = w[first], x[first], least[first], most[first], n[first], pos[first]
    new = np.ones(len(w), bool)
    new[1:] = (n[1:] != n[:-1]) | (pos[1:] != pos[:-1] + 1) | (least[1:] != least[:-1]) | (most[1:] != most[:-1])
    at = np.flatnonzero(new)
    cuts = np.append(at, len(w)).astype(np.int32)
    cuts = np.concatenate((cuts, np.full(len(rn), len(w), np.int32)))
    return pa.Table.from_arrays(
        [
            pa.array(np.concatenate((least[at].view(np.int64), names[rn] * 31 + rp))),
            pa.array(np.concatenate(((most[at] >> np.uint64(33)).astype(np.int32), np.zeros(len(rn), np.int32)))),
            pa.array(np.concatenate((names[n[at]], names[rn]))),
            pa.array(np.concatenate((pos[at], rp)).astype(np.int32)),
            pa.array(np.concatenate((np.diff(np.append(at, len(w))), rl)).astype(np.int32)),
            pa.ListArray.from_arrays(pa.array(cuts), pa.array(w.view(np.int64))),
            pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)),
        ],
        schema=FOUND,
    )


def runs(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive positions of a document as (document, first, number)."""
    if not len(doc):
        return doc, pos, pos
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)
    at = np.flatnonzero(new)
    return doc[at], pos[at], np.diff(np.append(at, len(doc)))


KEPT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])


def _remove(left: pa.Table, right: pa.Table) -> pa.Table:
    ids, pos, lens = (right.column(c).to_numpy() for c in ("id", "pos", "len"))
    order = np.argsort(ids, kind="stable")
    ids, pos, lens = ids[order], pos[order], lens[order]
    rows = []
    for i, text in unpack(left.column("blob").to_pylist()):
        words = text.split()
        a, z = np.searchsorted(ids, (i, i + 1))
        removed = 0
        if a < z:
            n = len(words) + 1
            marks = np.bincount(pos[a:z], minlength=n) - np.bincount(pos[a:z] + lens[a:z] + WINDOW - 1, minlength=n)
            keep = np.cumsum(marks)[:-1] <= 0
            removed = len(words) - int(keep.sum())
            kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
        else:
            kept = words
        rows.append((i, len(words), removed, b" ".join(kept).decode("utf-8")))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), KEPT, strict=True)], schema=KEPT) if rows else KEPT.empty_table()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_words, n_removed, kept_text (kept words, joined by one space).

    A word goes if a window of WINDOW consecutive words covers it whose word sequence also starts earlier:
    in a document of smaller id, or earlier in the same one. Windows are judged on the input. Null and empty
    texts have no words; texts of fewer words than a window are kept whole. Ids should be distinct; rows that
    repeat an id are treated as one document's, each reported. Rows without an id are dropped. Other columns
    are ignored. An empty table gives an empty result.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    shards = max(1, size // SHARD_BYTES)
    texts = _by_shard(docs, id_col, text_col, shards)
    phrases = written(_phrases(texts), "repeat-phrases", compression="zstd")  # read twice, made once
    recurring = phrases.groupBy("phrase").agg(F.sum("n").alias("n")).filter("n > 1").select("phrase")
    wanted = phrases.select("phrase", "shard").join(recurring, "phrase", "left_semi")
    packed = _packed(texts)
    found = packed.groupBy("shard").cogroup(wanted.groupBy("shard")).applyInArrow(
        _locate, "phrase long, deal int, id long, pos int, n int, hashes array<long>, checks array<int>"
    )
    # equal windows have the same least and greatest phrases: their runs meet on them, and are taken apart only there
    apart = F.when(F.size("hashes") > 0, F.transform(F.arrays_zip("hashes", "checks"), lambda z, i: F.struct(z["hashes"].alias("w"), z["checks"].alias("x"), (F.col("pos") + i).alias("pos"), F.lit(1).alias("n"))))
    whole = F.array(F.struct(F.lit(None).cast("long").alias("w"), F.lit(None).cast("int").alias("x"), "pos", "n"))
    windows = found.repartition("phrase", "deal").select("phrase", "deal", "id", F.inline(F.coalesce(apart, whole)))
    here = F.struct("id", "pos")
    repeats = (
        windows.select("id", "pos", "n", "w", F.min(here).over(Window.partitionBy("phrase", "deal", "w", "x")).alias("first"))
        .filter(F.col("w").isNull() | (here != F.col("first")))
        .select(_shard_of(F.col("id"), shards).alias("shard"), "id", "pos", F.col("n").alias("len"))
    )
    return (
        packed.groupBy("shard").cogroup(repeats.groupBy("shard")).applyInArrow(_remove, "id long, n_words long, n_removed long, kept_text string")
        .withColumnRenamed("id", id_col)
    )
