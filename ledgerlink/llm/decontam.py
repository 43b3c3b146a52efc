"""Benchmark decontamination with one Aho-Corasick automaton over word ids.

Texts are normalised to words (A-Z lowered, ASCII other than letters and digits splits). Every window of
consecutive item words becomes a pattern of word ids; the automaton is compiled once per Python worker and
each document is scanned once. Offsets of hits are mapped back to the original text.

One automaton holds up to MAX_PATTERN_WORDS words of windows, which is some 500,000 benchmark words and far more
than test sets have. The benchmark is broadcast only up to that size; a larger one is split into shards, and
each document passes their automata in turn, in the same task.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: A-Z to a-z; ASCII that is not a letter or digit to a space.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
MAX_PATTERN_WORDS = 5_000_000
HITS = "array<struct<item:string,word:int,words:int,start:int,end:int>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def windows_of(item: bytes, size: int) -> list[tuple[bytes, ...]]:
    w = words_of(item)
    return [tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


def _compile(items: list[tuple[str, bytes]], size: int) -> tuple[dict[bytes, int], ahocorasick.Automaton]:
    ids: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], list[str]] = {}
    for item, text in items:
        for window in windows_of(text, size):
            key = tuple(ids.setdefault(w, len(ids) + 1) for w in window)
            of = owners.setdefault(key, [])
            if item not in of:
                of.append(item)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, of in owners.items():
        automaton.add_word(key, (len(key), of))
    automaton.make_automaton()
    return ids, automaton


def _shards(items: list[tuple[str, bytes]], size: int) -> list[list[tuple[str, bytes]]]:
    shards, room = [[]], MAX_PATTERN_WORDS
    for item in items:
        cost = size * len(words_of(item[1]))
        if cost > room and shards[-1]:
            shards.append([])
            room = MAX_PATTERN_WORDS
        shards[-1].append(item)
        room -= cost
    return shards


def _items(benchmark: DataFrame, item_col: str, item_text: str) -> list[tuple[str, bytes]]:
    """Test sets are small by nature; the shards bound what one automaton holds."""
    rows = benchmark.select(F.col(item_col).cast("string"), F.encode(F.col(item_text), "UTF-8")).filter(F.col(item_col).isNotNull() & F.col(item_text).isNotNull())
    return [(r[0], bytes(r[1])) for r in rows.distinct().toLocalIterator()]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """(id, n_words, hits) per row of docs: hits are the occurrences of windows, by position.

    A hit names the item, the first document word and the number of words, and the code point span in the
    original text, end exclusive. An item of fewer words than the window is one window; an item without
    words, or a null one, is none. A null document has no words. Items that repeat, and equal windows of
    several items, each count for their item_id. Rows that repeat an id stay apart. Other columns of either
    table are ignored.
    """
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast(HITS).alias("hits"))
    for shard in _shards(_items(benchmark, item_col, item_text), window):
        out = _scan(out, docs.sparkSession.sparkContext.broadcast(shard), window)
    return out.select(F.col("id").alias(id_col), "n_words", "hits")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = 10) -> DataFrame:
    """The rows of docs, all columns unchanged, in whose text no window of the benchmark occurs."""
    at = docs.columns.index(text_col)
    for shard in _shards(_items(benchmark, "item_id", "text"), window):
        docs = _clean(docs, docs.sparkSession.sparkContext.broadcast(shard), at, window)
    return docs


def _clean(docs, items, at, window):
    def of(batches):
        ids, automaton = _compile(items.value, window)
        known = ids.get
        for b in batches:
            keep = []
            for text in b.column(at).cast(pa.binary()).to_pylist():
                words = words_of(text or b"")
                keep.append(not words or not ids or next(automaton.iter(tuple([known(w, 0) for w in words])), None) is None)
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(of), docs.schema)


def _scan(docs, items, window):
    """Rows (id, text, n_words, hits) with the hits of one automaton added."""

    def of(batches):
        ids, automaton = _compile(items.value, window)
        known = ids.get
        for b in batches:
            counts, hits = [], []
            for text, before in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), strict=True):
                words = words_of(text or b"")
                counts.append(len(words))
                found = list(automaton.iter(tuple([known(w, 0) for w in words]))) if words and ids else []
                hits.append(before + _located(text, found) if found else before)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(hits, HIT)], ["id", "text", "n_words", "hits"])

    return docs.mapInArrow(of, f"id long, text string, n_words long, hits {HITS}")


HIT = pa.list_(pa.struct([("item", pa.string()), ("word", pa.int32()), ("words", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def _located(text: bytes, found) -> list[dict]:
    spans = [m.span() for m in WORD.finditer(text.lower())]
    points = {}
    out = []
    for last, (n, owners) in found:
        a, z = spans[last - n + 1][0], spans[last][1]
        for x in (a, z):
            if x not in points:
                points[x] = len(text[:x].decode("utf-8", "replace"))
        out += [{"item": o, "word": last - n + 1, "words": n, "start": points[a], "end": points[z]} for o in owners]
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """Per document: words, hit words, items with occurring windows, their digest, and the verdict."""
    hits = benchmark_hits(docs, benchmark, id_col=id_col, **kw)
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item"])))
    # sorted by their first word, each hit adds the words beyond the furthest end so far
    covered = F.aggregate(
        F.array_sort(F.transform("hits", lambda h: F.struct(h["word"].alias("from"), (h["word"] + h["words"]).alias("to")))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda s, h: F.struct(
            (s["n"] + F.greatest(F.lit(0), h["to"] - F.greatest(s["to"], h["from"]))).cast("long").alias("n"),
            F.greatest(s["to"], h["to"]).alias("to"),
        ),
        lambda s: s["n"],
    )
    return hits.select(
        id_col,
        "n_words",
        covered.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )
