"""Near-duplicates by SimHash, found by meet-in-the-middle ball hashing.

Two fingerprints within 2r bits have a variant in common that is within r bits of both. So every distinct
fingerprint emits all variants within r bits, rows are shuffled on the variant, and members that meet are
linked. Fingerprints are distinct, so for r = 1 a variant gathers at most 65 of them; neighbours in a
variant's sorted members are linked, which joins all of them. Pairs are deduplicated and their distance is
verified; components come from the links.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components

CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int) -> int:
    """Unsigned 64-bit SimHash; memory is bounded by CHUNK shingles whatever the text's length."""
    words = text.lower().split()  # bytes: only A-Z are lowered, only [\x20\x09-\x0D] split
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    h, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - shingle + 1
    for start in range(0, n, CHUNK):
        part = words[start : min(n, start + CHUNK) + shingle - 1]
        grams = zip(*(part[i:] for i in range(shingle)), strict=False)
        hashes = np.array([h(b" ".join(g), 42) for g in grams], np.uint64)
        counts += np.add.reduce(np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64), axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a signed long. Null texts have no words: fingerprint zero."""

    def of(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t or b"", shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(of, "id long, fp long")


def ball(radius: int) -> list[int]:
    """All signed 64-bit masks of at most radius bits."""
    masks = [sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprint_links(fps: DataFrame, node: str, fp: str, bits: int = 2) -> DataFrame:
    """Links (a, b) between rows of fps, whose fingerprints are distinct, that connect all within bits of each other."""
    masks = F.array(*[F.lit(m).cast("long") for m in ball(-(-bits // 2))])
    variants = fps.select(F.col(node).alias("b"), F.col(fp).alias("fb"), F.explode(masks).alias("mask")).select(
        "b", "fb", F.col("fb").bitwiseXOR(F.col("mask")).alias("variant")
    )
    return meeting(variants, bits)


def meeting(variants: DataFrame, bits: int) -> DataFrame:
    w = Window.partitionBy("variant").orderBy("b")
    return (
        variants.select("b", "fb", F.lag("b").over(w).alias("a"), F.lag("fb").over(w).alias("fa"))
        .filter(F.col("a").isNotNull() & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= bits))
        .select("a", "b")
        .distinct()
    )


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 2) -> DataFrame:
    """One row per row of docs: id_col, fingerprint (16 hex digits), component_id (smallest id reachable).

    bits is at most 2: members that meet on a variant are then linked by neighbours, with no loss. A null
    text counts as empty; empty texts have fingerprint zero and are linked like any other. Rows without an
    id are dropped; rows that repeat an id are reported as often as they occur, each with its own
    fingerprint. Other columns are ignored. An empty table gives an empty result.
    """
    if bits not in (1, 2):
        raise ValueError("bits must be 1 or 2")
    fps = cut(fingerprints(docs, id_col, text_col, shingle).filter("id is not null"))
    nodes = cut(fps.groupBy("fp").agg(F.min("id").alias("node")))
    comps = connected_components(fingerprint_links(nodes, "node", "fp", bits), "a", "b")
    linked = nodes.join(comps, nodes.node == comps.u).select("fp", "component")
    # a fingerprint that a third of all documents share is dealt over SALT tasks
    salt = 16
    classes = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    dealt = classes.select("*", F.explode(F.array(*[F.lit(i) for i in range(salt)])).alias("s"))
    return (
        fps.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(salt)).cast("int"))
        .join(dealt, ["fp", "s"])
        .select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    )
