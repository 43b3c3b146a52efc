"""Exact deduplication by a tree merge of sorted digest runs.

Every document belongs to a slot (a hash of its id). A slot's run holds one row per distinct digest: the
best candidate of the slot and the number of its documents. Runs then meet in rounds: slots whose numbers
agree after dropping the low bits exchange their runs, split by leading digest digits so that no task ever
holds a whole run, and a multiway merge keeps the best candidate of each digest. After log(slots) rounds one
run per digest range is left. The way back joins on (digest, slot), so that a digest shared by a third of all
documents is dealt over all slots.

Two texts count as equal only if SHA-256, an independent 64-bit hash and the length of the normalised text
all agree; the three travel together through all rounds (the check of every level).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions

BLANKS = r"[\x20\x09-\x0D]+"
KEY = ["digest", "check", "length"]


def digests(docs: DataFrame, id_col: str, text_col: str, slots: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = F.regexp_replace(text, BLANKS, "")
    return docs.select(
        F.col(id_col).alias("id"),
        F.sha2(norm, 256).alias("digest"),
        F.xxhash64(norm).alias("check"),
        F.length(norm).alias("length"),
        F.length(text).alias("n_chars"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(slots)).cast("int").alias("slot"),
    )


def merge_round(runs: DataFrame, fan_in: int) -> DataFrame:
    """Runs of fan_in neighbouring slots meet, sorted, and are merged to one."""
    return (
        runs.withColumn("slot", F.floor(F.col("slot") / fan_in).cast("int"))
        .withColumn("range", F.substring("digest", 1, 3))
        .repartition("range", "slot")
        .sortWithinPartitions("range", "slot", *KEY)
        .groupBy("range", "slot", *KEY)
        .agg(F.max("best").alias("best"), F.sum("n").alias("n"))
        .drop("range")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int | None = None, fan_in: int = 8) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without the characters [\\x20\\x09-\\x0D]. Of equal texts the
    row with the longest original text (code points), then the smallest id, stays. Null texts count as
    empty, and all empty texts are one group. A null id loses every tie. Rows that repeat an id are each
    counted and reported, and stay or go by their own text. Other columns are ignored, whatever their names. An
    empty table gives an empty result. There are as many slots as shuffle partitions, 64 at least.
    """
    slots = slots or max(64, partitions(docs.sparkSession))
    leaves = cut(digests(docs, id_col, text_col, slots))
    runs = leaves.groupBy(*KEY, "slot").agg(
        F.max(F.struct("n_chars", (-F.col("id")).alias("minus_id"))).alias("best"), F.count(F.lit(1)).alias("n")
    )
    top, width = runs, slots
    while width > 1:
        top, width = merge_round(top, fan_in), -(-width // fan_in)
    groups = top.select(*KEY, (-F.col("best.minus_id")).alias("keep_id"), F.col("n").alias("group_size"))
    by_slot = runs.select(*KEY, "slot").join(groups, KEY)
    return (
        leaves.select("id", *KEY, "slot")
        .join(by_slot, [*KEY, "slot"])
        .select(
            F.col("id").alias(id_col),
            "keep_id",
            "group_size",
            F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
    )
