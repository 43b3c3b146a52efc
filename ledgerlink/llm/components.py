"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SALT = 16


def _with_least(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """pairs (u, v) with least.m of their u; u's rows are dealt over SALT tasks, as a hub may have very many."""
    salted = pairs.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALT)).cast("int"))
    dealt = least.select("u", "m", F.explode(F.array(*[F.lit(i) for i in range(SALT)])).alias("s"))
    return salted.join(dealt, ["u", "s"]).select("u", "v", "m")


def connected_components(edges: DataFrame, src: str, dst: str, rounds: int = 50) -> DataFrame:
    """Rows (u, component): every node that has an edge to another node, with the smallest node it can reach.

    Each round is cut by a checkpoint. The number of rounds grows with the logarithm of the longest path.
    Self edges and repeated edges do no harm; a null end drops the edge.
    """
    stars = cut(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    before = None
    for _ in range(rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _with_least(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, least).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return stars.select("u", F.col("v").alias("component"))
