"""Lloyd's clustering over integer vectors, sharded by dimension.

Vectors are turned into integers and cut into blocks of columns. A row of the shards is one block of one chunk of
vectors; it stays where it is for all rounds. In each round

1. tasks over column blocks compute exact partial squared distances to their slice of every centroid;
2. reduceByKey adds the blocks of a chunk and takes the nearest centroid of each vector (ties: the smaller number);
3. the choices, one byte a vector, go back to the chunk's blocks, whose sums and counts are added by block
   (combined in each task first), and each block makes its own slice of the new centroids.

Slices are all that the driver sees: CENTROIDS x the vector's length integers a round.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, written

CENTROIDS, ROUNDS, COMPONENTS, SCALE = 8, 10, 64, 1024
#: Columns of a block, and vectors of a chunk at most.
BLOCK, CHUNK = 16, 4096
#: Components up to this size have exact distances in 64 bits; larger ones are computed as Python integers.
NARROW = 1 << 27


def scaled(x: float) -> int:
    """floor(SCALE * x), exact for every finite x."""
    return int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE)


def encode(values: np.ndarray) -> bytes:
    """A block of doubles as integers: 64 bits each, or as text if any is not narrow."""
    if len(values) and np.abs(values).max() * SCALE < NARROW:
        return b"\0" + np.floor(values * SCALE).astype(np.int64).tobytes()
    return b"\1" + " ".join(str(scaled(x)) for x in values.ravel().tolist()).encode()


def decode(blob: bytes, columns: int) -> np.ndarray:
    """The integers of a block, one row per vector; as objects if not all are narrow."""
    if blob[:1] == b"\0":
        return np.frombuffer(blob, np.int64, -1, 1).reshape(-1, columns)
    return as_integers([int(x) for x in blob[1:].split()]).reshape(-1, columns)


def as_integers(values: list[int]) -> np.ndarray:
    small = all(-NARROW <= v <= NARROW for v in values)
    return np.array(values, np.int64 if small else object)


def partial_distances(x: np.ndarray, slices: np.ndarray) -> np.ndarray:
    """Squared distances of the block's columns, one row per vector and one column per centroid."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in slices], axis=1)


def partial_sums(x: np.ndarray, choice: np.ndarray, k: int) -> list:
    """Per centroid the number of its vectors and the sums of the block's columns, as Python integers."""
    return [np.array([int((choice == c).sum()), *(int(v) for v in x[choice == c].sum(axis=0))], object) for c in range(k)]


def _shards(vectors: DataFrame) -> DataFrame:
    """(chunk, block, data, ids) of (id, v) rows; block -1 has the chunk's ids. A chunk is named by its first row's place."""
    fields = f"chunk string, block int, data binary, ids array<{dict(vectors.dtypes)['id']}>"

    def of(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            for first in range(0, b.num_rows, CHUNK):
                piece = b.slice(first, CHUNK)
                x = piece.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(piece.num_rows, COMPONENTS)
                data = [None, *(encode(x[:, c : c + BLOCK]) for c in range(0, COMPONENTS, BLOCK))]
                ids = [piece.column(0).to_pylist(), *[None] * (len(data) - 1)]
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array([f"{part}-{at}"] * len(data)), "block": pa.array(range(-1, len(data) - 1), pa.int32()), "data": pa.array(data, pa.binary()),
                    "ids": pa.array(ids, pa.list_(piece.column(0).type)),
                })
                at += piece.num_rows

    return written(vectors.mapInArrow(of, fields), "lloyd-shards")


def _starts(vectors: DataFrame) -> list[list[int]]:
    """The first centroids: the vectors whose ids have the smallest hashes; rows without an id are none."""
    hashed = vectors.filter("id is not null").select(F.sha2(F.concat(F.lit("3:"), F.col("id").cast("string")), 256).alias("h"), "v")
    return [[scaled(x) for x in r.v] for r in hashed.orderBy("h", "v").limit(CENTROIDS).collect()]


def _blocks(centroids: list[list[int]]) -> list[np.ndarray]:
    """The centroids' slices, one array (centroid, column) per block."""
    return [as_integers([v for c in centroids for v in c[b : b + BLOCK]]).reshape(len(centroids), -1) for b in range(0, COMPONENTS, BLOCK)]


def _distances(shards: RDD, slices, n: int) -> RDD:
    """(chunk, distances): the blocks' partial distances, added."""
    return shards.map(lambda s: (s[0][1], partial_distances(s[1], slices.value[s[0][0]]))).reduceByKey(lambda a, b: a + b, n)


def _updated(shards: RDD, distances: RDD, slices: list[np.ndarray], n: int) -> list[np.ndarray]:
    """New slices: every block adds its columns over the chosen vectors and divides; empty centroids stay."""
    k, blocks = len(slices[0]), len(slices)
    choice = distances.flatMap(lambda d: [((b, d[0]), d[1].argmin(axis=1).astype(np.int8)) for b in range(blocks)])

    def slice_of(block_sums):
        block, sums = block_sums
        return block, [[int(v) // int(s[0]) for v in s[1:]] if s[0] else None for s in sums]

    # the shards are dealt by (block, chunk) once: only the choices move
    made = dict(
        shards.join(choice, n).map(lambda s: (s[0][0], partial_sums(s[1][0], s[1][1], k)))
        .reduceByKey(lambda a, b: [x + y for x, y in zip(a, b, strict=True)], blocks).map(slice_of).collect()
    )
    return [as_integers([v for c, new in enumerate(made[b]) for v in (new or old[c].tolist())]).reshape(k, -1) for b, old in enumerate(slices)]


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: id_col, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors of other lengths than COMPONENTS, or with a null or non-finite component, are left out. Rows that repeat
    an id are vectors of their own; rows without an id are clustered but start no centroid. With fewer vectors than
    CENTROIDS there are as many centroids as vectors that may start one. Components of any size are computed
    exactly; a distance or sum that no long holds is null. Other columns are ignored. No vectors give no rows.
    """
    spark = vectors.sparkSession
    v = F.transform(vector_col, lambda x: x.cast("double"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col(id_col).alias("id"), v.alias("v")).filter((F.size("v") == COMPONENTS) & whole)
    stored, n = _shards(kept), partitions(spark)
    centroids, kind = _starts(kept), dict(vectors.dtypes)[id_col]
    if not centroids:
        return spark.createDataFrame([], f"{id_col} {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    slices = _blocks(centroids)
    shards = stored.filter("block >= 0").select("block", "chunk", "data").rdd.map(lambda r: ((r[0], r[1]), decode(bytes(r[2]), BLOCK))).partitionBy(n).persist(StorageLevel.MEMORY_AND_DISK)
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast(slices)
        slices = _updated(shards, _distances(shards, sent, n), slices, n)
    sent = spark.sparkContext.broadcast(slices)
    nearest = _distances(shards, sent, n).map(lambda d: (d[0], d[1].argmin(axis=1).tolist(), [x if x < 1 << 63 else None for x in map(int, d[1].min(axis=1).tolist())]))
    chosen = written(spark.createDataFrame(nearest, "chunk string, cluster array<int>, distance array<bigint>"), "lloyd-choices")
    shards.unpersist()
    ids = stored.filter("block = -1").select("chunk", F.col("ids").alias("id"))
    rows = chosen.join(ids, "chunk").select(F.inline(F.arrays_zip("id", "cluster", "distance")))
    final = np.concatenate([s.astype(object) for s in slices], axis=1)
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final.tolist()]
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    sums = rows.groupBy("cluster").agg(F.when(F.count("distance") == F.count(F.lit(1)), total("distance")).alias("s"))
    every = sums.agg(F.when(F.count("s") == F.count(F.lit(1)), total("s")).alias("t"))
    of = F.broadcast(spark.createDataFrame(list(enumerate(hashes)), "cluster int, centroid_sha256 string").join(F.broadcast(sums), "cluster").join(F.broadcast(every)))  # CENTROIDS rows
    return rows.join(of, "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", F.col("s").try_cast("bigint").alias("cluster_inertia"), F.col("t").try_cast("bigint").alias("inertia"), "centroid_sha256"
    )
