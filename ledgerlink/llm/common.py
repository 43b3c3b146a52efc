"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session, which the cluster sets by its data size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where the session names none, as in tests on one machine, a new local folder is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        named = tempfile.mkdtemp(prefix="ledgerlink-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the shared checkpoint folder, once, and reread."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of an Arrow batch of whole texts, where a session's executors go through several operators.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends Python workers at most BATCH_ROWS rows at a time.

    A batch stands several times in an executor, and so in its worker: as Arrow vectors, as the stream that is sent, as
    Arrow buffers and as Python values. Neither gives all of that memory back when the next stage begins.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def release() -> None:
    """Give memory that this process doesn't need any more back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(f: Callable) -> Callable:
    """The function of mapInArrow f; after its last batch the worker, which goes on with other tasks, is made small again."""

    def of(batches):
        yield from f(batches)
        release()

    return of


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of this number of rows at least, but for the last one."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


#: Ids up to this number are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 100_000


def checked_ids(ids: DataFrame) -> DataFrame:
    """Distinct ids, written once and counted, with a broadcast hint only if they are few."""
    found = cut(ids.distinct())
    return F.broadcast(found) if found.count() <= BROADCAST_IDS else found


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
