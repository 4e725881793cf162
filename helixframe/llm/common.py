"""Pieces shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"

#: Used only in local mode, where the session names no shared folder (tests, a laptop).
LOCAL_WORKSPACE = "file:///tmp/checkpoints/helixframe"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared folder that the cluster names in spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = LOCAL_WORKSPACE
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def settle(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends here, and a lost executor costs nothing."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, once nothing reads it any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once a row and use it many times in `body`, which may hold lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, in order; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z only, unlike lower()."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def smallest_hashes(df: DataFrame, n: int, total: int, *keys: str, unique: bool = False) -> DataFrame:
    """One row of each of the n keys with the smallest hash: a bounded sample that any rerun repeats.

    Hashes beyond those of about 2 n keys go before rows are put in order, so that what
    tasks send does not grow with their number. `total` bounds the number of keys from above. Keys
    may repeat, one of them in most rows; rows of equal keys must be equal. So each key is
    taken once, combined before the shuffle, and where too few are left the limit rises.
    With `unique` no key repeats and total is their number.
    """
    h, share = F.xxhash64(*keys), 2.0 * n / max(total, 1)
    while share < 1:
        few = df.filter(h < F.lit(int(share * 2**64) - 2**63))
        if unique or few.select(*keys).distinct().limit(n).count() == n:
            df = few
            break
        share *= 16
    return (df if unique else df.dropDuplicates(list(keys))).orderBy(h, *keys).limit(n)


def slots_for(rows: int, least: int = 1 << 16, most: int = 1 << 20) -> int:
    """64-bit slots of a bitmap that holds `rows` hashes with one bit in 16 set at most, while it stays under 64 MB broadcast."""
    return min(most, max(least, 1 << max(0, (rows // 4 - 1).bit_length())))


def slot_of(h: Column, slots: int) -> Column:
    return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(slots - 1))


def bit_of(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))


def bitmap(hashes: DataFrame, slots: int) -> DataFrame:
    """slot, bits: the hashes of column `h` as a bitmap, `slots` rows at most."""
    return hashes.groupBy(slot_of(F.col("h"), slots).alias("slot")).agg(F.bit_or(bit_of(F.col("h"))).alias("bits"))


def in_bitmap(rows: DataFrame, h: Column, bits: DataFrame, slots: int) -> DataFrame:
    """The rows whose hash may be in the bitmap: all that are, and few others while it isn't full. The bitmap is broadcast."""
    met = rows.withColumn("_h", h).withColumn("_slot", slot_of(F.col("_h"), slots)).join(F.broadcast(bits.select(F.col("slot").alias("_slot"), F.col("bits").alias("_bits"))), "_slot")
    return met.filter(F.col("_bits").bitwiseAND(bit_of(F.col("_h"))) != 0).select(*rows.columns)


#: Rows of an Arrow batch, unless the session names a number of its own. Spark's default is 10,000.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for whole texts: JVM and Python each hold a few at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow stage that hands its memory back when a task ends: workers live on, and share an executor with what comes next."""

    @wraps(run)
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return stage


def release_memory() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
