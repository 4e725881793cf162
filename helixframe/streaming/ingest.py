"""Files that arrive in a folder are encoded when they are complete, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from helixframe.operators import blocks, factorize, lines

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """file_id, path, text of files as they come."""
    rows = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", pattern).load(folder)
    return rows.select(F.xxhash64("path").alias("file_id"), "path", F.decode("content", "UTF-8").alias("text"))


def encode_stream(files: DataFrame, ref_text: str, target: str, checkpoint: str, size: int = 100_000) -> StreamingQuery:
    """Writes layouts and encoded blocks of every batch; a batch that runs again overwrites its own part."""

    def write(batch: DataFrame, number: int) -> None:
        stored = lines.strip(batch)
        stored.drop("seq").write.mode("overwrite").parquet(f"{target}/layout/batch={number}")
        cut = blocks.block_split(stored.select("file_id", F.col("seq").alias("text")), size)
        factorize.encode_blocks(factorize.factorize(cut, ref_text)).write.mode("overwrite").parquet(f"{target}/blocks/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
