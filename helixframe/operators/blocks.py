"""Blocks of sequences, and where their bytes stand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.text import slices


def block_split(texts: DataFrame, size: int = 1000) -> DataFrame:
    """file_id, block_no, block_start, n, text: slices of `size` characters, the last one shorter. An empty text has none."""
    rows = texts.select("file_id", F.posexplode(slices(F.col("text"), size)).alias("block_no", "text"))
    return rows.select("file_id", "block_no", (F.col("block_no") * size).cast("long").alias("block_start"), F.char_length("text").alias("n"), "text")


def block_offsets(blocks: DataFrame) -> DataFrame:
    """file_id, block_no, bytes_pos, bytes_len from rows with bytes_len: where each block starts in its file."""
    before = Window.partitionBy("file_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("file_id", "block_no", F.coalesce(F.sum("bytes_len").over(before), F.lit(0)).cast("long").alias("bytes_pos"), "bytes_len")


def block_lengths(offsets: DataFrame) -> DataFrame:
    """The inverse of block_offsets: lengths from where blocks start; the last one runs to the end."""
    after = Window.partitionBy("file_id").orderBy("block_no")
    return offsets.select("file_id", "block_no", (F.coalesce(F.lead("bytes_pos").over(after), F.col("bytes_pos") + F.col("bytes_len")) - F.col("bytes_pos")).alias("bytes_len"))
