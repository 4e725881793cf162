"""Mutation files: text size and count, then (position, character) records, all little-endian.

Layout (fixed): u32 size of the text, u32 n, n times u32 position and one character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HEAD, _RECORD = np.dtype("<u4"), np.dtype([("pos", "<u4"), ("ch", "S1")])


def pack(changes: DataFrame) -> DataFrame:
    """file_id, content from rows file_id, size, pos, ch; records in order of position."""
    grouped = changes.groupBy("file_id").agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("pos", "ch"))).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for size, places, chars in zip(*(batch[c].to_pylist() for c in ("size", "p", "c")), strict=True):
                records = np.array([(p, c.encode("latin-1")) for p, c in zip(places, chars, strict=True)], _RECORD)
                out.append(np.array([size, len(records)], _HEAD).tobytes() + records.tobytes())
            yield pa.RecordBatch.from_arrays([batch["file_id"], pa.array(out, pa.binary())], names=["file_id", "content"])

    return grouped.select("file_id", "size", F.col("m.pos").alias("p"), F.col("m.ch").alias("c")).mapInArrow(run, "file_id long, content binary")


def unpack(content: DataFrame) -> DataFrame:
    """file_id, pos, ch; raises ValueError on a wrong length, on positions that do not increase, or lie outside the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, raw in zip(batch["file_id"].to_pylist(), batch["content"].to_pylist(), strict=True):
                size, n = (int(x) for x in np.frombuffer(raw[:8], _HEAD))
                if len(raw) != 8 + n * _RECORD.itemsize:
                    raise ValueError(f"file {f}: {len(raw)} bytes for {n} mutations")
                records = np.frombuffer(raw[8:], _RECORD)
                pos = records["pos"].astype(np.int64)
                if (np.diff(pos) <= 0).any() or (n and pos[-1] >= size):
                    raise ValueError(f"file {f}: positions must increase and stay below {size}")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, f, np.int64)), pa.array(pos), pa.array([c.decode("latin-1") for c in records["ch"].tolist()], pa.string())], names=["file_id", "pos", "ch"])

    return content.select("file_id", "content").mapInArrow(run, "file_id long, pos long, ch string")


def read(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("binaryFile").load(path)
    return unpack(rows.select(F.xxhash64("path").alias("file_id"), "content"))
