"""Exact pattern search in texts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.text import PIECE, in_pieces


def search_all(texts: DataFrame, pattern: str) -> DataFrame:
    """file_id, pos: every occurrence, overlapping ones too, ascending. An empty pattern has none."""
    if not pattern:
        return texts.select("file_id", F.lit(0).cast("long").alias("pos")).filter(F.lit(False))

    def found(c, at):
        def starts(x, i):
            hit = (x == pattern[0]) & (i < PIECE)
            for k, ch in enumerate(pattern[1:], 1):
                hit = hit & (F.get(c, i + k) == ch)
            return F.when(hit, at + i)

        return F.filter(F.transform(c, starts), lambda i: i.isNotNull())

    rows = texts.filter(F.contains("text", F.lit(pattern)))
    return rows.select("file_id", F.explode(in_pieces(F.col("text"), found, len(pattern) - 1)).alias("pos"))


def search_apart(texts: DataFrame, pattern: str) -> DataFrame:
    """file_id, pos: occurrences from the left that don't overlap."""
    if not pattern:
        return search_all(texts, pattern)
    rows = texts.filter(F.contains("text", F.lit(pattern))).select("file_id", F.split("text", java_quote(pattern)).alias("parts"))
    rows = rows.select("file_id", F.posexplode(F.slice("parts", F.lit(1), F.size("parts") - 1)).alias("k", "part"))
    upto = Window.partitionBy("file_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("file_id", (F.sum(F.char_length("part")).over(upto) + F.col("k") * len(pattern)).cast("long").alias("pos"))


def count_apart(texts: DataFrame, pattern: str) -> DataFrame:
    """file_id, cnt: how many occurrences don't overlap, for every text."""
    count = F.regexp_count("text", F.lit(java_quote(pattern))) if pattern else F.lit(0)
    return texts.select("file_id", count.cast("long").alias("cnt"))


def join_segments(segments: DataFrame, size: int) -> DataFrame:
    """file_id, seg_start, seg_text: segments of blocks of `size` characters in the file's coordinates, those that meet at a border joined."""
    rows = segments.select("file_id", (F.col("block_no").cast("long") * size + F.col("seg_start")).alias("seg_start"), "seg_text")
    ordered = Window.partitionBy("file_id").orderBy("seg_start")
    apart = F.col("seg_start") != F.lag(F.col("seg_start") + F.char_length("seg_text")).over(ordered)
    rows = rows.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("long"))
    rows = rows.withColumn("run", F.sum("apart").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("seg_start", "seg_text")))
    joined = rows.groupBy("file_id", "run").agg(F.min("seg_start").alias("seg_start"), F.array_join(F.transform(parts, lambda x: x["seg_text"]), "").alias("seg_text"))
    return joined.select("file_id", "seg_start", "seg_text")


def search_segments(segments: DataFrame, pattern: str, size: int) -> DataFrame:
    """file_id, block_no, pos: occurrences inside segments (file_id, block_no, seg_start, seg_text) of short factors.

    Segments go on across the borders of blocks of `size` characters; block_no and pos are where an
    occurrence starts. A longer factor is a piece of the reference and is searched there once, not in every file.
    """
    keyed = join_segments(segments, size).select(F.struct("file_id", "seg_start").alias("file_id"), F.col("seg_text").alias("text"))
    found = search_all(keyed, pattern).select("file_id.file_id", (F.col("file_id.seg_start") + F.col("pos")).alias("at"))
    return found.select("file_id", F.floor(F.col("at") / size).cast("int").alias("block_no"), (F.col("at") % size).alias("pos"))


def java_quote(pattern: str) -> str:
    """A regular expression for the pattern's characters."""
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", pattern)
