"""Reference texts and what is computed over them: suffix orders, grams, frequent k-mers, samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.text import chars, slices
from helixframe.session import settle, workspace

PADDING = 1024
#: Windows of a sequence that stand in one row; substring() counts from the start of it.
WINDOWS = 1 << 8


def build_reference(seq: DataFrame, alphabet: str) -> DataFrame:
    """ref_id, text: 1024 N, the alphabet, then the sequences in order. seq: ref_id, part_no, seq."""
    parts = seq.groupBy("ref_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_no", "seq"))), lambda x: x["seq"]), "").alias("body"))
    return parts.select("ref_id", F.concat(F.repeat(F.lit("N"), PADDING), F.lit(alphabet), F.col("body")).alias("text"))


def build_range_reference(seq: DataFrame, alphabet: str, limits: tuple[tuple[int, int], ...]) -> DataFrame:
    """ref_id, range_class, text: the prologue again before every chunk of the sequence.

    limits: (size, chunk) pairs in order; a sequence of up to `size` characters is cut into
    chunks of `chunk`; range_class is the pair's number from 1.
    """
    whole = build_reference(seq, "").select("ref_id", F.substring("text", F.lit(PADDING + 1), F.char_length("text")).alias("body"))
    n, chunk, kind = F.char_length("body"), F.lit(limits[-1][1]), F.lit(len(limits))
    for k, (most, size) in reversed(list(enumerate(limits[:-1], 1))):
        chunk, kind = F.when(n <= most, size).otherwise(chunk), F.when(n <= most, k).otherwise(kind)
    prologue = F.concat(F.repeat(F.lit("N"), PADDING), F.lit(alphabet))
    rows = whole.withColumn("_chunk", chunk).withColumn("range_class", kind)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / F.col("_chunk"))).cast("int"))
    return rows.select("ref_id", "range_class", F.array_join(F.transform(starts, lambda b: F.concat(prologue, F.substring(F.col("body"), b * F.col("_chunk") + 1, F.col("_chunk")))), "").alias("text"))


def suffix_array(text: str) -> np.ndarray:
    """Positions of a text in the order of their suffixes, by prefix doubling over ranks."""
    rank = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_inverse=True)[1].astype(np.int64)
    n, step = len(rank), 1
    while n:
        second = np.full(n, -1, np.int64)
        second[: max(n - step, 0)] = rank[step:]
        order = np.lexsort((second, rank))
        fresh = np.ones(n, bool)
        fresh[1:] = (np.diff(rank[order]) != 0) | (np.diff(second[order]) != 0)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        if fresh.all() or step >= n:
            return order
        step *= 2
    return np.empty(0, np.int64)


def suffix_order(reference: DataFrame) -> DataFrame:
    """ref_id, rank, pos: the same for every reference text, each in one task.

    Meant for references up to some hundred megabytes, one row each; doubling needs all ranks of one text at hand.
    """

    def one(rows):
        import pyarrow as pa

        for batch in rows:
            for ref, text in zip(batch["ref_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                order = suffix_array(text)
                yield pa.RecordBatch.from_arrays([pa.array([ref] * len(order), pa.string()), pa.array(np.arange(len(order))), pa.array(order)], names=["ref_id", "rank", "pos"])

    return reference.select("ref_id", "text").mapInArrow(one, "ref_id string, rank long, pos long")


def ranked(keys: DataFrame, order: list[str], folder: str, name: str) -> DataFrame:
    """Adds new, from 1: the place of each row in the order. A range-partitioned sort numbers rows within parts; parts' sizes, one number each, give the offsets."""
    placed = settle(keys.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), folder, name)
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    if not sizes:
        return placed.withColumn("new", F.lit(0).cast("long")).drop("_at")
    offsets, total = [], 0
    for p, n in sizes:
        offsets += [F.lit(p), F.lit(total).cast("long")]
        total += n
    return placed.withColumn("new", F.create_map(*offsets)[part] + inside + 1).drop("_at")


def suffix_order_distributed(symbols: DataFrame, folder: str | None = None) -> DataFrame:
    """pos, rank of one long text by prefix doubling over tables, until all ranks differ; symbols: pos, ch.

    Sorts and joins only: no task sees more than its part of a text, and no window is without partitions.
    """
    folder = folder or workspace(symbols.sparkSession, "suffixes")
    rows, step, turn = settle(symbols.select("pos", (F.ascii("ch") + 1).cast("long").alias("rank")), folder, "rows-0"), 1, 0
    n = rows.count()
    while True:
        turn += 1
        other = rows.select((F.col("pos") - step).alias("pos"), F.col("rank").alias("second"))
        paired = settle(rows.join(other, "pos", "left").na.fill(0, ["second"]), folder, f"paired-{turn}")
        places = ranked(paired.select("rank", "second").distinct(), ["rank", "second"], folder, f"keys-{turn}")
        rows = settle(paired.join(places, ["rank", "second"]).select("pos", F.col("new").alias("rank")), folder, f"rows-{turn}")
        if places.count() == n:
            return rows.select("pos", (F.col("rank") - 1).alias("rank"))
        step *= 2


def sample_order(order: DataFrame, distance: int, protected: int = 1280) -> DataFrame:
    """Suffixes at every distance-th position, and all of the protected start; ranks stay as they are."""
    return order.filter((F.col("pos") < protected) | (F.col("pos") % distance == 0))


def alphabet_of(texts: DataFrame) -> DataFrame:
    """ch: the distinct symbols of all texts."""
    return texts.select(F.explode(F.array_distinct(chars(F.col("text")))).alias("ch")).distinct()


def gram_counts(texts: DataFrame, k: int = 3) -> DataFrame:
    """gram, n: how often each k symbols start somewhere; at the end the text's smallest symbol fills up."""
    rows = texts.select(chars(F.col("text")).alias("c")).filter(F.size("c") > 0).withColumn("pad", F.array_min("c"))
    gram = lambda i: F.concat(*(F.coalesce(F.get("c", i + j), F.col("pad")) for j in range(k)))
    return rows.select(F.explode(F.transform("c", lambda _, i: gram(i))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def kmers(seq: DataFrame, k: int) -> DataFrame:
    """file_id, pos, kmer: all windows of k symbols. Sequences are cut into overlapping pieces, whose windows stand in a task one piece at a time."""
    rows = seq.select("file_id", F.posexplode(slices(F.col("seq"), WINDOWS, k - 1)).alias("b", "piece"))
    n = F.least(F.char_length("piece") - k, F.lit(WINDOWS - 1))
    at = F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    rows = rows.select("file_id", "b", F.posexplode(F.transform(at, lambda i: F.substring(F.col("piece"), i + 1, F.lit(k)))).alias("i", "kmer"))
    return rows.select("file_id", (F.col("b") * WINDOWS + F.col("i")).alias("pos"), "kmer")


def kmer_frequency(seq: DataFrame, k: int = 16, place: Column | None = None) -> DataFrame:
    """kmer, cnt, first_at: exact counts, and the first place (file_id * 10^9 + pos)."""
    at = F.col("file_id") * 1_000_000_000 + F.col("pos") if place is None else place
    return kmers(seq, k).groupBy("kmer").agg(F.count(F.lit(1)).alias("cnt"), F.min(at).alias("first_at"))


def top_kmers(frequency: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent k-mers that occur twice or more; of equal counts those first met last."""
    return frequency.filter("cnt > 1").orderBy(F.desc("cnt"), F.desc("first_at"), "kmer").limit(n)


def drawn(*parts: Column | str) -> Column:
    """A whole number below 2^52 from a digest of the parts: the same on every rerun, and in SQL."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))), 1, 13), 16, 10).cast("long")


def sample_segments(seq: DataFrame, length: int, n: int | Column, seed: int = 0) -> DataFrame:
    """file_id, draw, pos, text: n pieces of each sequence, at places drawn from a digest."""
    size = F.char_length("seq")
    n = F.lit(n) if isinstance(n, int) else n
    rows = seq.filter(size > 0).select("file_id", "seq", n.cast("int").alias("n")).filter("n > 0")
    rows = rows.select("file_id", "seq", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("draw"))
    pos = drawn(F.lit(seed), "file_id", "draw") % F.greatest(F.lit(1).cast("long"), size.cast("long") - length + 1)
    return rows.select("file_id", "draw", pos.alias("pos"), F.substring(F.col("seq"), (pos + 1).cast("int"), F.lit(length)).alias("text"))


def prepare_reference(seq: DataFrame, output_size: int, k: int = 128, segment: int = 5000) -> DataFrame:
    """source, weight, text: the parts of a reference text of about output_size symbols.

    A tenth of it are the most frequent k-mers, the rest segments; every sequence gives segments in
    proportion to its size, what is left of a share being drawn from a digest.
    """
    n_kmers, n_segments = output_size // 10 // k, output_size * 9 // 10 // segment
    top = top_kmers(kmer_frequency(seq, k), n_kmers).select(F.lit("kmer").alias("source"), F.col("cnt").alias("weight"), F.col("kmer").alias("text"))
    total = seq.agg(F.sum(F.char_length("seq").cast("long"))).first()[0] or 0
    share = F.char_length("seq").cast("long") * F.lit(n_segments).cast("long")
    whole, rest = F.floor(share / F.lit(max(total, 1))), share % F.lit(max(total, 1))
    n = whole + (drawn(F.lit("share"), "file_id") % F.lit(max(total, 1)) < rest).cast("long")
    parts = sample_segments(seq, segment, n).select(F.lit("segment").alias("source"), F.col("file_id").alias("weight"), "text")
    return top.unionByName(parts)


def collect_reference(reference: DataFrame, most: int = 1 << 24) -> str:
    """The single reference text on the driver; refuses what is larger than `most` characters."""
    size = reference.agg(F.sum(F.char_length("text"))).first()[0] or 0
    if size > most:
        raise ValueError(f"the reference has {size} characters; {most} at most are shared with all tasks")
    return "".join(r["text"] for r in reference.select("text").collect())


def single(spark: SparkSession, text: str, ref_id: str = "ref") -> DataFrame:
    return spark.createDataFrame([(ref_id, text)], "ref_id string, text string")
