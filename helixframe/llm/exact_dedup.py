"""Exact deduplication by a log-structured merge index of text digests.

* Memtables: every input partition is one. It sorts its (digest, doc_id, chars) rows
  by digest and flushes them as a run, a Parquet file.
* Compaction merges the runs by digest into one sorted run, which keeps of each digest the
  best row (most code points, then the smallest identifier) and how many rows it has. Runs of later batches are merged with it in the same way: add() and compact().
* The compacted run's filter is a bitmap of its digests that were met twice or more, sized
  by their number. The second scan consults it: only texts that it lets through (all
  real hits, and few others) go on.
* Byte verification: those texts are grouped by digest *and* whole normalised
  text, so that equality is equality of bytes. Tasks combine before the shuffle, so
  that a group with a third of all rows arrives as one row from each task. Only what is
  verified leaves the index; digests whose texts differ are told apart by their texts.

Defined cases: a null text counts as empty; empty texts form one group. A null
doc_id sorts after all others. Of rows that repeat with the same doc_id and text,
exactly one is kept. An empty table gives an empty result. Further input columns
are ignored. Texts with equal digests and unlike bytes stay apart.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import bitmap, in_bitmap, settle, slots_for, workspace

#: Larger than any bigint: stands for a null doc_id.
NO_ID = "9300000000000000000"
STEP = "100000000000000000000"


def normalise(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _rank(chars: Column, doc_id: Column) -> Column:
    """One number that orders rows by code points, then by smaller doc_id; the largest stays."""
    big = chars.cast("decimal(38,0)") * F.expr(f"{STEP}BD")
    return (big - F.coalesce(doc_id.cast("decimal(38,0)"), F.expr(f"{NO_ID}BD"))).cast("decimal(38,0)")


def _id_of(rank: str) -> Column:
    chars = f"((`{rank}` + 50000000000000000000BD) div {STEP}BD)"
    value = f"(cast({chars} as decimal(38,0)) * {STEP}BD - `{rank}`)"
    return F.expr(f"case when {value} = {NO_ID}BD then null else cast({value} as bigint) end")


class DigestIndex:
    """The runs of one corpus, in a folder of the shared store."""

    def __init__(self, folder: str, digest: Callable[[Column], Column] = sha256):
        self.folder, self.digest, self.runs, self.level = folder, digest, [], 0

    def rows(self, docs: DataFrame) -> DataFrame:
        """doc_id, chars, norm and digest of every document."""
        base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.char_length("text"), F.lit(0)).alias("chars"), normalise(F.col("text")).alias("norm"))
        return base.withColumn("digest", self.digest(F.col("norm")))

    def add(self, docs: DataFrame) -> DataFrame:
        """Flushes a batch's memtables as sorted runs (digest, doc_id, chars) and returns them."""
        rows = self.rows(docs).select("digest", "doc_id", "chars").sortWithinPartitions("digest")
        self.runs.append(settle(rows, self.folder, f"runs-{len(self.runs)}"))
        return self.runs[-1]

    def compact(self, older: DataFrame | None = None) -> DataFrame:
        """Merges all runs, and an older compacted run, into one in order of digest: digest, n, top (the best row's rank)."""
        fresh = [r.select("digest", F.lit(1).cast("long").alias("n"), _rank(F.col("chars"), F.col("doc_id")).alias("top")) for r in self.runs]
        every = reduce(DataFrame.unionByName, [*fresh, *([older] if older is not None else [])])
        merged = every.groupBy("digest").agg(F.sum("n").alias("n"), F.max("top").alias("top")).sortWithinPartitions("digest")
        self.level += 1
        return settle(merged, self.folder, f"level-{self.level}")

    def filter_of(self, compacted: DataFrame) -> tuple[DataFrame, int]:
        """The bitmap of the digests that a compacted run holds twice or more, and its slots."""
        hashes = compacted.filter("n > 1").select(F.xxhash64("digest").alias("h"))
        slots = slots_for(hashes.count())
        return settle(bitmap(hashes, slots), self.folder, f"filter-{self.level}"), slots

    def hits(self, docs: DataFrame, compacted: DataFrame) -> DataFrame:
        """Rows whose digest may be there twice, with their normalised text."""
        rows = self.rows(docs).select("digest", "norm", "chars", "doc_id")
        return in_bitmap(rows, F.xxhash64("digest"), *self.filter_of(compacted))

    @staticmethod
    def verified(hits: DataFrame) -> DataFrame:
        """A row for each group of two or more byte-equal normalised texts: digest, norm, group_size, top."""
        rows = hits.withColumn("rank", _rank(F.col("chars"), F.col("doc_id")))
        groups = rows.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("group_size"), F.max("rank").alias("top"))
        return groups.filter("group_size > 1")


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, folder: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    index = DigestIndex(folder or workspace(docs.sparkSession, "lsm"), digest)
    runs = index.add(docs)
    compacted = index.compact()
    hits = index.hits(docs, compacted)
    checked = settle(index.verified(hits).select("digest", "group_size", F.col("top").alias("checked")), index.folder, "verified")
    # what the index holds twice or more must be what the bytes say: the same rows under the same best one
    listed = compacted.filter("n > 1")
    unlike = listed.join(checked, (listed.digest == checked.digest) & (listed.n == checked.group_size) & (listed.top == checked.checked), "left_anti")
    if digest is not sha256 or unlike.limit(1).count():
        # Unlike texts share a digest: the texts themselves decide, row by row.
        rows = index.rows(docs).select("doc_id", "chars", "digest", "norm", F.sha2("norm", 256).alias("text_sha256"))
        joined = rows.join(index.verified(hits), ["digest", "norm"], "left").drop("norm")
    else:
        rows = runs.select("doc_id", "chars", "digest", F.lower(F.hex("digest")).alias("text_sha256"))
        joined = rows.join(listed.select("digest", F.col("n").alias("group_size"), "top"), "digest", "left")
    ranked = joined.withColumn("first", F.col("top").isNull() | (F.col("top") == _rank(F.col("chars"), F.col("doc_id"))))
    once = Window.partitionBy("text_sha256", "doc_id", "chars").orderBy("first")
    return ranked.withColumn("turn", F.row_number().over(once)).select(
        "doc_id",
        F.when(F.col("top").isNull(), F.col("doc_id")).otherwise(_id_of("top")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("first") & (F.col("turn") == 1)).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    key = lambda sha: F.concat_ws("|", sha, F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    found = exact_dedup(docs).filter("kept").select(key(F.col("text_sha256")).alias("_key"))
    rows = docs.withColumn("_key", key(F.sha2(normalise(F.col("text")), 256)))
    once = Window.partitionBy("_key").orderBy(F.char_length(F.coalesce("text", F.lit(""))).desc())
    kept = rows.join(found, "_key", "left_semi").withColumn("_turn", F.row_number().over(once))
    return kept.filter("_turn = 1").select(*docs.columns)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
