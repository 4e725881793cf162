"""Changes of texts: overwriting, truncation, point mutations, and the line feeds they bring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.text import chars
from helixframe.operators import factorize


def patched(text: Column, at: Column, new: Column) -> Column:
    """The text with `new` written over it from `at` on; beyond its end it grows, a gap filled with NUL."""
    base = F.when(F.char_length(text) < at, F.rpad(text, at, "\0")).otherwise(text)
    return F.concat(F.substring(base, F.lit(1), at), new, F.substring(base, at + F.char_length(new) + 1, F.greatest(F.lit(0), F.char_length(base))))


def patch_text(texts: DataFrame, patches: DataFrame) -> DataFrame:
    """file_id, text: patches has file_id, at, new, one row for each file at most."""
    return texts.join(patches, "file_id", "left").select("file_id", F.when(F.col("at").isNull(), F.col("text")).otherwise(patched(F.col("text"), F.col("at"), F.col("new"))).alias("text"))


def patch_encoded(encoded: DataFrame, patches: DataFrame, reference: str, size: int) -> DataFrame:
    """The factors of files after patches (file_id, at, new; one a file, beginning inside it or at its end).

    Only blocks that a patch touches are decoded, written over and factorised again; all others stay as they are.
    """
    touched = touched_blocks(patches, size).withColumn("block_no", F.col("block_no").cast("int"))
    old = factorize.decode(encoded.join(touched, ["file_id", "block_no"], "left_semi"), reference)
    rows = touched.join(patches, "file_id").join(old, ["file_id", "block_no"], "left").withColumn("block_start", F.col("block_no").cast("long") * size)
    text, start = F.coalesce("text", F.lit("")), F.col("block_start")
    at = F.greatest(F.lit(0), F.col("at") - start).cast("int")
    part = F.substring("new", (F.greatest(F.lit(0), start - F.col("at")) + 1).cast("int"), F.lit(size) - at)
    fresh = F.concat(F.substring(text, F.lit(1), at), part, F.substring(text, at + F.char_length(part) + 1, F.lit(size)))
    again = factorize.factorize(rows.select("file_id", "block_no", "block_start", fresh.alias("text")), reference)
    return encoded.join(touched, ["file_id", "block_no"], "left_anti").select(*again.columns).unionByName(again)


def touched_blocks(patches: DataFrame, size: int) -> DataFrame:
    """file_id, block_no: the blocks that patches change; only these are encoded anew."""
    last = F.floor((F.col("at") + F.greatest(F.char_length("new"), F.lit(1)) - 1) / size)
    return patches.select("file_id", F.explode(F.sequence(F.floor(F.col("at") / size), last)).alias("block_no"))


def truncate_text(texts: DataFrame, size: Column) -> DataFrame:
    """file_id, text: cut to `size` characters, or filled up with NUL."""
    return texts.select("file_id", F.rpad(F.col("text"), size.cast("int"), "\0").alias("text"))


def shifted_newlines(positions: DataFrame, patches: DataFrame) -> DataFrame:
    """file_id, nl_pos: line feeds after patches: those outside a patch's span stay, those of its text come."""
    spans = patches.select("file_id", "at", (F.col("at") + F.char_length("new")).alias("stop"))
    outside = positions.join(spans, "file_id", "left").filter(F.col("at").isNull() | (F.col("nl_pos") < F.col("at")) | (F.col("nl_pos") >= F.col("stop")))
    found = F.filter(F.transform(chars(F.col("new")), lambda c, i: F.when(c == "\n", i)), lambda i: i.isNotNull())
    inside = patches.select("file_id", "at", F.explode(found).alias("k")).select("file_id", (F.col("k") + F.col("at")).cast("long").alias("nl_pos"))
    return outside.select("file_id", "nl_pos").unionByName(inside)


def valid_mutations(mutations: DataFrame, sizes: DataFrame) -> DataFrame:
    """Mutations (file_id, pos, ch) inside their text; sizes: file_id, n. Of several at one place the last ch in order counts."""
    return mutations.join(sizes, "file_id").filter((F.col("pos") >= 0) & (F.col("pos") < F.col("n"))).groupBy("file_id", "pos").agg(F.max("ch").alias("ch"))


def overlay(texts: DataFrame, mutations: DataFrame) -> DataFrame:
    """file_id, text: single characters replaced."""
    by_file = mutations.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ch"))).alias("m"))
    rows = texts.join(by_file, "file_id", "left")
    # the pieces between the mutated places, each with its new character in front
    first = F.substring(F.col("text"), F.lit(1), F.get("m", F.lit(0))["pos"].cast("int"))
    c = chars(F.col("text"))
    rows = rows.select("file_id", "text", "m", first.alias("first"), F.when(F.col("m").isNotNull(), c).alias("c"))
    until = lambda i: F.coalesce(F.get("m", i + 1)["pos"], F.size("c").cast("long"))
    pieces = F.transform("m", lambda x, i: F.concat(x["ch"], F.array_join(F.slice("c", (x["pos"] + 2).cast("int"), (until(i) - x["pos"] - 1).cast("int")), "")))
    return rows.select("file_id", F.when(F.col("m").isNull(), F.col("text")).otherwise(F.concat("first", F.array_join(pieces, ""))).alias("text"))
