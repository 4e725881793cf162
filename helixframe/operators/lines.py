"""Line feeds, letter case and header lines: side tables, ranks over them, and the way back.

Positions inside one text are found by array functions, so that these operators need
no shuffle and a text is never spread over rows without need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import bits
from helixframe.functions.text import PIECE, ascii_upper, in_pieces, slices

#: What a header line starts with.
HEADER = "^[>;#]"


def newline_positions(texts: DataFrame) -> DataFrame:
    """file_id, nl_rank, nl_pos: every line feed."""
    found = in_pieces(F.col("text"), lambda c, at: F.filter(F.transform(c, lambda x, i: F.when(x == "\n", at + i)), lambda i: i.isNotNull()))
    return texts.select("file_id", F.posexplode(found).alias("nl_rank", "nl_pos"))


def newline_deltas(positions: DataFrame) -> DataFrame:
    """file_id, idx, delta, restored: gaps between line feeds (the first counts from 0) and their running sum."""
    by = Window.partitionBy("file_id").orderBy("nl_pos")
    rows = positions.select("file_id", F.col("nl_rank").alias("idx"), (F.col("nl_pos") - F.coalesce(F.lag("nl_pos").over(by), F.lit(0))).alias("delta"), "nl_pos")
    return rows.select("file_id", "idx", "delta", F.sum("delta").over(Window.partitionBy("file_id").orderBy("nl_pos").rowsBetween(Window.unboundedPreceding, 0)).alias("restored"))


def newline_mode(deltas: DataFrame) -> DataFrame:
    """file_id, delta, cnt: the most frequent gap of each file, the smallest of several."""
    counts = deltas.groupBy("file_id", "delta").agg(F.count(F.lit(1)).alias("cnt"))
    first = Window.partitionBy("file_id").orderBy(F.desc("cnt"), "delta")
    return counts.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k")


def newline_exceptions(deltas: DataFrame) -> DataFrame:
    """file_id, idx, delta: gaps that aren't the file's most frequent one."""
    mode = newline_mode(deltas).select("file_id", F.col("delta").alias("usual"))
    return deltas.join(mode, "file_id").filter("delta <> usual").select("file_id", "idx", "delta")


def side_table_bytes(texts: DataFrame) -> DataFrame:
    """file_id, case_bytes, newline_bytes: what the two side tables of a file take in variable bytes, by formula.

    Case: two counts and the gaps between run borders. Line feeds: four counts, and for each exception to the usual gap
    the step from the exception before and the gap itself.
    """
    by = Window.partitionBy("file_id").orderBy("start")
    runs = case_runs(texts).withColumn("gap", F.col("start") - F.coalesce(F.lag("end").over(by), F.lit(0)))
    case = runs.groupBy("file_id").agg(F.sum(bits.varbyte_size(F.col("gap")) + bits.varbyte_size(F.col("end") - F.col("start"))).alias("c"))
    odd = newline_exceptions(newline_deltas(newline_positions(texts)))
    step = F.col("idx") - F.coalesce(F.lag("idx").over(Window.partitionBy("file_id").orderBy("idx")), F.lit(0))
    feeds = odd.withColumn("step", step).groupBy("file_id").agg(F.sum(bits.varbyte_size(F.col("step").cast("long")) + bits.varbyte_size(F.col("delta"))).alias("l"))
    rows = texts.select("file_id").join(case, "file_id", "left").join(feeds, "file_id", "left")
    return rows.select("file_id", (8 + F.coalesce("c", F.lit(0))).cast("long").alias("case_bytes"), (16 + F.coalesce("l", F.lit(0))).cast("long").alias("newline_bytes"))


def newline_skips(positions: DataFrame, step: int = 1024) -> DataFrame:
    """Every step-th line feed: the skip index of a file."""
    return positions.filter(F.col("nl_rank") % step == 0)


def newline_ranks(texts: DataFrame, step: int = 1000) -> DataFrame:
    """file_id, probe, rank: line feeds before each multiple of `step` within the text."""
    rows = texts.select("file_id", F.posexplode(F.concat(slices(F.col("text"), step), F.array(F.lit("")))).alias("b", "part"), F.floor(F.char_length("text") / step).alias("last"))
    counts = rows.filter("b <= last").select("file_id", "b", (F.char_length("part") - F.char_length(F.replace("part", F.lit("\n"), F.lit("")))).cast("long").alias("k"))
    before = Window.partitionBy("file_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("file_id", (F.col("b") * step).cast("long").alias("probe"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("rank"))


def case_runs(texts: DataFrame) -> DataFrame:
    """file_id, start, end: runs of a-z, both ends inside; anything else closes a run."""
    low = lambda c: c.between("a", "z")
    text = F.col("text")
    after = lambda c, i: F.coalesce(low(F.get(c, i + 1)), F.lit(False))

    def where(test, shift: int):
        return in_pieces(text, lambda c, at: F.filter(F.transform(c, lambda x, i: F.when((i < PIECE) & test(c, x, i), at + i + shift)), lambda i: i.isNotNull()), overlap=1)

    first = F.when(low(F.substring(text, 1, 1)), F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<long>"))
    starts = F.concat(first, where(lambda c, x, i: ~low(x) & after(c, i), 1))
    ends = where(lambda c, x, i: low(x) & ~after(c, i), 0)
    rows = texts.select("file_id", starts.alias("s"), ends.alias("e"))
    return rows.select("file_id", F.inline(F.arrays_zip(F.col("s").alias("start"), F.col("e").alias("end"))).alias("start", "end"))


def split_lines(texts: DataFrame) -> DataFrame:
    """file_id, line_no, line, is_header, pos_text: lines and where they start.

    A text that ends in a line feed has no empty line after it.
    """
    lines = F.split("text", "\n")
    kept = F.when(F.col("text").endswith("\n"), F.slice(lines, 1, F.size(lines) - 1)).when(F.col("text") == "", F.array().cast("array<string>")).otherwise(lines)
    rows = texts.select("file_id", F.posexplode(kept).alias("line_no", "line"))
    before = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length("line") + 1
    return rows.select("file_id", "line_no", "line", F.col("line").rlike(HEADER).alias("is_header"), F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long").alias("pos_text"))


def header_table(texts: DataFrame) -> DataFrame:
    """file_id, line_no, pos_text, pos_storage, length: header lines, where they stand, and where in the store of headers."""
    rows = split_lines(texts).filter("is_header").withColumn("length", F.char_length("line").cast("long"))
    before = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("file_id", "line_no", "pos_text", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("pos_storage"), "length", "line")


def header_ranks(texts: DataFrame, step: int = 1000) -> DataFrame:
    """file_id, probe, rank: characters of header lines before each multiple of `step`."""
    headers = header_table(texts).groupBy("file_id").agg(F.collect_list(F.struct("pos_text", "length")).alias("h"))
    rows = texts.join(headers, "file_id", "left").select("file_id", "h", F.explode(F.sequence(F.lit(0), F.floor(F.char_length("text") / step))).alias("b"))
    probe = (F.col("b") * step).cast("long")
    inside = F.filter(F.coalesce("h", F.array().cast("array<struct<pos_text:long,length:long>>")), lambda x: x["pos_text"] < probe)
    return rows.select("file_id", probe.alias("probe"), F.aggregate(inside, F.lit(0).cast("long"), lambda s, x: s + F.least(x["length"] + 1, probe - x["pos_text"])).alias("rank"))


def sequence_text(texts: DataFrame) -> DataFrame:
    """file_id, seq: the upper-cased lines that aren't headers, joined without line feeds."""
    lines = F.filter(F.split("text", "\n"), lambda x: ~x.rlike(HEADER))
    return texts.select("file_id", ascii_upper(F.array_join(lines, "")).alias("seq"))


def strip(texts: DataFrame) -> DataFrame:
    """What is stored of a file: seq (upper case, no headers, no line feeds) and the side tables as arrays.

    line_sizes: lengths of its lines in order, header lines negative less 1; case_sizes:
    lengths of the runs of other and lower-case letters, in turns, beginning with other.
    """
    text = F.col("text")
    lines = F.split(text, "\n")
    sizes = F.transform(lines, lambda x: F.when(x.rlike(HEADER), -F.char_length(x) - 1).otherwise(F.char_length(x)))
    runs = F.regexp_extract_all(text, F.lit("[a-z]+|[^a-z]+"), F.lit(0))
    return texts.select(
        "file_id",
        ascii_upper(F.array_join(F.filter(lines, lambda x: ~x.rlike(HEADER)), "")).alias("seq"),
        ascii_upper(F.array_join(F.filter(lines, lambda x: x.rlike(HEADER)), "")).alias("headers"),
        sizes.alias("line_sizes"),
        F.when(F.get(runs, F.lit(0)).rlike("^[a-z]"), F.concat(F.array(F.lit(0)), F.transform(runs, F.char_length))).otherwise(F.transform(runs, F.char_length)).alias("case_sizes"),
    )
