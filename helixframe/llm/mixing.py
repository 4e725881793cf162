"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source has a target in words. Complete epochs of all its documents come first;
the rest is a weighted sample without replacement: every document draws the key
-ln(u) / quality, u being a hash of its doc_id, and documents enter in the order of
their keys (then doc_id, then size) until the budget is used up. The last one enters in part.

No source is ever sorted as a whole. One scan of the texts writes size and key of each
document. Keys fall into cells of an octave's 32nd, whose sizes are summed before the shuffle;
their prefix sums show the one cell of each source in which its budget ends. While that cell
holds more than EDGE_ROWS different rows it is cut into 4096, and again. Its rows, in order,
give the source's border: the row at which the budget ends. Every document is then in or
out by comparing it with its source's border, without a shuffle.

Targets are the water level at which every source takes level x weight, but 3 times
its own size at most; windows over one row for each source find it.

Defined cases: a null text has size 0 and takes 0. A null source is a source of its
own, the last. A null doc_id draws a key of its own; repeated rows draw equal keys and
count as documents each: where a budget ends among equal rows, some of them are taken. All
sizes 0, or an empty table: targets are 0. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import settle, workspace

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
SEED = 20_240_229
#: Keys as whole numbers: 32 bits below an octave. Bits that the cells of each level leave aside.
OCTAVE_BITS, LEVELS = 32, (27, 15, 3)
#: Different rows of a source that are put in order at most, unless they are all in one cell of the last level.
EDGE_ROWS = 100_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def text_quality(text: Column) -> Column:
    """A document's weight, 0.05 to 1: the share of its characters that are not markup or filler symbols."""
    text = F.coalesce(text, F.lit(""))
    symbols = F.char_length(text) - F.char_length(F.regexp_replace(text, "[#*$%&|<>]", ""))
    return F.greatest(F.lit(0.05), 1 - 4 * symbols / F.greatest(F.char_length(text), F.lit(1)))


def sampling_key(doc_id: Column, quality: Column) -> Column:
    """-ln(u) / quality: the smallest keys are a weighted sample without replacement."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13), 16, 10)
    return -F.log((drawn.cast("double") + 0.5) / float(1 << 52)) / quality


def _place(key: Column) -> Column:
    """A whole number that grows with the key: its octave, and OCTAVE_BITS of what follows."""
    return F.floor((F.log2(key) + 64) * float(1 << OCTAVE_BITS)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from one row per source (source, source_size)."""
    by_code = Window.orderBy(F.col("source").isNull(), "source")
    weights = F.array(*map(F.lit, WEIGHTS))
    rows = sizes.withColumn("weight", F.get(weights, (F.row_number().over(by_code) - 1) % len(WEIGHTS)))
    rows = rows.withColumn("most", (F.col("source_size") * MOST_EPOCHS).cast("double")).withColumn("fill", F.col("most") / F.col("weight"))
    order = Window.orderBy("fill", F.col("source").isNull(), "source")
    every = Window.partitionBy()
    rows = (
        rows.withColumn("full", F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(every) - F.col("full")) / F.col("open"))
        # only past the full sources is a level below the next limit; later rows give lower ones
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(every))
    )
    return rows.select("source", "source_size", F.coalesce(F.least("most", F.col("level") * F.col("weight")), F.col("most")).alias("target"))


def _drawn(docs: DataFrame, quality) -> DataFrame:
    """doc_id, source, size and key of every document, beside its own columns in _row."""
    return docs.select(
        F.struct(*docs.columns).alias("_row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        word_count(F.col("text")).alias("size"),
        sampling_key(F.col("doc_id").cast("long"), quality(F.col("text"))).alias("key"),
    )


def _beside(rows: DataFrame, plan: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of the plan, one row for each source, added to rows; a null source finds its own."""
    plan = plan.select(F.col("source").alias("_source"), *columns)
    return rows.join(plan, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def _border(slim: DataFrame, plan: DataFrame, folder: str) -> DataFrame:
    """For each source whose budget ends within it: b_key, b_doc, b_size, the row at which it ends; b_ahead, words before that; b_rows, how many rows are equal to it."""
    open_ = plan.filter("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("ahead"), F.lit(0).cast("long").alias("prefix"), F.lit(63).alias("bits"))
    rows = slim.filter("size > 0").withColumn("place", _place(F.col("key")))
    for level, bits in enumerate(LEVELS):
        inside = rows.join(open_, rows.source.eqNullSafe(open_.source)).drop(open_.source).filter(F.expr("shiftright(place, bits)") == F.col("prefix"))
        cells = inside.groupBy("source", "rest", "ahead", F.shiftright("place", bits).alias("cell")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        upto = cells.withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("words").over(before), F.lit(0)))
        found = upto.filter((F.col("ahead") < F.col("rest")) & (F.col("ahead") + F.col("words") >= F.col("rest")))
        open_ = settle(found.select("source", "rest", "ahead", F.col("cell").alias("prefix"), F.lit(bits).alias("bits"), "n"), folder, f"cells-{level}")
        if not open_.filter(F.col("n") > EDGE_ROWS).limit(1).count():
            break
    edge = rows.join(open_, rows.source.eqNullSafe(open_.source)).drop(open_.source).filter(F.expr("shiftright(place, bits)") == F.col("prefix"))
    kinds = edge.groupBy("source", "rest", "ahead", "key", F.col("doc_id").alias("doc"), "size").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("source").orderBy("key", "doc", "size").rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.withColumn("ahead", F.col("ahead") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(order), F.lit(0)))
    last = kinds.filter((F.col("ahead") < F.col("rest")) & (F.col("ahead") + F.col("n") * F.col("size") >= F.col("rest")))
    return last.select("source", F.col("key").alias("b_key"), F.col("doc").alias("b_doc"), F.col("size").alias("b_size"), F.col("ahead").alias("b_ahead"), F.col("n").alias("b_rows"))


def make_plan(slim: DataFrame, folder: str) -> DataFrame:
    """source, source_size, target, epochs, rest and the border; a row for each source."""
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = settle(source_targets(sizes), folder, "targets")
    goal = F.round("target").cast("long")
    plan = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", goal - F.col("epochs") * F.col("source_size"))
    border = _border(slim, plan, folder)
    return settle(_beside(plan, border, ["b_key", "b_doc", "b_size", "b_ahead", "b_rows"]), folder, "plan")


def _numbered(rows: DataFrame, folder: str) -> DataFrame:
    """Adds turn, from 0 within each source, to rows that are equal but for where they lie; each part of the table counts its own."""
    fixed = settle(rows.withColumn("_part", F.spark_partition_id()), folder, "equal")
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = fixed.groupBy("source", "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    parts = parts.select(F.col("source").alias("_s"), F.col("_part").alias("_p"), "_first")
    own = fixed.withColumn("_own", F.row_number().over(Window.partitionBy("source", "_part").orderBy("key")) - 1)
    joined = own.join(parts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("turn", F.col("_first") + F.col("_own")).drop("_s", "_p", "_part", "_own", "_first")


def with_part(rows: DataFrame, plan: DataFrame, folder: str) -> DataFrame:
    """Adds source_size, target, epochs and part, the words beyond complete epochs, to rows (doc_id, source, size, key)."""
    given = rows.columns
    rows = _beside(rows, plan, [c for c in plan.columns if c != "source"])
    # in order of key, doc_id (null first) and size, as a window would have it
    id_less = (F.col("doc_id").isNull() & F.col("b_doc").isNotNull()) | F.coalesce(F.col("doc_id") < F.col("b_doc"), F.lit(False))
    id_same = F.col("doc_id").eqNullSafe(F.col("b_doc"))
    key_same = F.col("key") == F.col("b_key")
    inside = (F.col("key") < F.col("b_key")) | (key_same & (id_less | (id_same & (F.col("size") < F.col("b_size")))))
    at = F.coalesce(key_same & id_same & (F.col("size") == F.col("b_size")), F.lit(False))
    share = lambda turn: F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("b_ahead") - turn * F.col("size"))).cast("long")
    whole = F.when(inside & (F.col("rest") > 0), F.col("size")).otherwise(F.lit(0)).cast("long")
    columns = [*given, "source_size", "target", "epochs"]
    several = plan.filter("b_rows > 1").limit(1).count() > 0
    if not several:
        return rows.select(*columns, F.when(at, share(F.lit(0))).otherwise(whole).alias("part"))
    equal = at & (F.col("b_rows") > 1)
    single = rows.filter(~equal).select(*columns, F.when(at, share(F.lit(0))).otherwise(whole).alias("part"))
    return single.unionByName(_numbered(rows.filter(equal), folder).select(*columns, share(F.col("turn")).alias("part")))


def mix(docs: DataFrame, quality=text_quality, folder: str | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words, repeats counted)."""
    folder = folder or workspace(docs.sparkSession, "mixing")
    slim = settle(_drawn(docs.select("doc_id", "source", "text"), quality).drop("_row"), folder, "sizes")
    rows = with_part(slim, make_plan(slim, folder), folder)
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def mixture(docs: DataFrame, quality=text_quality, folder: str | None = None) -> DataFrame:
    """The mixed documents with all their columns, a row for each repeat; whole texts only.

    The document in which a budget ends is in if half of it or more would be taken. Texts are read twice and never shuffled.
    """
    folder = folder or workspace(docs.sparkSession, "mixing")
    slim = settle(_drawn(docs.select("doc_id", "source", "text"), quality).drop("_row"), folder, "sizes")
    rows = with_part(_drawn(docs, quality), make_plan(slim, folder), folder)
    copies = F.col("epochs") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)
    repeated = rows.select("_row", F.explode(F.array_repeat(F.lit(0), copies.cast("int"))).alias("_copy"))
    return repeated.select("_row.*")


ORACLE = f"""
WITH t AS (
  SELECT doc_id, source, coalesce(text, '') AS text, ('0x' || substring(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT AS drawn FROM documents),
d AS (
  SELECT doc_id, source, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         -ln((drawn::DOUBLE + 0.5) / {float(1 << 52)!r}::DOUBLE) / greatest(0.05::DOUBLE, 1 - 4 * len(regexp_extract_all(text, '[#*$%&|<>]'))::DOUBLE / greatest(length(text), 1)) AS key
  FROM t),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS k FROM d GROUP BY source),
w AS (SELECT source, source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((k - 1) % 3 + 1)::INT] AS weight, (source_size * {MOST_EPOCHS})::DOUBLE AS most FROM s),
o AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(weight) OVER (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
         sum(source_size) OVER () AS total FROM w),
l AS (SELECT max(CASE WHEN (total - filled) / open_weight <= most / weight THEN (total - filled) / open_weight END) AS level FROM o),
p AS (SELECT source, source_size, coalesce(least(most, level * weight), most) AS target FROM w, l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(round(target)::BIGINT / source_size)::BIGINT ELSE 0 END AS epochs FROM p),
r AS (SELECT *, round(target)::BIGINT - epochs * source_size AS rest FROM q)
SELECT d.doc_id, d.source, d.size, r.source_size, r.target,
       (r.epochs * d.size + greatest(0, least(d.size, r.rest - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
