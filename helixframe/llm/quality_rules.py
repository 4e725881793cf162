"""Quality rules: text statistics and a hashed n-gram log-likelihood ratio, all in Spark's own functions.

Two multinomials over hashed word n-grams (orders 1 and 2, BUCKETS cells) are
counted: one over all documents, one over the trusted target, the documents that
are labelled as good. A document's score is the mean over its n-grams of
log p(target) / p(corpus). The threshold is fixed by the trusted documents
themselves, of those long enough for the base rules: the score that all but a SPARED
share reach when each is scored by a target that its own n-grams are taken out of, as
an unseen document is.

Every document labelled good is in the target, and every word in the counts; the
model has BUCKETS rows. The trusted ids stand 64 in a word; up to SLOTS words are
broadcast. Beyond that (ids far apart) they are joined in a shuffle, which a hashed
bitmap keeps most other texts out of.

Defined cases: a null or blank text has no words, score 0 and fails the base rules.
Without labels the ratio is 0 everywhere and the method keeps what the base rules
keep. Repeated rows come back as often as they came; a null doc_id is never trusted;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import bind, bit_of, bitmap, discard, settle, slot_of, slots_for, words_of, workspace

BUCKETS = 1 << 13
#: Words of 64 ids each that are broadcast.
SLOTS = 1 << 20
SMOOTH = 0.5
#: Documents with fewer words fail the base rules.
LEAST_WORDS = 50
#: Share of unseen trusted documents of LEAST_WORDS or more that may fall below the threshold.
SPARED = 0.005
#: Low bits of a window key that hold its position; longer texts take the wide path.
POSITION_BITS = 24
SYMBOLS = "[#*$%&|<>]"


def _ngram_cells(body) -> Column:
    """body(cell of word, cell of word and its follower) for each word of column `w`."""
    return F.zip_with("w", _followers(), lambda a, b: body(_cell(a), _cell(a, b)))


def _followers() -> Column:
    """The words of column `w` from the second on; a word without a follower makes a cell alone."""
    return F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1)))


def _cell(*words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(BUCKETS)).cast("int")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The doc_ids of all documents labelled good, each once."""
    return labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def trusted_rows(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id and text of the documents whose ids are trusted, exactly."""
    met = lambda slot, h: (slot == F.col("slot")) & (F.col("bits").bitwiseAND(bit_of(h)) != 0)
    key, rows = F.col("doc_id"), docs.select("doc_id", "text")
    words = trusted.groupBy(F.shiftright(key, 6).alias("slot")).agg(F.bit_or(bit_of(key)).alias("bits"))
    if words.count() <= SLOTS:
        words = F.broadcast(words)
    else:
        slots = slots_for(trusted.count())
        near = bitmap(trusted.select(F.xxhash64("doc_id").alias("h")), slots)
        rows = rows.join(F.broadcast(near), met(slot_of(F.xxhash64("doc_id"), slots), F.xxhash64("doc_id")), "left_semi")
    return rows.join(words, met(F.shiftright(key, 6), key), "left_semi")


def cell_counts(docs: DataFrame, name: str) -> DataFrame:
    """cell and the number of its n-grams in the documents' texts."""
    words = docs.select(words_of(F.col("text")).alias("w"))
    pairs = words.select(F.explode(F.arrays_zip("w", _followers().alias("v"))).alias("p"))
    cells = pairs.select(F.explode(F.array(_cell(F.col("p.w")), _cell(F.col("p.w"), F.col("p.v")))).alias("cell"))  # no lambda: generated code
    return cells.groupBy("cell").agg(F.count(F.lit(1)).alias(name))


def fit_ratio(docs: DataFrame, trusted: DataFrame, folder: str) -> DataFrame:
    """cell, n_target, llr: the target's count and the log-likelihood ratio of each cell."""
    counts = settle(cell_counts(docs, "n"), folder, "counts")
    targets = settle(cell_counts(trusted_rows(docs, trusted), "n_target"), folder, "targets")
    whole, target = (c.agg(F.sum(c.columns[1])).first()[0] or 0 for c in (counts, targets))
    p = lambda c, n: (F.col(c) + SMOOTH) / F.lit(float(n) + SMOOTH * BUCKETS)
    llr = F.log(p("n_target", target) / p("n", whole)) if target else F.lit(0.0)
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("cell"))
    full = every.join(counts, "cell", "left").join(targets, "cell", "left").na.fill(0)
    return settle(full.select("cell", "n_target", llr.alias("llr")), folder, "ratio")


def as_constant(values: list[float]) -> Column:
    """The BUCKETS numbers as one array that is folded into the plan."""
    return F.split(F.lit(",".join(f"{v:.5f}" for v in values)), ",").cast("array<double>")


def with_score(words: DataFrame, model: Column) -> DataFrame:
    """Adds score, the mean ratio over the n-grams of column `w`."""
    each = _ngram_cells(lambda one, two: F.get(model, one) + F.get(model, two))
    total = F.aggregate(each, F.lit(0.0), lambda s, x: s + x)
    return words.withColumn("score", F.when(F.size("w") > 0, total / (2 * F.size("w"))).otherwise(0.0))


def with_unseen_score(words: DataFrame, model: Column, target: list[int]) -> DataFrame:
    """Adds score, as with_score has it if the target (its counts by cell) had never seen the document."""
    words = words.withColumn("c", F.sort_array(F.flatten(_ngram_cells(F.array))))
    ends = F.filter(F.transform("c", lambda c, i: F.when(F.coalesce(F.get("c", i + 1), F.lit(-1)) != c, i)), lambda i: i.isNotNull())
    words = words.withColumn("e", ends)
    runs = F.zip_with("e", F.slice(F.concat(F.array(F.lit(-1)), "e"), F.lit(1), F.size("e")), lambda e, before: F.struct(F.get("c", e).alias("cell"), (e - before).alias("n")))
    counts, smooth = as_constant(target), SMOOTH * BUCKETS
    less = lambda x: x["n"] * F.log((F.get(counts, x["cell"]) - x["n"] + SMOOTH) / (F.get(counts, x["cell"]) + SMOOTH))
    lost = F.aggregate(F.transform(runs, less), F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size("c"), F.lit(1))
    total = float(sum(target))
    words = with_score(words, model).withColumn("lost", lost - F.log((total - F.size("c") + smooth) / F.lit(total + smooth)))
    return words.withColumn("score", F.when(F.size("w") > 0, F.col("score") + F.col("lost")).otherwise(0.0)).drop("c", "e", "lost")


def trusted_steps(docs: DataFrame, trusted: DataFrame, model: Column, target: list[int]) -> DataFrame:
    """step, n: the histogram of the trusted scores in steps of a thousandth; the null step holds documents that are too short.

    Length is a matter of the key: as a filter it would pass below the join, and every document be split into words.
    """
    words = trusted_rows(docs, trusted).select("doc_id", words_of(F.col("text")).alias("w"))
    step = F.when(F.size("w") >= LEAST_WORDS, F.floor(F.col("score") * 1000))
    return with_unseen_score(words, model, target).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"))


def threshold(docs: DataFrame, trusted: DataFrame, model: Column, target: list[int]) -> float:
    """The step that all but a SPARED share of the trusted documents reach; the histogram has at most a few ten thousand rows."""
    steps = [r for r in trusted_steps(docs, trusted, model, target).collect() if r["step"] is not None]
    left = SPARED * sum(r["n"] for r in steps)
    for r in sorted(steps, key=lambda r: r["step"]):
        left -= r["n"]
        if left < 0:
            return r["step"] / 1000
    return float("-inf")


def _repeats(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in three-word windows that stand twice or more in column `w`.

    Windows sort as numbers, hash above and position below; those with an equal
    neighbour are sorted again by their words, so that a shared hash does no harm.
    """
    n = F.size("w") - 2
    low = (1 << POSITION_BITS) - 1
    key = lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    packed = F.transform(places, lambda i: key(i).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
    rows = rows.withColumn("s", F.sort_array(F.when(n <= low, packed)))
    same = lambda a, b: F.shiftright(a.bitwiseXOR(b), POSITION_BITS) == 0
    near = F.filter("s", lambda x, i: F.coalesce(same(x, F.get("s", i + 1)), F.lit(False)) | F.coalesce(same(x, F.get("s", i - 1)), F.lit(False)))
    at = F.when(F.col("s").isNull(), F.transform(places, lambda i: i.cast("long"))).otherwise(F.transform(near, lambda x: x.bitwiseAND(F.lit(low))))
    window = lambda p: F.struct(*(F.get("w", p.cast("int") + k).alias(f"w{k}") for k in range(3)), p.alias("p"))
    rows = rows.withColumn("e", F.sort_array(F.transform(at, window)))
    equal = lambda a, b: F.coalesce((a["w0"] == b["w0"]) & (a["w1"] == b["w1"]) & (a["w2"] == b["w2"]), F.lit(False))
    twice = F.filter("e", lambda x, i: equal(x, F.get("e", i + 1)) | equal(x, F.get("e", i - 1)))
    rows = rows.withColumn("p", F.sort_array(F.transform(twice, lambda x: x["p"])))
    gaps = F.zip_with("p", F.slice("p", F.lit(2), F.greatest(F.size("p"), F.lit(1))), lambda a, b: F.least(F.lit(3).cast("long"), b - a))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.withColumn("n_repeat_words", F.when(F.size("p") > 0, covered).otherwise(F.lit(0).cast("long"))).drop("s", "e", "p")


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the words `w` and the base statistics of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        words_of(F.col("text")).alias("w"),
        F.char_length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )
    rows = _repeats(rows).withColumn("n_words", F.size("w").cast("long"))
    return rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def quality_rules(docs: DataFrame, labels: DataFrame, folder: str | None = None) -> DataFrame:
    """One row per document: the base statistics, score, base_failed and kept."""
    given, folder = folder, folder or workspace(docs.sparkSession, "quality")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    trusted = settle(trusted_ids(labels), folder, "trusted")
    ratio = sorted(fit_ratio(docs, trusted, folder).collect())
    model = as_constant([r["llr"] for r in ratio])
    least = threshold(docs, trusted, model, [r["n_target"] for r in ratio])
    if given is None:
        discard(docs.sparkSession, folder)
    rows = with_score(base_rules(docs), model)
    kept = ~F.col("base_failed") & (F.col("score") >= F.lit(least))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "score")


#: The base statistics in SQL; the ratio's hashed cells have no counterpart there.
BASE_ORACLE = rf"""
WITH f AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, i, w[i:i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM f)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM f) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols,
         coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM f LEFT JOIN lines USING (r) LEFT JOIN covered USING (r))
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
"""
