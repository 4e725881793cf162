"""URL verdicts: longest matching rule, else gradient-boosted trees over lexical features.

Every feature is a column expression and every tree becomes nested CASE expressions,
so all URLs are judged inside Spark's generated code. The trees are fitted on the
driver to SAMPLE labelled rows at most, those with the smallest hash; a row is
labelled if a rule fits it. Statistics of host suffixes are counted over all
labelled rows, into SUFFIX_SLOTS hashed slots, so that their table has a fixed size.

Defined cases: a null url, or one without `://`, has empty host and path, fits no
rule and is judged by the features of its text (null: empty). Without labelled rows
every other url is allowed. Repeated rows come back as often as they came; empty
tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import ascii_lower, settle, smallest_hashes, workspace

#: (host, path, verdict)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
SAMPLE = 10_000
SUFFIX_SLOTS = 1024
TREES, DEPTH, SHRINK, BINS, LEAST_ROWS, RIDGE = 20, 3, 0.3, 16, 20, 1.0
FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "hyphens", "digit_ratio", "entropy", "params", "query_length", "suffix_rate"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def _fits(rule: tuple[str, str, str]) -> Column:
    host, path, _ = rule
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)


def with_rule(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds rule and rule_verdict: those of the longest rule that fits."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(ordered):
        text, verdict = F.when(_fits(r), r[0] + r[1]).otherwise(text), F.when(_fits(r), r[2]).otherwise(verdict)
    return rows.withColumn("rule", text).withColumn("rule_verdict", verdict)


def lexical(pages: DataFrame) -> DataFrame:
    """page_id, host, path and the lexical features."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id"), url.alias("url"), host.alias("host"), path.alias("path"))
    count = lambda c, what: F.char_length(c) - F.char_length(F.replace(c, F.lit(what), F.lit("")))
    n = F.greatest(F.char_length("url"), F.lit(1))
    share = lambda c: (F.char_length("url") - F.char_length(F.replace(F.col("url"), c, F.lit("")))) / n
    letters = F.array_distinct(F.filter(F.split("url", ""), lambda c: c != ""))
    entropy = F.aggregate(F.transform(letters, lambda c: -share(c) * F.log2(F.greatest(share(c), F.lit(1e-12)))), F.lit(0.0), lambda s, x: s + x)
    query = F.regexp_extract("url", r"\?([^#]*)", 1)
    rows = rows.withColumn("query", query).withColumn("suffix", F.substring_index("host", ".", -1))
    return rows.select(
        "page_id", "url", "host", "path",
        F.char_length("url").cast("double").alias("url_length"),
        F.char_length("host").cast("double").alias("host_length"),
        F.char_length("path").cast("double").alias("path_length"),
        count(F.col("path"), "/").cast("double").alias("depth"),
        count(F.col("host"), ".").cast("double").alias("labels"),
        count(F.col("host"), "-").cast("double").alias("hyphens"),
        (F.char_length(F.regexp_replace("url", "[^0-9]", "")) / n).alias("digit_ratio"),
        F.round(entropy, 6).alias("entropy"),
        F.when(F.col("query") == "", 0.0).otherwise((count(F.col("query"), "&") + 1).cast("double")).alias("params"),
        F.char_length("query").cast("double").alias("query_length"),
        F.pmod(F.xxhash64("suffix"), F.lit(SUFFIX_SLOTS)).cast("int").alias("slot"),
    )


def suffix_statistics(rows: DataFrame) -> DataFrame:
    """slot, rate, known: SUFFIX_SLOTS rows at most, over all labelled rows."""
    return rows.filter("rule_verdict is not null").groupBy("slot").agg(F.count(F.lit(1)).alias("known"), F.count_if(F.col("rule_verdict") == "block").alias("blocked"))


def with_suffix(rows: DataFrame, stats: DataFrame) -> DataFrame:
    joined = rows.join(F.broadcast(stats), "slot", "left")
    # a suffix that no rule knows stands at one half; how often one is known says nothing about others
    return joined.withColumn("suffix_rate", (F.coalesce("blocked", F.lit(0)) + 1) / (F.coalesce("known", F.lit(0)) + 2))


@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    cut: float = math.nan
    below: Node | None = None
    above: Node | None = None


@dataclass
class Boosted:
    """Logistic boosting of shallow trees over binned features."""

    base: float = 0.0
    trees: list[Node] = field(default_factory=list)

    def column(self) -> Column:
        """The model as an expression over the feature columns: the probability of a block."""

        def of(node: Node) -> Column:
            if node.feature < 0:
                return F.lit(node.value)
            return F.when(F.col(FEATURES[node.feature]) <= node.cut, of(node.below)).otherwise(of(node.above))

        total = F.lit(self.base)
        for tree in self.trees:
            total = total + of(tree)
        return 1 / (1 + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Boosted:
    """x: rows by features; y: 1 for block."""
    if not len(y) or y.min() == y.max():
        return Boosted(base=(6.0 if len(y) and y[0] else -6.0))
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for column in x.T]
    bins = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)], axis=1)
    # both classes weigh the same: rules label allowed and blocked urls at arbitrary rates
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    model, logit = Boosted(), np.zeros(len(y))

    def grow(rows: np.ndarray, depth: int, grad: np.ndarray, hess: np.ndarray) -> Node:
        g, h = grad[rows].sum(), hess[rows].sum()
        leaf = Node(value=float(SHRINK * g / (h + RIDGE)))
        best = (1e-6, -1, -1)
        if depth and len(rows) >= 2 * LEAST_ROWS:
            for k, c in enumerate(cuts):
                b = bins[rows, k]
                size, gs, hs = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (None, grad[rows], hess[rows]))
                gain = gs**2 / (hs + RIDGE) + (g - gs) ** 2 / (h - hs + RIDGE) - g * g / (h + RIDGE)
                gain[(size < LEAST_ROWS) | (len(rows) - size < LEAST_ROWS)] = -1
                if len(gain) and gain.max() > best[0] + 1e-9:
                    best = (float(gain.max()), k, int(gain.argmax()))
        if best[1] < 0:
            logit[rows] += leaf.value
            return leaf
        _, k, at = best
        low = bins[rows, k] <= at
        return Node(feature=k, cut=float(cuts[k][at]), below=grow(rows[low], depth - 1, grad, hess), above=grow(rows[~low], depth - 1, grad, hess))

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        model.trees.append(grow(np.arange(len(y)), DEPTH, weight * (y - p), weight * p * (1 - p)))
    return model


def train(rows: DataFrame, total: int) -> Boosted:
    """Fits SAMPLE different urls of the `total` labelled rows at most, those with the smallest hash."""
    labelled = rows.filter("rule_verdict is not null").select("url", (F.col("rule_verdict") == "block").cast("int").alias("y"), *FEATURES)
    taken = smallest_hashes(labelled, SAMPLE, total, "url").drop("url").collect()
    table = np.array([tuple(r) for r in taken], float).reshape(len(taken), len(FEATURES) + 1)
    return fit(table[:, 1:], table[:, 0])


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, folder: str | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (probability of a block)."""
    rows = with_rule(lexical(pages), RULES if rules is None else rules)
    stats = settle(suffix_statistics(rows), folder or workspace(pages.sparkSession, "urls"), "suffixes")
    total = stats.agg(F.sum("known").alias("n")).first()["n"] or 0
    rows = with_suffix(rows, stats)
    judged = rows.withColumn("score", train(rows, total).column())
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
#: Host, path and rule in SQL; the trees that judge other urls have no counterpart there.
RULES_ORACLE = f"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT r, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT r, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substring(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(h, s, v) AS (VALUES {_RULES}),
best AS (SELECT r, arg_max(h || s, length(h || s)) AS rule, arg_max(v, length(h || s)) AS verdict FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY r)
SELECT page_id, host, path, rule, verdict AS rule_verdict FROM p LEFT JOIN best USING (r)
"""
