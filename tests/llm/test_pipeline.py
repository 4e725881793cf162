"""The pipeline's stages against plain versions, each on its own input."""

import re
from collections import Counter

import pytest
from conftest import SMALL
from test_ops import DOCS, edge_rows, plain_components, plain_dedup, plain_targets

import corpus_pipeline
from helixframe.llm import bpe, mixing


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "mixing", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    return frame.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame([r for r in edge_rows() if r[0] is not None and r[0] > 6], DOCS).selectExpr("doc_id + 9000", "text", "lang", "source", "n_chars"))


def test_language_stage(spark, docs):
    kept = corpus_pipeline.language_stage(spark, docs, SMALL)
    assert kept.columns == docs.columns
    want = Counter(r.doc_id for r in docs.collect() if any(map(str.isalpha, r.text or "")))
    assert Counter(r.doc_id for r in kept.collect()) == want


def test_dedup_stage(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = Counter(k for (k, _, _, stays, _), n in plain_dedup(rows).items() for _ in range(n) if stays)
    kept = corpus_pipeline.exact_dedup_stage(spark, docs, SMALL)
    assert Counter(r.doc_id for r in kept.collect()) == want and kept.columns == docs.columns


def test_jaccard_stage(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = Counter(k for k, _, c in plain_components(rows) if k == c)
    kept = corpus_pipeline.jaccard_stage(spark, docs, SMALL)
    assert Counter(r.doc_id for r in kept.collect()) == want and kept.columns == docs.columns


def test_mixing_stage(spark, docs):
    mixed = corpus_pipeline.mixing_stage(spark, docs, SMALL)
    assert mixed.columns == docs.columns
    texts = {(r.doc_id, r.text): r.source for r in docs.collect()}
    sizes, taken, largest = Counter(), Counter(), Counter()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for (_, t), s in texts.items():
        largest[s] = max(largest[s], count(t))
    for r in docs.collect():
        sizes[r.source] += count(r.text)
    for r in mixed.collect():
        assert (r.doc_id, r.text) in texts
        taken[r.source] += count(r.text)
    for s, t in plain_targets(dict(sizes)).items():
        assert abs(taken[s] - t) <= largest[s]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_nulls_and_nothing(spark, stage):
    edges = spark.createDataFrame(edge_rows(), DOCS)
    wide = edges.selectExpr("*", "'x' AS size", "1 AS _key", "'y' AS score", "2 AS rep", "3 AS bucket")
    rows = stage(spark, wide, SMALL)
    empty = stage(spark, wide.limit(0), SMALL)
    assert empty.collect() == [] and empty.columns == rows.columns
    if stage is not corpus_pipeline.encoding_stage:
        assert rows.columns == wide.columns
    assert {r.doc_id for r in rows.collect()} <= {r[0] for r in edge_rows()}


def test_run(spark):
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in frame.collect() if any(map(str.isalpha, r.text or ""))]
    stays = {k for (k, _, _, s, _) in plain_dedup(rows) if s}
    rows = [(k, t) for k, t in rows if k in stays]
    stays = {k for k, _, c in plain_components(rows) if k == c}
    left = frame.filter(frame.doc_id.isin(sorted(stays)))
    want = Counter(tuple(r) for r in bpe.encode_decode(mixing.mixture(left)).collect())
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect()) == want
