"""The plans that operators are meant to have: pruned scans, no needless shuffle, no Python where built-ins do."""

import re

import pytest
from conftest import SMALL

from helixframe.plans.registry import QUERIES
from helixframe.session import spread


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["ascii_upper", "filter_basic", "seq_scan", "nibble_code", "kr_hash", "block_split", "search_nonoverlap", "truncate_text", "partition_sizing", "path_tokens", "n_bits", "size_label"])
def test_rows_stay_where_they_are(name, spark):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert not re.search(r"Exchange|Sort|Python|Arrow|Pandas", plan.replace("AdaptiveSparkPlan", ""))


@pytest.mark.parametrize(("name", "columns"), [("ascii_upper", "doc_id text"), ("partition_sizing", "doc_id text"), ("path_tokens", "page_id url"), ("n_bits", "o_orderkey"), ("dir_tree", "url")])
def test_scans_are_pruned(name, columns, spark):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(QUERIES[name](spark, SMALL)))
    assert read and all([c.split(":")[0] for c in r.split(",")] == columns.split() for r in read)


@pytest.mark.parametrize("name", ["factor_decode", "bitpack", "block_encoded_bytes", "rlz_factorize"])
def test_factors_shuffle_blocks_only(name, spark):
    """One exchange at most: that which spreads a small input."""
    plan = plan_of(QUERIES[name](spark, SMALL))
    exchanges = re.findall(r"Exchange [^\n]*", plan)
    assert len(exchanges) <= 1 and all("REPARTITION" in e for e in exchanges)


def test_large_inputs_are_left_alone(spark):
    many = spark.range(0, 1000, 1, 64)
    assert spread(many, "id") is many
    assert spread(many.coalesce(1), "id").rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_ranges_join_by_equality(spark):
    """Routes and overlays use keys: no nested loops, no cross join."""
    for name in ("route_reference", "mutation_overlay", "newline_update", "range_read", "patch_text"):
        assert not re.search("Cartesian|NestedLoop", plan_of(QUERIES[name](spark, SMALL))), name
