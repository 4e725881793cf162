"""Every query against its SQL, and those without SQL against plain Python."""

import re
from collections import Counter

import pytest
from conftest import SMALL

from helixframe.functions import bits
from helixframe.operators import factorize, reference
from helixframe.operators.factorize import ReferenceIndex
from helixframe.plans import registry

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def blocks(spark):
    return {(r.file_id, r.block_no): r.text for r in registry.seq_blocks(spark, SMALL).collect()}


@pytest.fixture(scope="module")
def ref(spark):
    return registry.ref_text(spark, SMALL)


def greedy(text, ref):
    out, at = [], 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in ref:
            n += 1
        out.append((text[at : at + n], n))
        at += n
    return out


def test_factors_are_greedy(spark, blocks, ref):
    found = {}
    for r in QUERIES["rlz_factorize"](spark, SMALL).orderBy("file_id", "block_no", "factor_no").collect():
        found.setdefault((r.file_id, r.block_no), []).append(r)
    assert set(found) == set(blocks)
    for key, rows in found.items():
        want = greedy(blocks[key], ref)
        assert [(ref[r.ref_pos : r.ref_pos + r.len], r.len) for r in rows] == want
        assert [r.text_off for r in rows] == [sum(n for _, n in want[:k]) for k in range(len(want))]


def test_ranges_bind(spark):
    """Blocks move the window: factors lie inside it, and some would lie elsewhere without it."""
    near = reference.collect_reference(registry.ref_build_ranges(spark, SMALL))
    rows = QUERIES["rlz_factorize_range"](spark, SMALL).collect()
    for r in rows:
        start = r.block_no * registry.BLOCK
        assert min(start, len(near)) - registry.REACH <= r.ref_pos <= start + registry.REACH
    free = factorize.factors(factorize.factorize(registry.seq_blocks(spark, SMALL), near)).collect()
    assert {tuple(r) for r in rows} != {tuple(r) for r in free}


def test_first_in_suffix_order(ref):
    index = ReferenceIndex.of("banana$ananas")
    order = reference.suffix_array("banana$ananas").tolist()
    assert order == sorted(range(13), key=lambda p: "banana$ananas"[p:])
    assert index.longest("anan", 0, 4) == (next(p for p in order if "banana$ananas"[p:].startswith("anan")), 4)
    with pytest.raises(ValueError):
        index.factors("bz")


def test_min_length(spark, blocks, ref):
    """Against a plain search: matches of LEAST or more whose ends are valid at every length."""
    valid = [any(a <= p < b for a, b in registry.VALID) for p in range(len(ref))]
    found = {}
    for r in QUERIES["rlz_min_length"](spark, SMALL).orderBy("file_id", "block_no", "factor_no").collect():
        found.setdefault((r.file_id, r.block_no), []).append(r)
    assert set(found) == set(blocks)
    for key in sorted(found)[:40]:
        text, at = blocks[key], 0
        ends = lambda w: any(valid[m.start() + len(w) - 1] for m in re.finditer(f"(?={w})", ref))
        for r in found[key]:
            n = registry.LEAST - 1
            while at + n < len(text) and ends(text[at : at + n + 1]):
                n += 1
            assert r.len == (n if n >= registry.LEAST else 1) and (r.ref_pos >= 0) == (n >= registry.LEAST)
            assert r.ref_pos < 0 or (ref[r.ref_pos : r.ref_pos + n] == text[at : at + n] and valid[r.ref_pos + n - 1])
            at += r.len


def by_block(spark):
    found = {}
    for r in QUERIES["rlz_factorize"](spark, SMALL).collect():
        found.setdefault((r.file_id, r.block_no), []).append((r.factor_no, r.ref_pos, r.len))
    return {k: sorted(v) for k, v in found.items()}


def test_sizes(spark):
    found, files = by_block(spark), Counter()
    words = lambda n: 4 * -(-n // 32)
    width = lambda n: max(1, n.bit_length())
    want = {}
    for key, factors in found.items():
        high = max(p for _, p, _ in factors)
        want[key] = (words(8 + len(factors) * width(high)), words(sum((n >> 6) + 7 for _, _, n in factors)))
        files[key[0]] += sum(want[key])
    rows = QUERIES["block_encoded_bytes"](spark, SMALL).collect()
    assert {(r.file_id, r.block_no): (r.pos_bytes, r.len_bytes) for r in rows} == want
    assert {r.file_id: r.bytes for r in QUERIES["encoded_size"](spark, SMALL).collect()} == dict(files)
    offsets = {(r.file_id, r.block_no): r.bytes_pos for r in QUERIES["encoded_offsets"](spark, SMALL).collect()}
    assert offsets == {k: sum(sum(v) for j, v in want.items() if j[0] == k[0] and j[1] < k[1]) for k in want}
    for r in QUERIES["block_bitwidth"](spark, SMALL).collect():
        p = [x for _, x, _ in found[r.file_id, r.block_no]]
        assert (r.n, r.low, r.high, r.width, r.delta_width) == (len(p), min(p), max(p), width(max(p)), width(max(p) - min(p)))


def test_segments_of_short_factors(spark, blocks):
    want = set()
    for key, factors in by_block(spark).items():
        at, run = 0, None
        for _, _, n in [*factors, (0, 0, 99)]:
            if n < 5 and run is None:
                run = at
            elif n >= 5 and run is not None:
                want.add((*key, run, blocks[key][run:at]))
                run = None
            at += n
    assert {tuple(r) for r in QUERIES["segment_index"](spark, SMALL).collect()} == want


def test_search_in_segments(spark):
    want = set()
    for r in QUERIES["segment_index"](spark, SMALL).collect():
        want |= {(r.file_id, r.block_no, r.seg_start + m.start()) for m in re.finditer("(?=TACG)", r.seg_text)}
    assert want and {tuple(r) for r in QUERIES["search_segments"](spark, SMALL).collect()} == want


def test_codes(spark):
    rows = {r.codec: r for r in QUERIES["codec_roundtrip"](spark, SMALL).collect()}
    assert len(rows) == 5 and all(r.ok for r in rows.values())
    assert all(r.ok for r in QUERIES["meta_blocks"](spark, SMALL).collect())


def test_samples(spark):
    seq = {r.file_id: r.seq for r in registry.seqs(spark, SMALL).collect()}
    rows = QUERIES["segment_sample"](spark, SMALL).collect()
    assert len(rows) == 3 * sum(bool(s) for s in seq.values())
    assert all(r.text == seq[r.file_id][r.pos : r.pos + 100] and r.text for r in rows)
    assert {tuple(r) for r in rows} == {tuple(r) for r in QUERIES["segment_sample"](spark, SMALL).collect()}
    parts = QUERIES["ref_prepare"](spark, SMALL).collect()
    top = Counter(s[i : i + 16] for s in seq.values() for i in range(len(s) - 15)).most_common(1)[0][1]
    assert max(r.weight for r in parts if r.source == "kmer") == top
    segments = [r for r in parts if r.source == "segment"]
    assert abs(len(segments) - registry.PREPARED * 9 // 10 // registry.SEGMENT) <= 12
    assert all(r.text in seq[r.weight] for r in segments)


def test_n_bits_of_zero(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(bits.n_bits(F.lit(0)).alias("b"), bits.varbyte_size(F.lit(127)).alias("v"), bits.varbyte_size(F.lit(128)).alias("w"), bits.varbyte_size(F.lit((1 << 62) + 1)).alias("x"), bits.golomb_bits(F.lit(64)).alias("g")).first()
    assert tuple(row) == (1, 1, 2, 9, 8)


def test_nothing_but_ascii_is_folded(spark):
    from pyspark.sql import functions as F

    from helixframe.functions.text import ascii_lower, ascii_upper

    row = spark.createDataFrame([("aÉéß",)], "t string").select(ascii_upper(F.col("t")), ascii_lower(F.col("t"))).first()
    assert tuple(row) == ("AÉéß", "aÉéß")
    assert re.sub("[A-Z]", "", row[1]) == row[1]
