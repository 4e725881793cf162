"""Edge cases and round trips of the sequence-text operators."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.functions import codecs
from helixframe.operators import blocks, catalog, edit, lines, range_read, reference, restore, search
from helixframe.operators.factorize import ReferenceIndex, common_prefix, factorize, short_factor_segments
from helixframe.operators.restore import Layout
from helixframe.sources import config, files

EDGES = ["", "acgt", ">only header", ">h\n", ">h\nACGTacgt\n", "aacc\n\ntt\n", ";x\n#y\nAC\ngT", "\n\n\n", "x\n>h1\n>h2\nlast", "abc\nABC\néÉß\n", "a" * 70_000 + "\nb", "N", "ab>c\nd"]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "file_id long, text string")


def test_restore_edges(spark):
    stored = lines.strip(table(spark, EDGES))
    assert {r.file_id: r.text for r in restore.restore(stored).collect()} == dict(enumerate(EDGES))


def test_worked_example(spark):
    row = table(spark, ["aacc\n\ntt\n"])
    assert [r.nl_pos for r in lines.newline_positions(row).collect()] == [4, 5, 8]
    stored = lines.strip(row).first()
    assert stored.seq == "AACCTT"
    layout = Layout(stored.line_sizes, stored.case_sizes)
    assert (layout.to_seq(5), layout.to_seq(9)) == (4, 6)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAcG>;#\n é", max_size=60), st.integers(0, 70), st.integers(0, 40))
def test_windows(text, start, size):
    rows = text.split("\n")
    header = [r[:1] in (">", ";", "#") and r != "" for r in rows]
    up = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    seq = "".join(r for r, h in zip(rows, header, strict=True) if not h).translate(up)
    store = "".join(r for r, h in zip(rows, header, strict=True) if h).translate(up)
    sizes = [-len(r) - 1 if h else len(r) for r, h in zip(rows, header, strict=True)]
    cases, low = [0], False
    for c in text:
        if ("a" <= c <= "z") != low:
            cases.append(0)
            low = not low
        cases[-1] += 1
    layout = Layout(sizes, cases)
    assert layout.window(start, start + size, lambda a, b: seq[a:b], store) == text[start : start + size]


def test_range_read_borders(spark):
    texts = [t for t in EDGES if len(t) < 1000]
    frame = table(spark, texts)
    stored = lines.strip(frame)
    ref = "".join(sorted({c for t in texts for c in t.upper()} | {"é", "ß", "É"})) + "ACGTACCT"
    cut = blocks.block_split(stored.select("file_id", stored.seq.alias("text")), 4)
    probes = [(k, a, n) for k, t in enumerate(texts) for a in range(len(t) + 2) for n in (0, 1, 5, 50)]
    found = range_read.range_read(spark.createDataFrame(probes, "file_id long, start long, len long"), stored.drop("seq"), factorize(cut, ref), ref, 4).collect()
    assert len(found) == len(probes)
    assert all(r.out == texts[r.file_id][r.start : r.start + r.len] for r in found)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=60), st.text(alphabet="abc", max_size=40))
def test_greedy_against_search(ref, text):
    ref += "abc"
    positions, lengths = ReferenceIndex.of(ref).factors(text)
    at = 0
    for p, n in zip(positions, lengths, strict=True):
        assert ref[p : p + n] == text[at : at + n]
        assert at + n == len(text) or text[at : at + n + 1] not in ref
        at += n
    assert at == len(text)


def test_long_matches():
    ref = "ab" * 500 + "c"
    assert ReferenceIndex.of(ref).factors(ref + ref[:300]) == ([0, ReferenceIndex.of(ref).longest(ref, 0, 300)[0]], [1001, 300])
    assert common_prefix("x" * 100 + "y", "x" * 100 + "z") == 100


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=40), st.text(alphabet="abc", max_size=30), st.integers(0, 30), st.integers(0, 20))
def test_windows_of_the_reference(ref, text, start, size):
    """A factor begins inside the window, can't be longer there, and is the first in suffix order."""
    ref = "abc" * 10 + ref + "abc" * 10
    index, order = ReferenceIndex.of(ref), reference.suffix_array(ref).tolist()
    stop = start + size + 3
    positions, lengths = index.factors(text, (start, stop))
    at = 0
    for p, n in zip(positions, lengths, strict=True):
        places = lambda m, at=at: [q for q in order if start <= q <= stop and ref[q : q + m] == text[at : at + m] and q + m <= len(ref)]
        assert p == places(n)[0] and (at + n == len(text) or not places(n + 1))
        at += n
    assert at == len(text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab", min_size=1, max_size=30), st.text(alphabet="ab", max_size=25), st.integers(1, 5), st.lists(st.booleans(), min_size=30, max_size=30))
def test_valid_matches(ref, text, least, mask):
    """A match ends at a valid place at each of its lengths from the least one on."""
    index, order, valid = ReferenceIndex.of(ref), reference.suffix_array(ref).tolist(), np.array(mask[: len(ref)])
    positions, lengths = index.valid_factors(text, least, valid)
    at = 0
    for p, n in zip(positions, lengths, strict=True):
        places = lambda m, at=at: [q for q in order if at + m <= len(text) and ref[q : q + m] == text[at : at + m] and q + m <= len(ref) and valid[q + m - 1]]
        best = least - 1
        while places(best + 1):
            best += 1
        assert (p, n) == ((places(best)[0], best) if best >= least else (-1, 1))
        at += n
    assert at == len(text)


def test_pieces_of_long_texts(spark, monkeypatch):
    """Positions, runs, places and k-mers are the same whatever the size of pieces."""
    from helixframe.functions import text as text_functions

    texts = ["ab\ncdEfgh\n\nij", "", "abcabcabc", "ABC", "aXbXcé\nd", "a" * 9]
    frame = table(spark, texts)
    for size in (1, 2, 3, 5, 100):
        for module in (text_functions, lines, search):
            monkeypatch.setattr(module, "PIECE", size)
        monkeypatch.setattr(reference, "WINDOWS", size)
        got = {(r.file_id, r.nl_rank, r.nl_pos) for r in lines.newline_positions(frame).collect()}
        assert got == {(k, n, p) for k, t in enumerate(texts) for n, p in enumerate(m.start() for m in re.finditer("\n", t))}
        got = {(r.file_id, r.start, r.end) for r in lines.case_runs(frame).collect()}
        assert got == {(k, m.start(), m.end() - 1) for k, t in enumerate(texts) for m in re.finditer("[a-z]+", t)}
        for pattern in ("a", "abc", "aa", "\n\n"):
            rows = [tuple(r) for r in search.search_all(frame, pattern).collect()]
            assert sorted(rows) == [(k, m.start()) for k, t in enumerate(texts) for m in re.finditer(f"(?={pattern})", t)]
        rows = [tuple(r) for r in reference.kmers(frame.withColumnRenamed("text", "seq"), 3).collect()]
        assert sorted(rows) == [(k, i, t[i : i + 3]) for k, t in enumerate(texts) for i in range(len(t) - 2)]


def test_patches_of_encoded_files(spark):
    ref, size = "ACGTTGCA", 4
    texts = ["ACGTACGTACGT", "ACG", "", "AAAATTTTCC"]
    frame = table(spark, texts)
    encoded = factorize(blocks.block_split(frame, size), ref)
    patches = spark.createDataFrame([(0, 3, "TTTTTT"), (1, 3, "GGGGGG"), (3, 0, "C")], "file_id long, at int, new string")
    from helixframe.operators.factorize import decode, join_blocks

    after = edit.patch_encoded(encoded, patches, ref, size)
    got = {r.file_id: r.text for r in join_blocks(decode(after, ref)).collect()}
    assert got == {0: "ACGTTTTTTCGT"[:3] + "TTTTTT" + "CGT", 1: "ACGGGGGGG", 3: "CAAATTTTCC"}
    same = lambda df: {(r.file_id, r.block_no): (r.ref_pos, r.len) for r in df.collect()}
    assert same(after)[3, 1] == same(encoded)[3, 1] and same(after)[3, 2] == same(encoded)[3, 2]


def test_reference_kinds(spark, tmp_path):
    files.save_reference(reference.single(spark, "ACGTAC"), f"file://{tmp_path}/ref")
    assert files.load_reference(spark, f"file://{tmp_path}/ref", files.FULL)[1].count() == 6
    for kind in (files.SAMPLED, "other"):
        with pytest.raises(ValueError):
            files.load_reference(spark, f"file://{tmp_path}/ref", kind)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**31), max_size=50))
def test_codecs(values):
    x = np.array(values, np.int64)
    for name, (pack, unpack) in codecs.CODECS.items():
        small = x % 5000 if name == "golomb" else x
        assert unpack(pack(small), len(small)).tolist() == small.tolist(), name


def test_suffix_orders_agree(spark):
    rnd = random.Random(3)
    text = "".join(rnd.choice("ab") for _ in range(200))
    order = reference.suffix_array(text).tolist()
    assert order == sorted(range(200), key=lambda p: text[p:])
    symbols = spark.createDataFrame(list(enumerate(text)), "pos long, ch string")
    rows = reference.suffix_order_distributed(symbols).orderBy("rank").collect()
    assert [r.pos for r in rows] == order
    assert reference.suffix_order_distributed(symbols.limit(0)).collect() == []
    assert reference.suffix_array("").tolist() == []


def test_search(spark):
    frame = table(spark, ["aaaa", "", "baab", "a.a.a", "xéx"])
    assert {(r.file_id, r.pos) for r in search.search_all(frame, "aa").collect()} == {(0, 0), (0, 1), (0, 2), (2, 1)}
    assert {(r.file_id, r.pos) for r in search.search_apart(frame, "aa").collect()} == {(0, 0), (0, 2), (2, 1)}
    assert {(r.file_id, r.pos) for r in search.search_apart(frame, "a.a").collect()} == {(3, 0)}
    assert search.search_all(frame, "").count() == search.search_apart(frame, "").count() == 0
    assert {r.file_id: r.cnt for r in search.count_apart(frame, "a.").collect()} == {0: 0, 1: 0, 2: 0, 3: 2, 4: 0}
    assert search.search_all(frame, "much longer than any text").count() == 0


def test_segments_go_on_across_blocks(spark):
    """Against runs over the whole file; one covers a block, others end at a border or before it."""
    size, least, ref = 10, 4, "ACGTTGCA"
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("ACGT") for _ in range(n)) for n in (95, 30, 7, 10)] + ["ACGTTGTACGTATATATATATATAACGTTG", "", "ACGTTGCAAC"]
    frame = table(spark, texts)
    encoded = factorize(blocks.block_split(frame, size), ref).localCheckpoint()
    runs = defaultdict(str)
    for file_id, text in enumerate(texts):
        short = ["|"] * len(text)
        for r in encoded.filter(f"file_id = {file_id}").collect():
            at = r.block_no * size
            for n in r.len:
                if n < least:
                    short[at : at + n] = text[at : at + n]
                at += n
        runs[file_id] = "".join(short)
    segments = short_factor_segments(encoded, ref, least)
    for pattern in ("TA", "GT", "TAT", "TATATATATATA"):
        want = {(k, m.start() // size, m.start() % size) for k, run in runs.items() for m in re.finditer(f"(?={pattern})", run)}
        got = [tuple(r) for r in search.search_segments(segments, pattern, size).collect()]
        assert want and len(got) == len(want) and set(got) == want
    assert any(p + 12 > size for _, _, p in want)


def test_edits(spark):
    frame = table(spark, ["hello", "", "a\nb\nc"])
    patches = spark.createDataFrame([(0, 3, "XYZ"), (1, 2, "q"), (2, 1, "--\n")], "file_id long, at int, new string")
    assert {r.file_id: r.text for r in edit.patch_text(frame, patches).collect()} == {0: "helXYZ", 1: "\0\0q", 2: "a--\nc"}
    moved = edit.shifted_newlines(lines.newline_positions(frame), patches)
    assert {(r.file_id, r.nl_pos) for r in moved.collect()} == {(2, 3)}
    assert {(r.file_id, r.block_no) for r in edit.touched_blocks(patches, 4).collect()} == {(0, 0), (0, 1), (1, 0), (2, 0)}
    changes = spark.createDataFrame([(0, 0, "H"), (0, 4, "O"), (0, 9, "!"), (2, 1, " ")], "file_id long, pos long, ch string")
    sizes = spark.createDataFrame([(0, 5), (1, 0), (2, 5)], "file_id long, n long")
    assert {r.file_id: r.text for r in edit.overlay(frame, edit.valid_mutations(changes, sizes)).collect()} == {0: "HellO", 1: "", 2: "a b\nc"}


def test_slices(spark):
    from helixframe.functions.text import slices

    for text in ["", "abc", "abcdefg", "ébcdéfg", "a" * 10]:
        row = spark.createDataFrame([(text,)], "t string")
        for size, more in ((3, 0), (3, 2), (10, 1)):
            got = row.select(slices(row.t, size, more)).first()[0]
            assert got == [text[k : k + size + more] for k in range(0, len(text), size)]


def test_mutation_files(spark):
    from helixframe.sources import mutations

    good = spark.createDataFrame([(1, bytearray(b"\x05\0\0\0\x01\0\0\0\x04\0\0\0Q"))], "file_id long, content binary")
    assert [tuple(r) for r in mutations.unpack(good).collect()] == [(1, 4, "Q")]
    for wrong in (b"\x04\0\0\0\x01\0\0\0\x04\0\0\0Q", b"\x05\0\0\0\x02\0\0\0\x04\0\0\0Q", b"\x09\0\0\0\x02\0\0\0\x04\0\0\0Q\x04\0\0\0R"):
        with pytest.raises(Exception, match="ValueError"):
            mutations.unpack(spark.createDataFrame([(1, bytearray(wrong))], "file_id long, content binary")).collect()


def test_catalog(spark):
    paths = spark.createDataFrame([(1, "/a/b/c"), (2, "/a/b"), (3, "/ab/c"), (4, "/"), (5, "/a")], "id long, path string")
    routes = spark.createDataFrame([("/a", "r1"), ("/a/b", "r2"), ("/", "root")], "prefix string, ref_id string")
    assert {r.id: r.ref_id for r in catalog.route(paths, routes).collect()} == {1: "r2", 2: "r1", 3: "root", 4: "root", 5: "root"}
    tree = catalog.dir_tree(paths)
    assert {(r.path, r.is_dir) for r in tree.collect()} == {("/a", True), ("/a/b", True), ("/a/b/c", False), ("/ab", True), ("/ab/c", False)}
    assert {(r.name, r.is_dir) for r in catalog.children(tree, "/a").collect()} == {("b", True)}
    files_ = spark.createDataFrame([("/x.fa.z", 1)], "path string, status int")
    assert catalog.rename(files_, "/x.fa.z", "/x.fa", ".z").first() == ("/x.fa", "decode")
    assert catalog.remove(files_, files_.select("path")).count() == 0


def test_config():
    found = config.parse("# c\nblock = 10 # more\nn_ref = 2\n/a = r1\n/b= r2\nthreads=4\n")
    assert found.values["block"] == "10" and found.number("threads", 1) == 4 and found.number("none", 7) == 7
    assert found.routes == [("/a", "r1"), ("/b", "r2")]
    for wrong in ("nonsense", "n_ref = 2\n/a = r"):
        with pytest.raises(ValueError):
            config.parse(wrong)


def test_files_and_stream(spark, tmp_path):
    from helixframe.streaming import ingest

    texts = {"a.fa": ">h\nACGT\nacgt\n", "b.fa": "GATTACA", "c.fa": ""}
    (tmp_path / "in").mkdir()
    for name, text in texts.items():
        (tmp_path / "in" / name).write_text(text)
    rows = files.read_sequences(spark, f"file://{tmp_path}/in")
    assert {r.path.rpartition("/")[2]: r.text for r in rows.collect()} == {k: t for k, t in texts.items() if t}
    files.save_container(rows.select("file_id", "text"), "ACGT", f"file://{tmp_path}/box", 3)
    back = {r.file_id: r.text for r in files.read_back(spark, f"file://{tmp_path}/box", "ACGT").collect()}
    assert back == {r.file_id: r.text for r in rows.collect()}
    ref = reference.single(spark, "ACGTAC")
    files.save_reference(ref, f"file://{tmp_path}/ref")
    text, order = files.load_reference(spark, f"file://{tmp_path}/ref", sampled=2)
    assert text.first().text == "ACGTAC" and [r.pos for r in order.orderBy("rank").collect()] == sorted(range(6), key=lambda p: "ACGTAC"[p:])

    query = ingest.encode_stream(ingest.arriving(spark, f"file://{tmp_path}/in"), "ACGT", f"file://{tmp_path}/out", f"file://{tmp_path}/mark", 4)
    query.awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out/layout").count() == 2


def test_block_lengths_invert_offsets(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 1, 7), (2, 0, 0)], "file_id long, block_no int, bytes_len long")
    back = blocks.block_lengths(blocks.block_offsets(rows))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
