"""The ten operators on small tables: edge cases, and plain versions of each."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.llm import bpe, exact_dedup, jaccard_join, language_id, license_scan, mixing, quality_classifier, quality_rules, queries, token_counts, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def edge_rows():
    rnd = random.Random(5)
    long = " ".join(rnd.choice("alpha beta gamma delta été niño".split()) + str(k % 97) for k in range(30_000))
    texts = [None, "", "   \n\t ", "one", "a b c d", "A B C D", "a b c d e f", long, long + " end", "MIT License and mit license", "né à Paris <|endoftext|> x", "12345 !!", "a\u00a0b  c\u2003d"]
    rows = [(k, t, ("en", "fr", None)[k % 3], (None, "s1", "s2", "")[k % 4], len(t or "")) for k, t in enumerate(texts)]
    return rows + [rows[6], rows[6], (None, "a b c d e f", None, None, None), (None, None, None, None, None), (100, "a b c d e f", "en", "s1", 11)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(edge_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, int(k % 2), 0) for k in range(13)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def small(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def operators(labels):
    return {
        1: bpe.encode_decode,
        2: token_counts.token_counts,
        3: lambda d: quality_rules.quality_rules(d, labels),
        5: jaccard_join.jaccard_components,
        6: license_scan.license_scan,
        7: mixing.mix,
        8: lambda d: quality_classifier.quality_classifier(d, labels),
        9: language_id.predict,
        10: exact_dedup.exact_dedup,
    }


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 7, 8, 9, 10])
def test_empty_table_and_clashing_columns(spark, labels, edges, n):
    op = operators(labels)[n]
    assert op(spark.createDataFrame([], DOCS)).collect() == []
    names = ["size", "key", "bucket", "score", "kept", "digest", "norm", "n", "rep", "w", "h", "slot", "bits", "label", "token", "rank", "top", "words", "low", "held_out"]
    wide = edges.selectExpr("*", *(f"'x' AS {c}" for c in names))
    columns = lambda df: sorted(map(str, (tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())))
    assert len(columns(op(wide))) == len(edge_rows())
    assert columns(op(wide)) == columns(op(edges))


def test_registered():
    found = {int(m[1]) for q in queries.QUERIES if (m := re.match(r"op(\d+)_", q))}
    assert found == set(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(name, same_rows):
    same_rows(queries.QUERIES[name], queries.ORACLES[name])


# -- 1 ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def model():
    return bpe.ByteBpe(bpe.read_spec())


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_bpe_query(spark, edges, library, small):
    rows = [(r.doc_id, r.text) for r in edges.collect()] + small
    want = Counter()
    for k, t in rows:
        e = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(e, skip_special_tokens=False)
        want[k, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    got = Counter(map(tuple, bpe.encode_decode(edges).collect())) + Counter(map(tuple, queries.QUERIES["op1_bpe"](spark, SMALL).collect()))
    assert got == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aabet h\n\t'sdl.!19 \u00a0é漢"), st.characters(codec="utf-8")), max_size=60))
def test_bpe_any_text(text):
    m, t = bpe.load(bpe.read_spec()), _library()
    got = m.encode([text])[0]
    want = t.encode(text, add_special_tokens=False).ids
    assert ids(got) == want and m.decode(got) == t.decode(want, skip_special_tokens=False)


def _library(kept=[]):  # noqa: B006
    if not kept:
        import public_tokenizers
        from tokenizers import Tokenizer

        kept.append(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    return kept[0]


def test_bpe_pairs_and_long_words(model, library):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abet") for _ in range(n)) for n in (1, 5, 39, 41, 64, 65, 3000)] + ["a" * 5000, "ab" * 2000]
    for w in words:
        assert ids(model.encode([w])[0]) == library.encode(w, add_special_tokens=False).ids
        raw = w.encode()
        assert model.exact([raw])[0] == model._exact_long([int(model.base[b]) for b in raw]) == library.encode(w, add_special_tokens=False).ids


def test_bpe_table_forgets(model, library):
    table = bpe.Recent(3)
    for k in range(20):
        table.learn(str(k), b"x")
        table.turn()
        assert len(table) + len(table.old) <= 9
    table.learn("y" * 100, b"z")
    table.turn()
    assert "y" * 100 not in table and table.lacking({"nope"}) == {"nope"}


def test_bpe_outputs(spark):
    docs = spark.createDataFrame([(1, "Hello  world")], "doc_id long, text string")
    row = bpe.encode_decode(docs, with_ids=True).first()
    assert row.decoded == "Hello  world" and len(row.ids) == 4 * row.n_tokens


# -- 2 ----------------------------------------------------------------------------------


def test_counts_against_library(spark, small):
    from tokenizers import Tokenizer, models

    pieces = token_counts.read_pieces()
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=False))
    rows = token_counts.token_counts(spark.createDataFrame([*small, (-1, "  a  b "), (-2, "漢\n字 x"), (-3, "▁▁a")], "doc_id long, text string")).collect()
    texts = dict(small) | {-1: "  a  b ", -2: "漢\n字 x", -3: "▁▁a"}
    for r in rows:
        text = "▁" + texts[r.doc_id].replace(" ", "▁")
        found = library.encode(text, add_special_tokens=False)
        assert r.n_tokens == sum(1 if k else len(text[a:b].encode()) for k, (a, b) in zip(found.ids, found.offsets, strict=True))


def test_counts_by_brute_force():
    pieces = [("▁", -3.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("▁a", -5.0), ("ba", -3.0), ("aba", -6.0)]
    m, score = token_counts.CountingViterbi(pieces), dict(pieces)
    unknown = -6.0 - token_counts.UNKNOWN_PENALTY

    def best(text):
        ends = {0: (0.0, 0)}
        for e in range(1, len(text) + 1):
            for s in range(e):
                piece = text[s:e]
                if piece in score:
                    new = (ends[s][0] + score[piece], ends[s][1] + 1)
                elif e - s == 1:
                    new = (ends[s][0] + unknown, ends[s][1] + len(piece.encode()))
                else:
                    continue
                if e not in ends or new[0] > ends[e][0]:
                    ends[e] = new
        return ends[len(text)]

    rnd = random.Random(1)
    for _ in range(500):
        text = "".join(rnd.choice("ab é") for _ in range(rnd.randint(1, 14)))
        s, n = best("▁" + text.replace(" ", "▁"))
        assert m.count([text])[0] == (n, s)


# -- 3 ----------------------------------------------------------------------------------


def statistics(text):
    words = re.findall(WORD, text or "")
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_base_rules(spark, edges, labels):
    rnd = random.Random(2)
    more = [(k, " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 80)))) for k in range(500, 600)] + [(700, "x y\nx y\n\n \nx y \n#|"), (701, "a a a a a")]
    frame = edges.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    rows = quality_rules.quality_rules(frame, labels).collect()
    want = Counter((r.doc_id, *statistics(r.text)) for r in frame.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert not any(r.kept and r.base_failed for r in rows)


def test_colliding_windows(spark, monkeypatch):
    """With few hash bits windows collide often; their words must decide."""
    monkeypatch.setattr(quality_rules, "POSITION_BITS", 58)
    rnd = random.Random(4)
    texts = [(k, " ".join(rnd.choice("abcdefgh") for _ in range(60))) for k in range(40)]
    rows = quality_rules.base_rules(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_repeat_words for r in rows} == {k: statistics(t)[4] for k, t in texts}
    monkeypatch.setattr(quality_rules, "POSITION_BITS", 3)  # all texts are too long for the short keys
    rows = quality_rules.base_rules(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_repeat_words for r in rows} == {k: statistics(t)[4] for k, t in texts}


def test_ratio_tells_junk(spark):
    rows = quality_rules.quality_rules(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    found = [r for r in rows.collect() if not r.base_failed and r.doc_id in quality]
    good, junk = ([r.kept for r in found if quality[r.doc_id] == q] for q in (1, 0))
    assert np.mean(good) > 0.97
    assert not junk or np.mean(junk) < np.mean(good)


def test_junk_past_the_base_rules_goes(spark):
    """Most labelled junk is dropped, and good documents whose labels are hidden stay."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.quality for r in labels.collect()}
    for hidden in (lambda k: False, lambda k: zlib.crc32(str(k).encode()) % 3 == 0):
        shown = [(k, q) for k, q in known.items() if not hidden(k)]
        found = [r for r in quality_rules.quality_rules(docs, spark.createDataFrame(shown, "doc_id long, quality int")).collect() if not r.base_failed and r.doc_id in known]
        assert np.mean([r.kept for r in found if known[r.doc_id] == 0]) < 0.1
        assert np.mean([r.kept for r in found if known[r.doc_id] == 1]) > 0.97
        assert np.mean([r.kept for r in found if known[r.doc_id] == 1 and hidden(r.doc_id)] or [1]) > 0.97


def test_unseen_score_leaves_a_document_out(spark):
    docs = spark.createDataFrame([(1, "a b a b c"), (2, "a b d"), (3, "e f"), (4, "")], "doc_id long, text string")
    trusted = spark.createDataFrame([(1, True), (2, True), (4, True)], "doc_id long, trusted boolean")

    def model(trusted, name):
        ratio = sorted(quality_rules.fit_ratio(docs, trusted, quality_rules.workspace(spark, name)).collect())
        return quality_rules.as_constant([r.llr for r in ratio]), [r.n_target for r in ratio]

    words = docs.select("doc_id", quality_rules.words_of(docs.text).alias("w"))
    unseen = {r.doc_id: r.score for r in quality_rules.with_unseen_score(words, *model(trusted, "all")).collect()}
    for k in (1, 2, 4):
        without = quality_rules.with_score(words, model(trusted.filter(f"doc_id != {k}"), "less")[0])
        assert unseen[k] == pytest.approx({r.doc_id: r.score for r in without.collect()}[k], abs=1e-4)


def plain_cells(words):
    """Cells of each word and of each word with its follower, by Spark's hash (XXH64, seed 42, chained)."""
    one = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    two = [xxhash.xxh64_intdigest(b.encode(), h) for h, b in zip(one, words[1:], strict=False)] + one[-1:]
    return [h % quality_rules.BUCKETS for h in one], [h % quality_rules.BUCKETS for h in two]


def test_verdicts_by_brute_force(spark, small):
    """Counts, ratio, scores, threshold and verdicts in plain Python."""
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    cells = {k: plain_cells(re.findall(WORD, t or "")) for k, t in small}
    size, smooth = quality_rules.BUCKETS, quality_rules.SMOOTH
    whole, target = np.zeros(size), np.zeros(size)
    for k, (one, two) in cells.items():
        np.add.at(whole, one + two, 1)
        if k in good:
            np.add.at(target, one + two, 1)
    llr = np.round(np.log((target + smooth) / (target.sum() + smooth * size)) - np.log((whole + smooth) / (whole.sum() + smooth * size)), 5)
    score = {k: float(llr[one + two].mean()) if one else 0.0 for k, (one, two) in cells.items()}
    steps = []
    for k in good & set(cells):
        own = np.array(cells[k][0] + cells[k][1], int)
        if len(own) >= 2 * quality_rules.LEAST_WORDS:
            at, n = np.unique(own, return_counts=True)
            lost = (n * np.log((target[at] - n + smooth) / (target[at] + smooth))).sum() / len(own)
            steps.append(math.floor(1000 * (score[k] + lost - math.log((target.sum() - len(own) + smooth * size) / (target.sum() + smooth * size)))))
    least = sorted(steps)[int(quality_rules.SPARED * len(steps))] / 1000
    rows = quality_rules.quality_rules(spark.read.parquet(f"{SMALL}/documents.parquet"), labels).collect()
    assert len(rows) == len(small)
    for r in rows:
        assert r.score == pytest.approx(score[r.doc_id], abs=1e-4)
        assert abs(score[r.doc_id] - least) < 1e-4 or r.kept == (not r.base_failed and score[r.doc_id] >= least)
    assert 0 < sum(r.kept for r in rows) < len(rows)


def test_only_trusted_texts_are_split(spark):
    """The threshold's filter on length must not pass below the join; blank and short trusted texts set no threshold."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    model, target = quality_rules.as_constant([0.0] * quality_rules.BUCKETS), [1] * quality_rules.BUCKETS
    trusted = spark.range(5).select(F.col("id").alias("doc_id"), F.lit(True).alias("trusted"))
    plan = quality_rules.trusted_steps(docs, trusted, model, target)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("LeftSemi") :]
    assert "split(" in plan and "split(" not in below
    short = spark.createDataFrame([(1, ""), (2, None), (3, "a b"), (4, "a " * 49)], "doc_id long, text string")
    assert quality_rules.threshold(short, trusted, model, target) == float("-inf")


@pytest.mark.parametrize("slots", [quality_rules.SLOTS, 0])
def test_every_good_label_is_trusted(spark, monkeypatch, slots):
    """30,000 good labels: each of their documents is in the target and in the threshold's histogram, by broadcast and by shuffle."""
    monkeypatch.setattr(quality_rules, "SLOTS", slots)
    labels = spark.range(-3000, 30_000).selectExpr("id AS doc_id", "int(id >= 0) AS quality").union(spark.createDataFrame([(None, 1), (7, 1)], "doc_id long, quality int"))
    texts = [(k, f"a{k} b " * 30) for k in range(-3000, 30_000, 300)] + [(300, "x y"), (40_000, "z " * 60), (None, "n " * 60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    good = [(k, t) for k, t in texts if k is not None and 0 <= k < 30_000]
    cells = Counter(c for _, t in good for part in plain_cells(t.split()) for c in part)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        trusted = quality_rules.trusted_ids(labels)
        ratio = sorted(quality_rules.fit_ratio(docs, trusted, quality_rules.workspace(spark, "all")).collect())
        model, target = quality_rules.as_constant([r.llr for r in ratio]), [r.n_target for r in ratio]
        steps = quality_rules.trusted_steps(docs, trusted, model, target).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r.cell: r.n_target for r in ratio if r.n_target} == cells
    assert sum(r.n for r in steps) == len(good) and [r.n for r in steps if r.step is None] == [1]


def test_no_labels_keep(spark, edges):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept == (not r.base_failed) for r in quality_rules.quality_rules(edges, none).collect())


# -- 4 ----------------------------------------------------------------------------------


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return lower(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_urls(spark):
    urls = [None, "", "nothing", "http://", "http://EXAMPLE.com", "http://example.com/", "http://example.com/en/x?q=/fr/", "http://www.example.com/en/1", "http://a.www.example.com/en/", "http://x.net/es", "http://x.net/es/", "https://x.net/fr/#a", "ftp://notexample.com/en/", "http://com/en", "a://b://c/d", "http://net/es/1", "http://héllo.org/é?x=1&y=2", "http://x.org?a/b"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)] + [(0, None, "h")], "page_id long, url string, html string")
    rows = url_filter.url_filter(pages).collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        host, path = plain_url(urls[r.page_id])
        fits = [x for x in url_filter.RULES if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        rule = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0] + rule[1])
        assert r.verdict == rule[2] if rule else r.verdict in ("allow", "block")
        assert 0 <= r.score <= 1
    assert url_filter.url_filter(pages.limit(0)).collect() == []


def test_trees_learn_and_become_columns(spark):
    rnd = np.random.default_rng(0)
    x = rnd.random((3000, len(url_filter.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.7)).astype(float)
    m = url_filter.fit(x, y)
    frame = spark.createDataFrame(x[:300].tolist(), url_filter.FEATURES).select(m.column().alias("p"))
    p = np.array([r.p for r in frame.collect()])
    assert ((p > 0.5) == (y[:300] > 0.5)).mean() > 0.97
    assert url_filter.fit(x[:0], y[:0]).trees == [] and url_filter.fit(x, y * 0).trees == []


def plain_features(url):
    host, path = plain_url(url)
    n, query = max(len(url), 1), re.search(r"\?([^#]*)", url)
    query = query[1] if query else ""
    shares = [c / n for c in Counter(url).values()]
    return {
        "url_length": len(url), "host_length": len(host), "path_length": len(path), "depth": path.count("/"), "labels": host.count("."), "hyphens": host.count("-"),
        "digit_ratio": sum(c in "0123456789" for c in url) / n, "entropy": -sum(p * math.log2(p) for p in shares), "params": query.count("&") + 1 if query else 0, "query_length": len(query),
    }


def test_verdicts_of_trees_by_hand(spark):
    """Features, suffix rates, and every tree walked node by node."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url")
    pages = pages.union(spark.createDataFrame([(-k, f"http://h{k % 7}.{'org' if k % 3 else 'net'}/{'es' if k % 2 else 'de'}/{k}?a=1&b={k}") for k in range(1, 300)], "page_id long, url string"))
    rows = url_filter.with_rule(url_filter.lexical(pages), url_filter.RULES)
    stats = url_filter.suffix_statistics(rows)
    model = url_filter.train(url_filter.with_suffix(rows, stats), stats.agg({"known": "sum"}).first()[0])
    slots, known, blocked = {}, Counter(), Counter()
    for r in rows.collect():
        slots[r.page_id] = r.slot
        known[r.slot] += r.rule_verdict is not None
        blocked[r.slot] += r.rule_verdict == "block"

    def walk(node, x):
        while node.feature >= 0:
            node = node.below if x[url_filter.FEATURES[node.feature]] <= node.cut else node.above
        return node.value

    urls, seen = {r.page_id: r.url for r in pages.collect()}, Counter()
    for r in url_filter.url_filter(pages).collect():
        x = plain_features(urls[r.page_id]) | {"suffix_rate": (blocked[slots[r.page_id]] + 1) / (known[slots[r.page_id]] + 2)}
        x["entropy"] = round(x["entropy"], 6)
        p = 1 / (1 + math.exp(-model.base - sum(walk(t, x) for t in model.trees)))
        assert r.score == pytest.approx(p, abs=1e-6)
        if r.rule is None:
            assert r.verdict == ("block" if r.score > 0.5 else "allow")
            seen[r.verdict] += 1
    assert len(seen) == 2 and model.trees


def test_urls_with_clashing_columns(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    names = ["host", "path", "rule", "verdict", "score", "suffix", "slot", "known", "blocked", "entropy", "depth", "labels", "query", "rule_verdict", "y"]
    rows = lambda df: Counter(map(tuple, url_filter.url_filter(df).collect()))
    assert rows(pages.selectExpr("*", *(f"'x' AS {c}" for c in names))) == rows(pages)


def test_url_reruns_agree(spark):
    one, two = (Counter(map(tuple, queries.QUERIES["op4_url_filter"](spark, SMALL).collect())) for _ in range(2))
    assert one == two


def test_bounded_sample_is_the_plain_one(spark):
    from pyspark.sql import functions as F

    from helixframe.llm.common import smallest_hashes

    rows = spark.range(5000).withColumnRenamed("id", "k")
    want = [r.k for r in rows.orderBy(F.xxhash64("k")).limit(100).collect()]
    assert [r.k for r in smallest_hashes(rows, 100, 5000, "k").collect()] == want
    assert smallest_hashes(rows, 6000, 5000, "k").count() == 5000
    assert [r.k for r in smallest_hashes(rows, 100, 5000, "k", unique=True).collect()] == want


def test_sample_of_repeated_keys(spark):
    """A few keys in most rows: every key that belongs to the sample is in it, once."""
    from pyspark.sql import functions as F

    from helixframe.llm.common import smallest_hashes

    rows = spark.range(30_000).select((F.col("id") % 2).alias("k")).union(spark.range(10, 40).withColumnRenamed("id", "k"))
    every = [r.k for r in rows.distinct().orderBy(F.xxhash64("k")).collect()]
    assert [r.k for r in smallest_hashes(rows, 10_000, rows.count(), "k").collect()] == every
    assert [r.k for r in smallest_hashes(rows, 7, rows.count(), "k").collect()] == every[:7]


def test_trees_from_two_repeated_urls(spark):
    """Both labels reach the trees, though two urls fill the table."""
    pages = spark.range(30_000).selectExpr("id AS page_id", "if(id % 2 = 0, 'http://x.net/es/1', 'http://x.com/en/') AS url")
    others = spark.createDataFrame([(-k, f"http://h{k}.net/{'es' if k % 2 else 'de'}/{k}") for k in range(1, 200)], "page_id long, url string")
    rows = url_filter.with_rule(url_filter.lexical(pages.union(others)), url_filter.RULES)
    from pyspark.sql import functions as F

    stats = url_filter.suffix_statistics(rows)
    total = stats.agg(F.sum("known")).first()[0]
    assert url_filter.train(url_filter.with_suffix(rows, stats), total).trees


# -- 5 ----------------------------------------------------------------------------------


def sets_of(rows):
    out = []
    for k, text in rows:
        w = tuple(re.findall(WORD, lower(text)))
        out.append((k, frozenset(w[i : i + 5] for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([w] if w else [])))
    return out


def plain_components(rows):
    sets = sets_of(rows)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for j, (b, t) in enumerate(sets[:i]):
            if s and t and a is not None and b is not None and 100 * len(s & t) >= 80 * len(s | t):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return Counter((a, len(s), min((sets[j][0] for j in groups[find(i)] if sets[j][0] is not None), default=None) if a is not None else None) for i, (a, s) in enumerate(sets))


def test_components(spark, edges):
    rnd = random.Random(9)
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    words = [f"w{k}" for k in range(400)]
    for g in range(12):
        base = [rnd.choice(words) for _ in range(rnd.choice([6, 30, 120]))]
        for m in range(14):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            if rnd.random() < 0.3:
                copy = copy[: max(5, len(copy) - rnd.randint(0, 12))]
            rows.append((1000 + 100 * g + m, " ".join(copy) + rnd.choice(["", "\n", " !"])))
    shared = " ".join(words[:60])
    rows += [(5000 + k, shared + " " + " ".join(rnd.choice(words) for _ in range(rnd.choice([5, 15, 60])))) for k in range(40)]
    rnd.shuffle(rows)
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == plain_components(rows)


def test_rows_that_share_a_doc_id(spark):
    """Unlike texts under one doc_id each keep their own links."""
    base = lambda c: " ".join(f"{c}{k}" for k in range(60))
    a, b = base("a"), base("b")
    for rows in (
        [(1, a), (1, b), (7, a + " x"), (8, b + " y")],
        [(5, a), (5, b), (3, a + " x"), (4, b + " y")],
        [(5, a), (5, a), (5, a.upper()), (5, b), (3, a + " x"), (3, b + " y"), (2, ""), (2, " ")],
    ):
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        found = jaccard_join.jaccard_components(frame).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == plain_components(rows)
        kept = jaccard_join.keep_one(frame).collect()
        groups = {r.component for r in found if r.component is not None}
        assert len(groups) == 2 and len(kept) == 2 + sum(not t.strip() for _, t in rows)


def test_sketch_is_added_up_by_shards(spark, small):
    frame = spark.createDataFrame(small, "doc_id long, text string").repartition(5)
    want = np.zeros(jaccard_join.CELLS, np.int64)
    for grams in jaccard_join.shingle_sets([t for _, t in small]):
        np.add.at(want, jaccard_join.cell_of(grams), 1)
    mean = want.mean()
    above = np.maximum(want - mean, 0) / (1.5 * np.sqrt(mean) + 2)
    got = jaccard_join._order_classes(jaccard_join._signatures(frame))
    assert (got == [1 + int(np.log2(x)) if x > 1 else 0 for x in above]).all() and got.any()


def test_small_sample_of_documents(spark, small):
    found = queries.QUERIES["op5_jaccard_join"](spark, SMALL).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == plain_components(small)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=25, unique=True), min_size=1, max_size=12), st.lists(st.integers(0, 30), min_size=1, max_size=25, unique=True))
def test_tree_probe(sets, query):
    classes = np.zeros(jaccard_join.CELLS, np.uint8)
    classes[:10] = 2
    arrays = [np.sort(np.array(s, np.uint64)) for s in sets]
    tree = jaccard_join.PrefixTree([jaccard_join.in_order(a, classes) for a in arrays], classes)
    q = set(query)
    want = {k for k, s in enumerate(sets) if 100 * len(q & set(s)) >= 80 * len(q | set(s))}
    assert set(tree.probe(np.sort(np.array(query, np.uint64)))) == want


def test_shingles_are_hashed_apart():
    texts = ["a b c d e f", "b c d e f", "a b", "b a", "a", "", None, "A B C D E F", "a b c d"]
    grams = jaccard_join.shingle_sets(texts)
    assert [len(g) for g in grams] == [2, 1, 1, 1, 1, 0, 0, 2, 1]
    assert (grams[0] == grams[7]).all() and grams[1][0] in grams[0] and len({g[0] for g in grams[2:5]} | {grams[8][0]}) == 4


def test_parity_never_drops_a_link(spark):
    rnd = np.random.default_rng(3)
    rows = []
    for k in range(60):
        n = int(rnd.integers(1, 400))
        a = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: max(1, int(len(a) * 0.92))], rnd.integers(0, 2**63, max(1, n // 15)).astype(np.uint64)]))
        rows += [(2 * k, len(a), jaccard_join.parity(a).tolist(), a), (2 * k + 1, len(b), jaccard_join.parity(b).tolist(), b)]
    frame = spark.createDataFrame([r[:3] for r in rows], "rep long, n long, parity array<long>")
    pairs = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(60)], "a long, b long")
    kept = {r.a for r in jaccard_join._may_link(pairs, frame).collect()}
    for k in range(60):
        a, b = set(rows[2 * k][3].tolist()), set(rows[2 * k + 1][3].tolist())
        if 100 * len(a & b) >= 80 * len(a | b):
            assert 2 * k in kept


def test_chain_of_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 101), (102, 101)], "a long, b long")
    from helixframe.llm.common import workspace

    rows = jaccard_join.components(links, workspace(spark, "test"), "c").collect()
    assert {r.node: r.label for r in rows} == {k: 0 for k in range(31)} | {100: 100, 101: 100, 102: 100}


# -- 6 ----------------------------------------------------------------------------------


def test_licences(spark, edges, small):
    more = [
        (201, "Released under the MIT License."),
        (202, "x Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0!"),
        (203, "GNU General Public License alone"),
        (204, "mit licence, license mit"),
        (205, "mit license " * 300),
        (206, "Licensed under something else CC BY NC"),
        (207, "é mit license é"),
    ]
    frame = edges.select("doc_id", "text").union(spark.createDataFrame(more + small, "doc_id long, text string"))
    rows = license_scan.license_scan(frame).collect()
    texts = Counter()
    for r in frame.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r.text))
        at = [(i, label) for p, label in license_scan.BASE for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
        texts[r.doc_id, len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == texts
    found = {r.doc_id: r for r in rows}
    assert found[201].labels == "mit" and found[201].score == 1.0
    assert found[202].labels == "apache,cc-by-nc"
    assert found[203].base_labels == "gpl" and found[204].labels == "" and found[205].n_base == 300
    assert found[206].labels == ""
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)


def plain_licences(text):
    """Every place of every template, word by word."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    at = [(i, label) for p, label in license_scan.BASE for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
    labels, score = {x for _, x in at}, 0.0
    for label, template, key in license_scan.TEMPLATES.values():
        t, k = template.split(), key.split()
        start = license_scan.key_start(template, key)
        for i in range(len(w)):
            if w[i : i + len(k)] == k:
                share = sum(0 <= i - start + j < len(w) and w[i - start + j] == x for j, x in enumerate(t)) / len(t)
                if share >= license_scan.LEAST_SHARE:
                    labels.add(label)
                    score = max(score, share)
    return ",".join(sorted(labels)), score


def test_labels_and_scores_by_brute_force(spark, small):
    rnd = random.Random(11)
    texts = [t for _, t in small]
    for label, template, key in license_scan.TEMPLATES.values():
        words = template.split()
        texts += [template, template.title() + ".", "x y " + template + " " + template]
        for _ in range(6):
            some = list(words)
            for _ in range(rnd.randint(1, len(some))):
                some[rnd.randrange(len(some))] = rnd.choice(["word", "license", *words])
            texts.append(" ".join(some))
        texts.append(" ".join(words[license_scan.key_start(template, key) :]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.labels, r.score) for r in license_scan.license_scan(docs).collect()}
    want = {k: plain_licences(t) for k, t in enumerate(texts)}
    assert {k: (x, round(y, 9)) for k, (x, y) in found.items()} == {k: (x, round(y, 9)) for k, (x, y) in want.items()}
    assert sum(0 < y < 1 for _, y in want.values()) > 10


def test_many_places_in_one_text(spark):
    """Work grows with the words of a text, not with their square."""
    docs = spark.createDataFrame([(1, "released under the mit license " * 60_000)], "doc_id long, text string")
    began = time.time()
    row = license_scan.license_scan(docs).first()
    assert (row.n_base, row.labels, row.score) == (60_000, "mit", 1.0) and time.time() - began < 60


def test_rare_words_make_the_index():
    words = {w for _, _, key in license_scan.TEMPLATES.values() for w in key.split()}
    frequency = {w: (0 if w == "apache" else 5 if w == "version" else 1000) for w in words}
    index = license_scan.build_index(frequency, license_scan.TEMPLATES)
    assert index[0] == [("apache", 3), ("version", 5)]


# -- 7 ----------------------------------------------------------------------------------


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(capped.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return capped | {s: level * weight[s] for s in free}
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_mixing(spark, edges):
    rnd = random.Random(8)
    rows = [(k, "w " * rnd.choice([0, 1, 5, 40, 400]), "en", rnd.choice(["a", "b", "b", "b", "c", "é", "Z", None, ""]), 0) for k in range(1000, 1400)]
    frame = edges.union(spark.createDataFrame(rows, DOCS))
    found = mixing.mix(frame).collect()
    assert len(found) == frame.count()
    sizes, taken, targets = Counter(), Counter(), {}
    for r in found:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        targets[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    want = plain_targets(dict(sizes))
    for s in sizes:
        assert targets[s] == pytest.approx(want[s]) and abs(taken[s] - targets[s]) <= 1
    assert Counter(map(tuple, found)) == Counter(map(tuple, mixing.mix(frame.repartition(7)).collect()))
    words = {r.doc_id: len(re.findall(WORD, r.text or "")) for r in frame.collect() if r.doc_id is not None}
    assert all(r.size == words[r.doc_id] for r in found if r.doc_id is not None)


def plain_taken(rows, quality):
    """Every source put in order as a whole; rows: doc_id, source, text."""
    sizes, out = Counter(), Counter()
    count = lambda t: len(re.findall(WORD, t or ""))
    for _, s, t in rows:
        sizes[s] += count(t)

    def key(k, t):
        u = (int(hashlib.md5(f"{mixing.SEED}:{'null' if k is None else k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -math.log(u) / quality(t), k is not None, k or 0, count(t)

    for s, target in plain_targets(dict(sizes)).items():
        goal = math.floor(target + 0.5)
        epochs, rest = divmod(goal, sizes[s]) if sizes[s] else (0, 0)
        for k, t in sorted(((k, t) for k, x, t in rows if x == s), key=lambda r: key(*r)):
            part = min(rest, count(t))
            out[k, s, count(t), epochs * count(t) + part] += 1
            rest -= part
    return out


@pytest.mark.parametrize("edge", [100_000, 3, 0])
def test_taken_against_whole_sorts(spark, monkeypatch, edge):
    """Hot cells are cut level by level; keys of one quality, low and high, and repeated rows at a border."""
    monkeypatch.setattr(mixing, "EDGE_ROWS", edge)
    rnd = random.Random(edge)
    rows = [(k, rnd.choice(["a", "b", "b", "b", "c", None]), ("# " if k % 3 else "w ") * rnd.choice([0, 1, 5, 40])) for k in range(600)]
    rows += [(7000, "d", "x y z")] * 40 + [(None, "d", "x y")] * 5 + [(7001, "e", "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    share = lambda t: max(0.05, 1 - 4 * len(re.findall("[#*$%&|<>]", t or "")) / max(len(t or ""), 1))
    got = Counter((r.doc_id, r.source, r.size, r.taken) for r in mixing.mix(docs).collect())
    assert got == plain_taken(rows, share)


def test_heavy_documents_come_first(spark):
    rows = [(k, ("#" if k % 2 else "w") + " w" * 9, "en", "ab"[k % 3 == 0], 0) for k in range(3000)]
    frame = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    found = mixing.mix(frame, quality=lambda t: F.when(t.startswith("#"), 0.2).otherwise(1.0)).collect()
    extra = {True: [], False: []}
    for r in found:
        extra[r.doc_id % 2 == 1].append(r.taken > r.size * (r.target // r.source_size))
    assert np.mean(extra[True]) < np.mean(extra[False])
    copies = Counter(r.doc_id for r in mixing.mixture(frame).collect())
    assert max(copies.values()) <= 3 and set(mixing.mixture(frame).columns) == set(frame.columns)


# -- 8 ----------------------------------------------------------------------------------


def test_classifier_on_unseen_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    part = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    rows = {r.doc_id: r for r in quality_classifier.quality_classifier(docs, labels.filter(~part)).collect()}
    hidden = labels.filter(part).collect()
    assert np.mean([(rows[r.doc_id].score > 0.5) == (r.quality == 1) for r in hidden]) > 0.95
    assert np.mean([rows[r.doc_id].kept for r in hidden if r.quality == 1]) > 0.97
    again = {r.doc_id: r.score for r in quality_classifier.quality_classifier(docs.repartition(5), labels.filter(~part)).collect()}
    assert all(abs(again[k] - rows[k].score) < 1e-6 for k in rows)


def test_views_teach_each_other():
    rnd = np.random.default_rng(1)
    make = lambda y: (np.stack([y + rnd.normal(0, 0.4, len(y)), rnd.normal(0, 1, len(y))], 1).astype(np.float32), np.stack([1 - y + rnd.normal(0, 0.4, len(y))], 1).astype(np.float32))
    y = (rnd.random(200) > 0.5).astype(float)
    unseen = np.arange(200) % 4 == 0
    hidden = (rnd.random(2000) > 0.5).astype(float)
    pool = make(hidden)
    m = quality_classifier.co_train(make(y), y, unseen, pool)
    assert ((m.score(*pool) > 0.5) == (hidden > 0.5)).mean() > 0.9
    assert quality_classifier.co_train(make(y * 0), y * 0, unseen, pool) is None


# -- 9 ----------------------------------------------------------------------------------


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = language_id.predict(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]) > 0.97
    assert Counter(map(tuple, rows)) == Counter(map(tuple, language_id.predict(docs.repartition(6)).collect()))


def test_language_edges(spark, edges):
    for r in language_id.predict(edges).collect():
        text = next((t for k, t, *_ in edge_rows() if k == r.doc_id), None) if r.doc_id is not None else "?"
        if text != "?":
            assert (r.lang_pred == "und") == (not any(map(str.isalpha, text or "")))
    none = language_id.predict(edges.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_bundles_add_up():
    texts = ["abc def", "ÄÖ x", "", "漢字 かな"]
    one = language_id.bundles(texts, [0, 1, 2, 3], 4)
    assert (language_id.bundles(texts, [0, 0, 0, 0], 1)[0] == one.sum(axis=0)).all()
    assert (language_id.bundles(["ABC  def!"], [0], 1) == one[0]).all()
    vectors = 1 - 2 * language_id.letter_vectors(np.arange(97, 123)).astype(int)
    by_hand = sum(np.roll(v[0], 2) * np.roll(v[1], 1) * v[2] for v in ([vec(vectors, c) for c in g] for g in (" ab", "abc", "bc ")))
    assert (language_id.bundles(["abc"], [0], 1)[0] == by_hand).all()


def plain_trigrams(text):
    chars, out = " ", Counter()
    for c in text.lower().replace("ς", "σ") + " ":
        c = c if c.isalpha() else " "
        if c != " " or chars[-1] != " ":
            chars += c
    out.update(chars[k : k + 3] for k in range(len(chars) - 2))
    return out


def plain_vector(text):
    total = np.zeros(language_id.DIMS)
    for gram, n in plain_trigrams(text).items():
        v = 1 - 2 * language_id.letter_vectors(np.array([ord(c) for c in gram])).astype(int)
        total += n * np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
    return total


def test_pieces_add_up(monkeypatch):
    """A text in pieces, at any seam, gives what it gives as a whole; so do tables in parts."""
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("ab cdé漢字  .\n1ΣσİA") for _ in range(n)) for n in (1, 2, 3, 40, 200, 400)] + ["", "  ", "ab", "ΑΣ ΑΣΑ", "a" * 50, " ." * 30 + "x"]
    want = [plain_vector(t) for t in texts]
    for piece, kinds, cells in ((1 << 20, 1 << 13, 1 << 22), (7, 1 << 13, 1 << 22), (1, 5, 20), (3, 16, 64), (64, 3, 8)):
        for name, value in (("PIECE", piece), ("KINDS", kinds), ("CELLS", cells)):
            monkeypatch.setattr(language_id, name, value)
        got = language_id.bundles(texts, list(range(len(texts))), len(texts))
        assert (got == np.array(want)).all()
        assert (language_id.bundles(texts, [0] * len(texts), 1)[0] == sum(want)).all()


def test_many_letters_fit_in_memory():
    """600,000 random characters of many: the vectors of their trigrams never stand side by side."""
    import tracemalloc

    rnd = np.random.default_rng(2)
    text = "".join(map(chr, rnd.integers(0x4E00, 0x9FA5, 600_000).tolist()))
    language_id.letters()
    tracemalloc.start()
    found = language_id.bundles([text, text[:1000]], [0, 1], 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 << 20 and (found[1] == plain_vector(text[:1000])).all()


def test_predictions_by_brute_force(spark, small):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    total = defaultdict(lambda: np.zeros(language_id.DIMS))
    vectors = {r.doc_id: plain_vector(r.text) for r in rows}
    for r in rows:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            total[r.lang] += vectors[r.doc_id]
    for r in language_id.predict(docs).collect():
        v = vectors[r.doc_id]
        cosine = {k: v @ p / np.linalg.norm(p) / max(np.linalg.norm(v), 1e-9) for k, p in total.items()}
        best = max(sorted(cosine), key=cosine.get)
        assert r.lang_pred == (best if v.any() else "und") and r.score == pytest.approx(max(cosine[best], 0) if v.any() else 0, abs=1e-9)


def vec(table, c):
    return table[ord(c) - 97] if c != " " else 1 - 2 * language_id.letter_vectors(np.array([32]))[0].astype(int)


def test_bundles_need_little_memory():
    """Workers share an executor: the count tables of many short texts with many trigrams stay small."""
    import tracemalloc

    rnd = random.Random(8)
    texts = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(900)) for _ in range(1000)]
    language_id.bundles(texts[:2], [0, 1], 2)
    tracemalloc.start()
    language_id.bundles(texts, list(range(1000)), 1000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 110e6


# -- 10 ---------------------------------------------------------------------------------


def plain_dedup(rows):
    groups = defaultdict(list)
    for k, t in rows:
        groups[re.sub(BLANK, "", t or "")].append((-len(t or ""), k is None, k))
    out, seen = Counter(), Counter()
    for k, t in rows:
        norm = re.sub(BLANK, "", t or "")
        first = min(groups[norm])
        mine = (-len(t or ""), k is None, k)
        stays = mine == first and not seen[norm, mine]
        seen[norm, mine] += mine == first
        out[k, first[2], len(groups[norm]), stays, hashlib.sha256(norm.encode()).hexdigest()] += 1
    return out


def test_dedup(spark, edges):
    rows = [(r.doc_id, r.text) for r in edges.collect()] + [(300, "x y"), (301, "xy"), (302, " x\ny "), (299, "x  y"), (303, "X y")]
    found = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter(map(tuple, found)) == plain_dedup(rows)


def test_equal_digests_are_verified(spark, edges):
    from pyspark.sql import functions as F

    rows = [(r.doc_id, r.text) for r in edges.collect()] + [(k, t) for k, t in enumerate(["p", "q", "q ", "r", "p", "s"], 400)]
    weak = lambda norm: F.unhex(F.substring(F.sha2(norm, 256), 1, 2))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, exact_dedup.exact_dedup(frame, digest=weak).collect())) == plain_dedup(rows)


def test_kept_rows(spark, edges):
    kept = exact_dedup.keep_first(edges)
    want = Counter(k for (k, _, _, stays, _), n in plain_dedup([(r.doc_id, r.text) for r in edges.collect()]).items() for _ in range(n) if stays)
    assert Counter(r.doc_id for r in kept.collect()) == want and kept.columns == edges.columns
