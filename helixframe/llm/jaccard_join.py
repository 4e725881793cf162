"""N-gram Jaccard self-join by prefix trees, and the components of its links.

Documents are sets of hashed word 5-grams. Two link if their Jaccard similarity is
0.8 or more; the result is each document's component.

1. Documents with the same set form a class (by a 128-bit digest of the set). A class has a
   number of its own, `rep`; the text of its document with the smallest doc_id goes on.
2. Global order of n-grams: by how often their cell of a count sketch over *all*
   documents was met, then by hash: rare ones first. The sketch has a fixed size; tasks'
   counts are added in SHARDS ranges of cells.
3. Linked sets share an n-gram among the first n - ceil(0.8 n) + 1 of either. These
   (n-gram, document) rows meet in a shuffle; n-grams of one document go.
4. Stars: each shared n-gram proposes its smallest document with each other one, not
   all pairs, where lengths and positions allow 0.8. A block holds one probe and the sets proposed to it, in global
   order, as a prefix tree: sets that start alike share the overlap counted on the
   common path, and a subtree is left when its remaining length can't reach the
   overlap that is needed.
   Before texts move, parity bitmaps of the sets, 2 to 4 bits an n-gram, bound each
   pair's overlap from above: bits that differ are at most the n-grams that differ.
5. Links give components. What is left are pairs of different components that share a
   prefix n-gram: all those whose lengths and positions allow 0.8 are proposed and
   joined in the same way. No pair that can link is left out, and members of
   one component are never paired again.

Texts reach the blocks through shuffles; broadcasts are the order's cells, of fixed size, and a
bitmap of ids, of bounded size. Stars of a hot document are cut into blocks of
BLOCK sets.

Defined cases: a null or blank text has the empty set and links with nothing. With
1 to 4 words the whole sequence is the one n-gram. Rows with a null doc_id are
returned with a null component and link with nothing. Repeated rows are in the same class.
Rows that share a doc_id and differ in text each follow their own text, as classes have
numbers apart from doc_ids. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import bitmap, bound_batches, discard, in_bitmap, settle, slots_for, tidy, workspace

WORDS = 5
#: Cells of the count sketch that orders n-grams, a power of two.
CELLS = 1 << 22
#: Ranges of cells in which the sketch is added up.
SHARDS = 64
#: Sets in a block, beside the probe.
BLOCK = 256
#: Tokens of a tree path that are compared before the bound is looked at again.
STEP = 128
WORD_TABLE = 300_000
#: Texts that are hashed together.
TEXTS = 256

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Hashes(dict):
    """Hash of a word, remembered; forgotten together when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_TABLE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _Hashes()


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the distinct hashed 5-grams of its lower-cased (A-Z) words, in order of hash."""
    words = [(t or "").encode().lower().split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    h = np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(words)), np.uint64, int(sizes.sum()))
    windows = max(len(h) - WORDS + 1, 0)
    x = np.zeros(windows, np.uint64)
    for k in range(WORDS):
        _stir(x, h[k : k + windows], k)
    _finish(x)
    out = []
    for start, n in zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True):
        if n >= WORDS:
            own = np.sort(x[start : start + n - WORDS + 1])
            fresh = own[1:] != own[:-1]
            out.append(own if fresh.all() else own[np.concatenate(([True], fresh))])
        else:
            whole = np.full(min(n, 1), n, np.uint64)
            for k in range(n):
                _stir(whole, h[start + k : start + k + 1], k)
            _finish(whole)
            out.append(whole)
    return out


def _stir(x: np.ndarray, h: np.ndarray, k: int) -> None:
    x += h * _ODD[k]
    x ^= x >> np.uint64(29)


def _finish(x: np.ndarray) -> None:
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)


def digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def cell_of(grams: np.ndarray) -> np.ndarray:
    return (grams & np.uint64(CELLS - 1)).astype(np.int64)


def in_order(grams: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Rare cells first, then by hash."""
    rank = classes[cell_of(grams)]
    return grams[np.argsort(rank, kind="stable")] if rank.any() else grams


def least_shared(n: int) -> int:
    """Overlap that a set of n needs with any set: ceil(0.8 n)."""
    return (4 * n + 4) // 5


def needed(a: int, b: int) -> int:
    """Overlap that sets of a and b need: ceil(0.8 / 1.8 (a + b))."""
    return -(-4 * (a + b) // 9)


def _signatures(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: a document's n and digest (shard -1), and a task's cell counts, a row for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.uint32)
        names = ["shard", "doc_id", "n", "digest", "text_md5"]
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                texts = part["text"].to_pylist()
                sets = shingle_sets(texts)
                np.add.at(cells, cell_of(np.concatenate(sets)), 1)
                md5 = [hashlib.md5((t or "").encode()).hexdigest() for t in texts]
                sizes = pa.array(list(map(len, sets)), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([-1] * len(sets), pa.int32()), part["doc_id"], sizes, pa.array(list(map(digest, sets)), pa.binary()), pa.array(md5, pa.string())], names=names)
        _HASHES.clear()
        parts = cells.reshape(SHARDS, -1)
        packed = pa.array([zlib.compress(x, 1) for x in parts], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(range(SHARDS), pa.int32()), pa.array([None] * SHARDS, pa.int64()), pa.array(parts.sum(axis=1, dtype=np.int64)), packed, pa.array([None] * SHARDS, pa.string())], names=names)

    return docs.mapInArrow(tidy(run), "shard int, doc_id long, n long, digest binary, text_md5 string")


def _order_classes(signatures: DataFrame) -> np.ndarray:
    """The order's class of each cell: 0 for a usual count, then one more for each doubling of what is above it.

    Any such table gives a right order; a good one puts n-grams of many documents last. A
    shard's counts meet in one task, a batch at a time; only its classes reach the driver, CELLS bytes in all.
    """
    sketches = signatures.filter("shard >= 0")
    mean = float(sketches.agg(F.sum("n").alias("n")).first()["n"] or 0) / CELLS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, packed in zip(batch["shard"].to_pylist(), batch["digest"], strict=True):
                counts = total.setdefault(shard, np.zeros(CELLS // SHARDS, np.int64))
                counts += np.frombuffer(zlib.decompress(packed.as_py()), np.uint32)
        for shard, counts in total.items():
            above = np.maximum(counts - mean, 0) / (1.5 * np.sqrt(mean) + 2)
            classes = np.where(above > 1, 1 + np.floor(np.log2(np.maximum(above, 1))), 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([zlib.compress(classes, 1)], pa.binary())], names=["shard", "classes"])

    out = np.zeros((SHARDS, CELLS // SHARDS), np.uint8)
    for r in sketches.select("shard", "digest").repartition(SHARDS, "shard").mapInArrow(tidy(add), "shard int, classes binary").collect():
        out[r["shard"]] = np.frombuffer(zlib.decompress(r["classes"]), np.uint8)
    return out.ravel()


def _classes(members: DataFrame, folder: str) -> DataFrame:
    """digest, rep, n, doc_id, text_md5: a row for each set that isn't empty, with its number and its first document.

    Numbers grow with doc_id: first documents, which later ones are often copies of, are the centres of stars. They are
    given as the table is written, so they are fixed once it is there.
    """
    first = F.min(F.struct("doc_id", "text_md5"))
    sets = members.filter("doc_id is not null and n > 0").groupBy("digest").agg(first.alias("d"), F.first("n").alias("n"))
    ordered = sets.select("digest", "n", "d.doc_id", "d.text_md5").orderBy("doc_id", "digest")
    return settle(ordered.withColumn("rep", F.monotonically_increasing_id()), folder, "classes")


def _once(rows: DataFrame, *keys: str) -> DataFrame:
    """One of the rows with these keys; equal ones go before the shuffle, however many they are."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(keys[0]))
    return rows.withColumn("_turn", turn).filter("_turn = 1").drop("_turn")


def _prefixes(docs: DataFrame, classes: np.ndarray) -> DataFrame:
    """doc_id, n, digest and the prefix of every set that isn't empty."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                known = [(k, g) for k, g in zip(part["doc_id"].to_pylist(), shingle_sets(part["text"].to_pylist()), strict=True) if len(g)]
                sets = [g for _, g in known]
                prefixes = [in_order(g, shared.value)[: len(g) - least_shared(len(g)) + 1] for g in sets]
                columns = [
                    pa.array([k for k, _ in known], pa.int64()),
                    pa.array(list(map(len, sets)), pa.int64()),
                    pa.array(list(map(digest, sets)), pa.binary()),
                    _lists([p.view(np.int64) for p in prefixes]),
                    _lists(list(map(parity, sets))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "digest", "prefix", "parity"])
        _HASHES.clear()

    return docs.filter("doc_id is not null").mapInArrow(tidy(run), "doc_id long, n long, digest binary, prefix array<long>, parity array<long>")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64)))


def parity(grams: np.ndarray) -> np.ndarray:
    """Whether an odd number of n-grams falls on each of 2 to 4 n bits, as 64-bit words."""
    size = max(64, 2 << (len(grams) - 1).bit_length())
    odd = np.bincount(((grams >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _may_link(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that the parities of their sets (rep, n, parity) allow; sizes differ by one doubling at most."""
    of = lambda c: sets.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"p{c}"))
    rows = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b")
    words = F.least(F.size("pa"), F.size("pb"))
    fold = lambda p, i: F.get(p, i).bitwiseXOR(F.when(F.size(p) > words, F.get(p, i + words)).otherwise(F.lit(0).cast("long")))
    unlike = F.aggregate(F.transform(F.sequence(F.lit(0), words - 1), lambda i: F.bit_count(fold("pa", i).bitwiseXOR(fold("pb", i)))), F.lit(0), lambda s, x: s + x)
    return rows.filter((5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")) & (9 * unlike <= F.col("na") + F.col("nb"))).select("a", "b")


class PrefixTree:
    """Sets in global order, sorted: neighbours share the path up to their common prefix."""

    def __init__(self, sets: list[np.ndarray], classes: np.ndarray):
        self.order = sorted(range(len(sets)), key=lambda k: self.path(sets[k], classes)) if len(sets) > 1 else [0]
        self.sets = [sets[k] for k in self.order]
        self.common = [0]
        for a, b in zip(self.sets, self.sets[1:], strict=False):
            n = min(len(a), len(b))
            unlike = np.flatnonzero(a[:n] != b[:n])
            self.common.append(int(unlike[0]) if len(unlike) else n)

    @staticmethod
    def path(tokens: np.ndarray, classes: np.ndarray) -> bytes:
        """Bytes that sort as the tokens do in global order."""
        steps = np.empty(len(tokens), np.dtype([("class", "u1"), ("hash", ">u8")]))
        steps["class"], steps["hash"] = classes[cell_of(tokens)], tokens
        return steps.tobytes()

    def probe(self, query: np.ndarray) -> list[int]:
        """Numbers of the sets that link with the query, a set in order of hash."""
        found, size = [], len(query)
        path = np.zeros(1, np.int64)  # path[d]: overlap of the first d tokens of the set before
        dead, dead_length = -1, 0  # depth at which a subtree was left, for sets up to a length
        for k, tokens in enumerate(self.sets):
            n, start = len(tokens), min(self.common[k], len(path) - 1)
            need = needed(n, size)
            if 0 <= dead <= self.common[k] and n <= dead_length:
                continue  # in the subtree that was left
            dead = -1
            path = path[: start + 1]
            while start < n and path[-1] + min(n - start, size - path[-1]) >= need:
                part = tokens[start : start + STEP]
                at = np.minimum(np.searchsorted(query, part), size - 1)
                path = np.concatenate([path, path[-1] + np.cumsum(query[at] == part)])
                start += len(part)
            if start >= n and path[-1] >= need:
                found.append(self.order[k])
            elif start < n and n - start <= size - path[-1]:
                dead, dead_length = start, n  # too short from here on; shorter ones are so too
        return found


def _join_blocks(rows: DataFrame, classes: np.ndarray) -> DataFrame:
    """Links (a, b) of blocks: rows a, chunk, b, text sorted so that the probe (b null) comes first."""
    shared = rows.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        at, query, ids, sets = None, None, [], []

        def links() -> list[tuple[int, int]]:
            if query is None or not sets:
                return []
            return [(at[0], ids[k]) for k in PrefixTree(sets, rank).probe(query)]

        for batch in batches:
            out: list[tuple[int, int]] = []
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                columns = (part[c].to_pylist() for c in ("a", "chunk", "b"))
                for a, chunk, b, grams in zip(*columns, shingle_sets(part["text"].to_pylist()), strict=True):
                    if (a, chunk) != at:
                        out += links()
                        at, query, ids, sets = (a, chunk), None, [], []
                    if b is None:
                        query = grams
                    else:
                        ids.append(b)
                        sets.append(in_order(grams, rank))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])
        _HASHES.clear()
        out = links()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(tidy(run), "a long, b long")


def _texts_of(docs: DataFrame, reps: DataFrame, pairs: DataFrame, folder: str, name: str) -> DataFrame:
    """rep, text of all classes in pairs: a bitmap of their documents' ids filters the scan."""
    used = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    wanted = settle(reps.join(used, "rep", "left_semi").select("rep", "doc_id", "text_md5"), folder, f"{name}-wanted")
    slots = slots_for(wanted.count())
    ids = settle(bitmap(wanted.select(F.xxhash64("doc_id").alias("h")), slots), folder, f"{name}-ids")
    met = in_bitmap(docs, F.xxhash64("doc_id"), ids, slots).withColumn("text_md5", F.md5(F.coalesce("text", F.lit(""))))
    return settle(_once(met, "doc_id", "text_md5").join(wanted, ["doc_id", "text_md5"]).select("rep", "text"), folder, f"{name}-texts")


def verify(docs: DataFrame, reps: DataFrame, pairs: DataFrame, sets: DataFrame, classes: np.ndarray, folder: str, name: str) -> DataFrame:
    """Links among the proposed pairs (a, b)."""
    pairs = settle(_may_link(pairs, sets), folder, f"{name}-likely")
    texts = _texts_of(docs, reps, pairs, folder, name)
    degree = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("chunks"))
    cut = pairs.join(degree, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"), "b")
    probes = degree.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    members = cut.join(texts, F.col("b") == F.col("rep")).select("a", "chunk", "b", "text")
    heads = probes.join(texts, F.col("a") == F.col("rep")).select("a", "chunk", F.lit(None).cast("long").alias("b"), "text")
    blocks = members.unionByName(heads).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    return _join_blocks(blocks, classes)


def components(links: DataFrame, folder: str, name: str) -> DataFrame:
    """node, label: the smallest node of each component of the links (a, b).

    Smallest labels pass along links and labels jump to their own label, until a
    round changes nothing. Every round is a table in the shared folder.
    """
    both = settle(links.select("a", "b").union(links.select("b", "a")).distinct(), folder, f"{name}-links")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), folder, f"{name}-0")
    turn = 0
    while True:
        turn += 1
        said = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("_n")).agg(F.min("label").alias("_l"))
        heard = labels.join(said, F.col("node") == F.col("_n")).select("node", "label", F.least("label", "_l").alias("_new"))
        jump = labels.select(F.col("node").alias("_m"), F.col("label").alias("_j"))
        moved = heard.join(jump, F.col("_new") == F.col("_m"), "left").select("node", F.least("_new", F.coalesce("_j", "_new")).alias("label"), (F.least("_new", F.coalesce("_j", "_new")) < F.col("label")).alias("changed"))
        table = settle(moved, folder, f"{name}-{turn}")
        labels = table.select("node", "label")
        if table.filter("changed").limit(1).count() == 0:
            return labels


def _allowed(na: Column, pa_: Column, nb: Column, pb: Column) -> Column:
    """Whether sets of these sizes, whose first common token stands at these positions, can link."""
    return 9 * (1 + F.least(na - pa_ - 1, nb - pb - 1)) >= 4 * (na + nb)


def jaccard_components(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_id, text_md5 and component, its number (null: linked with nothing)."""
    spark = docs.sparkSession
    bound_batches(spark)
    keep = folder or workspace(spark, "jaccard")
    folder = f"{keep}/work"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = settle(_signatures(docs), keep, "signatures")
    classes = _order_classes(signed)
    members = signed.filter("shard < 0").select("doc_id", "n", "digest", "text_md5")
    reps = _classes(members, folder)

    prefixes = _once(_prefixes(docs, classes), "doc_id", "digest").join(reps.select("rep", "doc_id", "digest"), ["doc_id", "digest"])
    prefixes = settle(prefixes.select("rep", "n", "prefix", "parity"), folder, "prefixes")
    tokens = prefixes.select("rep", "n", F.posexplode("prefix").alias("pos", "token"))
    met = prefixes.select("rep", F.explode("prefix").alias("token")).groupBy("token").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).filter("hub < last").select("token", "hub")
    shared = settle(tokens.join(met, "token"), folder, "shared")

    hubs = shared.filter("rep = hub").select("token", F.col("n").alias("na"), F.col("pos").alias("pa"))
    stars = shared.filter("rep <> hub").join(hubs, "token").filter(_allowed(F.col("na"), F.col("pa"), F.col("n"), F.col("pos")))
    stars = settle(stars.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), folder, "stars")
    links = settle(verify(docs, reps, stars, prefixes, classes, folder, "stars"), folder, "links-0")
    label = components(links, folder, "first")

    known = shared.join(label, F.col("rep") == F.col("node"), "left").select("token", "rep", "n", "pos", F.coalesce("label", "rep").alias("comp"))
    known = settle(known, folder, "known")
    mixed = known.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("token")
    rest = settle(known.join(mixed, "token", "left_semi"), folder, "rest")
    a, b = rest.alias("a"), rest.alias("b")
    allowed = _allowed(F.col("a.n"), F.col("a.pos"), F.col("b.n"), F.col("b.pos"))
    across = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.comp") < F.col("b.comp")) & allowed)
    pairs = across.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"), F.col("a.comp").alias("ca"), F.col("b.comp").alias("cb")).distinct()
    pairs = settle(pairs, folder, "pairs")
    more = verify(docs, reps, pairs, prefixes, classes, folder, "pairs")
    more = settle(more.join(pairs, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), folder, "links-1")
    if more.limit(1).count():
        joined = components(more, folder, "second").withColumnRenamed("node", "_c").withColumnRenamed("label", "_l")
        of_rep = reps.select("rep").join(label, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("label", "rep").alias("comp"))
        label = settle(of_rep.join(joined, F.col("comp") == F.col("_c"), "left").select(F.col("rep").alias("node"), F.coalesce("_l", "comp").alias("label")), folder, "labels")
    final = reps.join(label, F.col("rep") == F.col("node"), "left").select("digest", "doc_id", "rep", F.coalesce("label", "rep").alias("label"))
    final = settle(final, folder, "final")
    least = settle(final.groupBy("label").agg(F.min("doc_id").alias("least")), folder, "least")
    final = settle(final.join(least, "label").select("digest", "rep", "label", "least", F.col("doc_id").alias("class_doc")), keep, "final")
    discard(spark, folder)
    linked = members.join(final, "digest", "left")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    return linked.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_doc")).alias("class_id"),
        "text_md5",
        F.when(~alone, F.col("label")).alias("component"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, one of each component: that with its smallest doc_id, then the smallest digest of its text.

    What links with nothing stays, once for rows of equal doc_id and text.
    """
    key = lambda md5: F.concat_ws("|", md5, F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    found = jaccard_components(docs)
    own = F.when(F.col("component").isNull(), key(F.col("text_md5")))
    heads = found.groupBy("component", own.alias("_own")).agg(F.min(F.struct("doc_id", "text_md5")).alias("d")).select("d.*")
    rows = docs.withColumn("_key", key(F.md5(F.coalesce("text", F.lit("")))))
    kept = rows.join(heads.select(key(F.col("text_md5")).alias("_key")), "_key", "left_semi")
    once = Window.partitionBy("_key").orderBy("doc_id")
    return kept.withColumn("_turn", F.row_number().over(once)).filter("_turn = 1").select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT r, w, unnest(CASE WHEN len(w) >= 5 THEN range(1, len(w) - 3) WHEN len(w) > 0 THEN [1::BIGINT] ELSE []::BIGINT[] END) AS i FROM d)),
n AS (SELECT r, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS h FROM g GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r),
links AS (SELECT a, b FROM common JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT r, r AS m FROM d UNION SELECT reach.r, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.m),
least AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.m GROUP BY reach.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least.component_id, CASE WHEN n.h IS NULL THEN d.doc_id ELSE min(d.doc_id) OVER (PARTITION BY n.h) END AS class_id
FROM d JOIN least ON least.r = d.r LEFT JOIN n ON n.r = d.r
"""
