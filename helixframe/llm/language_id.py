"""Language identification by hyperdimensional letter profiles.

Every letter has a random vector of DIMS signs, drawn from a hash of its code point.
A trigram's vector binds its letters' vectors, each rotated by its place; a text's
vector bundles (adds) those of its trigrams. A language's prototype bundles all
trigrams of its training texts. The prediction is the prototype with the largest
cosine, ties going to the smaller language name; the score is that cosine, 0 at least.

Letters are lower-cased (a final sigma as any other); runs of anything else count as one blank. Vectors of whole
numbers are added exactly, so that results do not depend on the order of tasks.

Trained on documents with a language whose crc32(doc_id as text) mod 4 is not 2. The
prototypes, DIMS numbers for each language, are all that reaches the driver.

Defined cases: a null text, or one without letters, is `und` with score 0; so is every
text if there is nothing to learn from. A null doc_id counts as held out. Repeated rows
come back as often as they came; empty tables give empty results; further columns pass
through identify() and are ignored by predict(). Long texts are read in pieces, which give
what the whole text gives; memory does not grow with the number of different trigrams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import bound_batches, tidy

DIMS = 512
SEED = 0x5EED_1A16
#: Characters that are worked on at once, cells of a count table (of 12 bytes), and trigrams that have vectors at the same time.
PIECE, CELLS, KINDS = 1 << 20, 1 << 20, 1 << 13
UNKNOWN = "und"


def _letter_table() -> np.ndarray:
    """True for each code point that is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(_letter_table())
    return _LETTERS[0]


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """A row of DIMS bits for each code point, from a counter-based hash."""
    with np.errstate(over="ignore"):
        x = (points.astype(np.uint64)[:, None] << np.uint64(16)) + np.arange(DIMS // 64, dtype=np.uint64) + np.uint64(SEED)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x + np.uint64(0x9E3779B97F4A7C15)) ^ (x >> np.uint64(shift))
            x = x * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return np.unpackbits(x.view(np.uint8).reshape(len(points), -1), axis=1)


def lowered(text: str) -> str:
    """Lower case that doesn't depend on what stands around a letter."""
    return text.lower().replace("ς", "σ")


def normal(points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blanks for all that isn't a letter, and which points stay: of a run of blanks the first. first: where texts begin."""
    points = np.where(letters()[points], points, 32)
    blank = points == 32
    keep = ~blank | first
    keep[1:] |= blank[1:] & ~blank[:-1]
    return points, keep


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def carried(text: str) -> str:
    """The last two symbols of a text in normal form: what the next piece begins with."""
    points = code_points(text)
    first = np.zeros(len(points), bool)
    first[:1] = True
    points, keep = normal(points, first)
    return points[keep][-2:].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


def pieces(text: str) -> Iterator[str]:
    """A text as trigrams() takes it, between two blanks; a long one in pieces that share two symbols."""
    text, lead = lowered(text), " "
    for at in range(0, len(text), PIECE):
        piece = lead + text[at : at + PIECE]
        if at + PIECE >= len(text):
            yield piece + " "
        else:
            yield piece
            lead = carried(piece)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """owner, kind: the text (of pieces()) and the trigram of each place; used: the letters; kinds: each trigram as one number of letters."""
    points = code_points("".join(texts))
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    first = np.ones(len(points), bool)
    first[1:] = owner[1:] != owner[:-1]
    points, keep = normal(points, first)
    points, owner = points[keep], owner[keep]
    used, place = np.unique(points, return_inverse=True) if len(points) < 4096 else _dense(points)
    inside = owner[2:] == owner[:-2]
    n = len(used)
    code = ((place[:-2].astype(np.int64) * n + place[1:-1]) * n + place[2:])[inside]
    owner = owner[2:][inside]
    kinds, kind = np.unique(code, return_inverse=True) if n**3 > CELLS * 16 else _dense(code)
    return owner, kind, used, kinds


def trigram_vectors(kinds: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """A row of +-1 for each trigram: its letters' vectors, turned by their places and bound."""
    n = len(bits)
    bound = np.roll(bits[kinds // (n * n)], 2, axis=1)
    bound ^= np.roll(bits[kinds // n % n], 1, axis=1)
    bound ^= bits[kinds % n]
    return 1 - 2 * bound.astype(np.float32)


def _dense(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with inverse, for small whole numbers, without a sort."""
    seen = np.zeros(int(values.max()) + 1 if len(values) else 1, bool)
    seen[values] = True
    used = np.flatnonzero(seen)
    to = np.zeros(len(seen), np.int32)
    to[used] = np.arange(len(used), dtype=np.int32)
    return used, to[values]


def bundles(texts: list[str], group: list[int], n_groups: int) -> np.ndarray:
    """The vector of each group of texts: whole numbers, as float64."""
    out = np.zeros((n_groups, DIMS))

    def add(some: list[str], to: np.ndarray) -> None:
        owner, kind, used, kinds = trigrams(some)
        if not len(owner):
            return
        bits = letter_vectors(used)
        rows, row = np.unique(to[owner], return_inverse=True)
        if len(rows) * len(kinds) > 25 * len(kind):
            # few repeats: vectors place by place, in order of rows
            order = np.argsort(row, kind="stable")
            for start in range(0, len(order), KINDS):
                some_places = order[start : start + KINDS]
                here = row[some_places]
                starts = np.flatnonzero(np.concatenate(([True], here[1:] != here[:-1])))
                out[rows[here[starts]]] += np.add.reduceat(trigram_vectors(kinds[kind[some_places]], bits), starts, axis=0)
            return
        # many repeats: a table of counts by row and trigram, times the trigrams' vectors
        order = np.argsort(kind, kind="stable") if len(kinds) > KINDS else np.arange(len(kind))
        row, kind = row[order], kind[order]
        for low in range(0, len(kinds), KINDS):
            signs = trigram_vectors(kinds[low : low + KINDS], bits)
            a, b = (0, len(kind)) if len(kinds) <= KINDS else np.searchsorted(kind, (low, low + KINDS)).tolist()
            at, which, step = row[a:b], kind[a:b] - low, max(1, CELLS // len(signs))
            for start in range(0, len(rows), step):
                count = min(step, len(rows) - start)
                here = (at >= start) & (at < start + count) if count < len(rows) else slice(None)
                table = np.bincount((at[here] - start) * len(signs) + which[here], minlength=count * len(signs))
                out[rows[start : start + count]] += table.reshape(count, -1).astype(np.float32) @ signs

    some, to, size = [], [], 0
    for text, g in zip(texts, group, strict=True):
        for piece in pieces(text):
            some.append(piece)
            to.append(g)
            size += len(piece)
            if size >= PIECE:
                add(some, np.array(to))
                some, to, size = [], [], 0
    if some:
        add(some, np.array(to))
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Language names in order, and their prototypes as unit vectors."""
    bound_batches(docs.sparkSession)
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch["lang"].to_pylist()
            names = sorted(set(langs))
            found = bundles(batch["text"].to_pylist(), [names.index(x) for x in langs], len(names))
            for name, vector in zip(names, found, strict=True):
                total[name] = total[name] + vector if name in total else vector
        for name in sorted(total):
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIMS, pa.string()), pa.array(range(DIMS), pa.int32()), pa.array(total[name])], names=["lang", "dim", "v"])

    sums = rows.mapInArrow(tidy(run), "lang string, dim int, v double").groupBy("lang", "dim").agg(F.sum("v").alias("v"))
    found: dict[str, np.ndarray] = {}
    for r in sums.collect():
        found.setdefault(r["lang"], np.zeros(DIMS))[r["dim"]] = r["v"]
    names = sorted(k for k, v in found.items() if v.any())
    return names, np.array([found[k] / np.linalg.norm(found[k]) for k in names]).reshape(len(names), DIMS)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The documents with their columns, and the prediction and its score, which replace columns of these names."""
    bound_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in names]
    schema = T.StructType([docs.schema[c] for c in kept]).add(names[0], "string").add(names[1], "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prototypes = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                texts = [t or "" for t in part["text"].to_pylist()]
                vectors = bundles(texts, list(range(len(texts))), len(texts))
                size = np.sqrt((vectors**2).sum(axis=1))
                # summed row by row, so that a score doesn't depend on what else is in the batch
                dots = [(vectors * p).sum(axis=1) for p in prototypes] or [np.zeros(len(texts))]
                cosine = np.stack(dots, axis=1) / np.maximum(size, 1e-9)[:, None]
                has = (size > 0) & bool(langs) & np.fromiter((any(map(str.isalpha, t)) for t in texts), bool, len(texts))
                best = cosine.argmax(axis=1)
                said = [langs[k] if ok else UNKNOWN for k, ok in zip(best, has, strict=True)]
                score = np.where(has, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), pa.array(said, pa.string()), pa.array(score)], names=[*kept, *names])

    return docs.select(*kept).mapInArrow(tidy(run), schema)


def predict(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = learn(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose text is in some language; those without letters go."""
    found = identify(docs, learn(docs), ("_lang_pred", "_lang_score"))
    return found.filter(F.col("_lang_pred") != UNKNOWN).select(*docs.columns)
