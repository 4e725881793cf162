"""A quality classifier by co-training of two views.

The text view sees hashed words and character statistics; the metadata view sees
source, language and length. Each is a ridge logistic regression. In every round each
view labels the pool documents it is surest of, for the *other* view to learn from.
At the end the two views' logits are calibrated and combined on labelled documents
that neither has seen, and every document is scored.

Bounds: LABELLED rows with labels and POOL rows without, those with the smallest hash of
doc_id, are used for fitting, SURE pseudo-labels at most for each class and round. The
fitted weights have a fixed size. All documents are scored, whole texts read.

Defined cases: a null text counts as empty; null source or language are values of their
own; a null doc_id is never used for fitting. Without both classes among the labels the
score is 0.5 and all is kept. Of rows that share a doc_id one is learned from. Repeated
rows come back as often as they came; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import bound_batches, discard, settle, smallest_hashes, tidy, workspace

LABELLED, POOL, SURE, ROUNDS = 6_000, 6_000, 300, 4
CONFIDENT = 0.95
WORD_CELLS, SOURCE_CELLS, LANG_CELLS, LENGTH_CELLS = 512, 64, 32, 24
STATISTICS = 9
#: Share of unseen good documents that may fall under the threshold, which is 0.5 at most.
SPARED = 0.005
WORD_TABLE = 500_000
_SYMBOLS, _UPPER, _DIGITS, _LOUD = b"#*$%&<>", bytes(range(65, 91)), bytes(range(48, 58)), b"!|"


class _Cells(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= WORD_TABLE:
            self.clear()
        value = self[word] = zlib.crc32(word.encode()) % WORD_CELLS
        return value


_CELLS = _Cells()


def text_view(texts: list[str]) -> np.ndarray:
    """A row of WORD_CELLS + STATISTICS numbers for each text."""
    out = np.zeros((len(texts), WORD_CELLS + STATISTICS), np.float32)
    for row, text in zip(out, texts, strict=True):
        words, raw = text.split(), text.encode()
        if not words:
            continue
        counts = np.sqrt(np.bincount(np.fromiter(map(_CELLS.__getitem__, words), np.int64, len(words)), minlength=WORD_CELLS))
        row[:WORD_CELLS] = counts / np.linalg.norm(counts)
        share = lambda chars: 1 - len(raw.translate(None, chars)) / len(raw)  # noqa: B023, E731
        lines = [x for x in text.split("\n") if x.strip()]
        row[WORD_CELLS:] = (
            min(1, 5 * share(_SYMBOLS)), min(1, 3 * share(_UPPER)), min(1, 5 * share(_DIGITS)), min(1, 8 * share(_LOUD)),
            len(set(words)) / len(words), 1 - len(set(lines)) / len(lines),
            min(1, len(raw) / len(words) / 20), min(1, np.log1p(len(words)) / 12), 1.0 if len(words) < 20 else 0.0,
        )
    return out


def metadata_view(sources: list[str | None], langs: list[str | None], sizes: list[int | None]) -> np.ndarray:
    out = np.zeros((len(sources), SOURCE_CELLS + LANG_CELLS + LENGTH_CELLS), np.float32)
    cell = lambda x, n: zlib.crc32(("-" if x is None else "+" + x).encode()) % n
    rows = np.arange(len(sources))
    out[rows, [cell(s, SOURCE_CELLS) for s in sources]] = 1
    out[rows, [SOURCE_CELLS + cell(x, LANG_CELLS) for x in langs]] = 1
    out[rows, [SOURCE_CELLS + LANG_CELLS + min(LENGTH_CELLS - 1, int(max(0, n or 0)).bit_length()) for n in sizes]] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, the intercept last, by Newton's method; classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    weight = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x.astype(np.float64) @ w[:-1] + w[-1], -30, 30)


@dataclass
class CoTrained:
    text: np.ndarray
    meta: np.ndarray
    mix: np.ndarray  # weights of the two logits and the intercept
    threshold: float

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-logit(np.stack([logit(text, self.text), logit(meta, self.meta)], axis=1), self.mix)))


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, unseen: np.ndarray, pool: tuple[np.ndarray, np.ndarray]) -> CoTrained | None:
    """views, y: labelled documents; unseen: which of them only calibrate; pool: the same views without labels."""
    if len(set(y[~unseen])) < 2 or len(set(y[unseen])) < 2:
        return None
    train = [[v[~unseen]] for v in views]
    given = [[y[~unseen]] for _ in views]
    free = [np.ones(len(pool[0]), bool) for _ in views]
    weights = [logistic(v[0], g[0]) for v, g in zip(train, given, strict=True)]
    for _ in range(ROUNDS):
        for teacher in (0, 1):
            learner = 1 - teacher
            p = 1 / (1 + np.exp(-logit(pool[teacher], weights[teacher])))
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                order = np.argsort(-sure, kind="stable")
                chosen = order[(sure[order] >= CONFIDENT) & free[learner][order]][:SURE]
                free[learner][chosen] = False
                train[learner].append(pool[learner][chosen])
                given[learner].append(np.full(len(chosen), label))
        weights = [logistic(np.concatenate(v), np.concatenate(g)) for v, g in zip(train, given, strict=True)]
    both = np.stack([logit(v[unseen], w) for v, w in zip(views, weights, strict=True)], axis=1)
    model = CoTrained(*weights, logistic(both, y[unseen]), 0.5)
    good = model.score(views[0][unseen], views[1][unseen])[y[unseen] > 0.5]
    model.threshold = min(0.5, float(np.quantile(good, SPARED)))
    return model


def _sample(docs: DataFrame, labels: DataFrame, folder: str) -> DataFrame:
    """doc_id and quality (null: pool) of the documents used for fitting; LABELLED + POOL rows at most."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    first = lambda df, n: smallest_hashes(df, n, df.count(), "doc_id", unique=True)
    ids = docs.select("doc_id").filter("doc_id is not null").distinct()
    pool = first(ids.join(known.select("doc_id"), "doc_id", "left_anti"), POOL).withColumn("quality", F.lit(None).cast("int"))
    return settle(first(known.select("doc_id", F.col("quality").cast("int").alias("quality")), LABELLED).unionByName(pool), folder, "sample")


def quality_classifier(docs: DataFrame, labels: DataFrame, folder: str | None = None) -> DataFrame:
    """One row per document: doc_id, text_score, metadata_score, score, kept."""
    bound_batches(docs.sparkSession)
    given, folder = folder, folder or workspace(docs.sparkSession, "co-training")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))

    def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return text_view([t or "" for t in batch["text"].to_pylist()]), metadata_view(*(batch[c].to_pylist() for c in ("source", "lang", "n_chars")))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, meta = features(batch)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["quality"], pa.array([r.tobytes() for r in text], pa.binary()), pa.array([r.tobytes() for r in meta], pa.binary())], names=["doc_id", "quality", "text", "meta"])

    chosen = docs.join(F.broadcast(_sample(docs, labels, folder)), "doc_id")
    # a doc_id may repeat, one of them in most rows: one row of each is learned from
    once = Window.partitionBy("doc_id").orderBy(F.xxhash64("text", "source", "lang", "n_chars"))
    chosen = chosen.withColumn("_turn", F.row_number().over(once)).filter("_turn = 1").drop("_turn")
    rows = chosen.mapInArrow(tidy(gather), "doc_id long, quality int, text binary, meta binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"], r["meta"]))
    stack = lambda some, c: np.frombuffer(b"".join(r[c] for r in some), np.float32).reshape(len(some), -1) if some else np.zeros((0, 1), np.float32)
    labelled, pool = [r for r in rows if r["quality"] is not None], [r for r in rows if r["quality"] is None]
    y = np.array([float(r["quality"] > 0) for r in labelled])
    unseen = np.array([zlib.crc32(str(r["doc_id"]).encode()) % 4 == 0 for r in labelled], bool)
    if given is None:
        discard(docs.sparkSession, folder)
    model = co_train((stack(labelled, "text"), stack(labelled, "meta")), y, unseen, (stack(pool, "text"), stack(pool, "meta"))) if labelled and pool else None
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                if fitted is None:
                    half = np.full(part.num_rows, 0.5)
                    parts = [half, half, half, np.ones(part.num_rows, bool)]
                else:
                    text, meta = features(part)
                    p = fitted.score(text, meta)
                    parts = [1 / (1 + np.exp(-logit(text, fitted.text))), 1 / (1 + np.exp(-logit(meta, fitted.meta))), p, p >= fitted.threshold]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *map(pa.array, parts)], names=["doc_id", "text_score", "metadata_score", "score", "kept"])

    return docs.mapInArrow(tidy(score), "doc_id long, text_score double, metadata_score double, score double, kept boolean")
