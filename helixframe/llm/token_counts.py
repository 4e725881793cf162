"""Token counts under a unigram tokenizer, without its ids: count-only Viterbi.

An Aho-Corasick automaton gives every vocabulary piece that ends at each place of a
word; dynamic programming keeps the best score and the piece count of the best path.
Ties follow the tokenizer: among paths of equal score the one whose last piece
starts first wins, and a character without a piece of its own costs the lowest score
less 10 and counts as one token for each of its bytes.

The box has no unigram model, and tokenizers are never trained. So the vocabulary and
scores are those of a public piece file, read as a unigram model, as its own library
does when the file's type says so. Its scores are whole numbers: sums are exact, and
the best path of a text is made of the best paths of its words, since no piece goes
on past a blank. Words repeat; the worker keeps their results in a bounded table.

Defined cases: a null or empty text has 0 tokens and score 0. Blanks at the ends and
runs of blanks count, as in the library. Repeated rows come back as often as they came;
empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import bound_batches, tidy

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
TABLE = 500_000
LONGEST_KEPT = 64


def read_pieces(path: str | None = None) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece file and their scores: no control, unknown or byte pieces."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = (k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k)))
    return [(model.id_to_piece(k), model.get_score(k)) for k in ordinary]


class CountingViterbi:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.matches = ahocorasick.Automaton()
        for piece, score in pieces:
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        # cutting before a blank is right if no piece has one after another character
        if any(BLANK in p.lstrip(BLANK) for p, _ in pieces):
            raise ValueError("a piece goes on past a blank")
        # a character that no piece has stands alone on every path
        self.line_alone = not any("\n" in p for p, _ in pieces)
        self.segments = regex.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.known: dict[str, complex] = {}

    def best(self, word: str) -> complex:
        """Score (real part) and number of tokens (imaginary part) of the best path."""
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for at, found in self.matches.iter(word):
            ends[at + 1].append(found)  # longest first: the earliest start first
        scores, counts = [0.0] * (n + 1), [0] * (n + 1)
        for e in range(1, n + 1):
            top, count, single = None, 0, False
            for length, score in ends[e]:
                s = scores[e - length] + score
                single |= length == 1
                if top is None or s > top:
                    top, count = s, counts[e - length] + 1
            if not single:
                s = scores[e - 1] + self.unknown
                if top is None or s > top:
                    top, count = s, counts[e - 1] + len(word[e - 1].encode())
            scores[e], counts[e] = top, count
        return complex(scores[n], counts[n])

    def _cut(self, text: str) -> list[str]:
        if "  " in text or BLANK in text or text[0] == " " or text[-1] == " ":
            words = self.segments.findall(BLANK + text.replace(" ", BLANK))
        else:
            words = [BLANK + w for w in text.split(" ")]
        if self.line_alone and "\n" in text:
            return [x for w in words for x in (regex.split(r"(\n)", w) if "\n" in w else (w,)) if x]
        return words

    def count(self, texts: list[str]) -> list[tuple[int, float]]:
        known = self.known
        if len(known) > TABLE:
            known.clear()
        out = []
        for text in texts:
            words = self._cut(text) if text else []
            long = {}
            for w in set(words).difference(known):
                (known if len(w) <= LONGEST_KEPT else long)[w] = self.best(w)
            # both parts are whole numbers, so one sum carries the two exactly
            of = (lambda w, long=long: long[w] if w in long else known[w]) if long else known.__getitem__
            total = sum(map(of, words), 0j)
            out.append((int(total.imag), total.real))
        return out


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]] | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, score (of the best path)."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_pieces() if pieces is None else pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or CountingViterbi(shared.value)
            found = model.count([t or "" for t in batch["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([n for n, _ in found], pa.int64()), pa.array(np.array([s for _, s in found], float))], names=["doc_id", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, n_tokens long, score double")
