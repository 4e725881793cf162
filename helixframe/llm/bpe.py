"""Byte-level BPE encoding and decoding by speculation and verification.

A word is first cut by greedy longest match, a guess that is mostly right. A
sequence of tokens is what the merges give if, and only if, every adjacent pair of
it is what the merges give for the two tokens' bytes. So all adjacent pairs of all
new words are checked at once, in NumPy, by undoing the two tokens' merges from
the seam outwards; only words with a failing pair are merged exactly.

Texts are first cut at single spaces between two non-blank characters, where the
tokenizer's own pattern always starts a word. Such chunks repeat, and so do the
words in them; the ids of both are kept in tables of bounded size while a task
runs. The library's own splitter cuts chunks that aren't plain ASCII, as its
character classes belong to a certain version of Unicode.

Defined cases: a null text counts as empty: no tokens, digests of nothing. Empty
tables give empty results, further columns are ignored, repeated rows come back
as often as they came. A special token's string in a text is that token, as in
the tokenizers library's defaults.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from helixframe.llm.common import bound_batches, release_memory, tidy

#: The published split pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries in each generation of a worker's tables, and the longest that is kept.
CACHE_ENTRIES, CACHE_CHARS = 100_000, 64
#: Texts whose chunks are looked up together.
TEXTS = 512
NEVER = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Recent(dict):
    """A bounded table of two generations: what isn't asked for again while one fills up, goes."""

    def __init__(self, limit: int = CACHE_ENTRIES):
        super().__init__()
        self.limit, self.old, self.long = limit, {}, []

    def __missing__(self, key):
        value = self[key] = self.old.pop(key)
        return value

    def lacking(self, keys: set) -> set:
        return keys.difference(self).difference(self.old)

    def turn(self) -> None:
        """After a batch: forget what is too long to keep, and the older generation if this one is full."""
        for key in self.long:
            self.pop(key, None)
        self.long.clear()
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()

    def learn(self, key: str, value: bytes) -> None:
        self[key] = value
        if len(key) > CACHE_CHARS:
            self.long.append(key)


class ByteBpe:
    """Vocabulary and merges of a byte-level BPE tokenizer file."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        letters = byte_letters()
        vocab, merges = data["model"]["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        size = 1 + max([*vocab.values(), *(t["id"] for t in data["added_tokens"])])
        self.bytes_of: list[bytes] = [b""] * size
        for token, k in vocab.items():
            self.bytes_of[k] = bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        for content, k in self.special.items():
            self.bytes_of[k] = content.encode()
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # rank of the merge that makes a token (-1: a byte), and the two parts of that merge
        self.rank, self.left, self.right = (np.full(size, -1, np.int64) for _ in range(3))
        keys, ranks = np.empty(len(merges), np.int64), np.arange(len(merges))
        self.made = np.empty(len(merges), np.int64)
        for r, (a, b) in enumerate(merges):
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            self.made[r] = made
            keys[r] = x << 32 | y
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = r, x, y
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], ranks[order]
        self.base = np.zeros(256, np.int64)
        for k, token in enumerate(self.bytes_of):
            if len(token) == 1 and self.rank[k] < 0:
                self.base[token[0]] = k
        self.id_of = {t: k for k, t in enumerate(self.bytes_of) if t and k not in self.special.values()}
        # longest token by its first three bytes: where the greedy match starts to look
        self.longest: dict[bytes, int] = {}
        for token in self.id_of:
            if len(token) > 2:
                self.longest[token[:3]] = max(self.longest.get(token[:3], 0), len(token))
        self.words, self.seams = regex.compile(PATTERN), regex.compile(r"(?<=\S) (?=\S)")
        self.odd_blank = regex.compile(r" \s|\s |^ | $")
        self.forget()
        self.split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str

    def forget(self) -> None:
        """Empty tables: a task starts and leaves without them."""
        self.known_words, self.known_heads, self.known_tails = Recent(), Recent(), Recent()

    # -- speculation -------------------------------------------------------------
    def greedy(self, word: bytes) -> list[int]:
        out, at, end = [], 0, len(word)
        find, longest = self.id_of, self.longest
        while at < end:
            for stop in range(min(end, at + longest.get(word[at : at + 3], 2)), at, -1):
                k = find.get(word[at:stop])
                if k is not None:
                    out.append(k)
                    at = stop
                    break
        return out

    # -- verification ------------------------------------------------------------
    def _merge_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x << 32 | y
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the merges keep the seam between each x and its y.

        x and y stand side by side from the moment both are made until the one made
        later is undone again, going back in time. A merge across the seam within
        that span breaks it. At equal rank the leftmost pair merges first, so the
        left side's own merge wins a tie and the right side's loses it.
        """
        fine = np.ones(len(x), bool)
        at, until = np.arange(len(x)), np.full(len(x), NEVER)
        while len(at):
            across = self._merge_rank(x, y)
            broken = across < until
            fine[at[broken]] = False
            go = ~broken & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            at, x, y = at[go], x[go], y[go]
            left_last = self.rank[x] > self.rank[y]
            until = np.where(left_last, self.rank[x], self.rank[y] + 1)
            x, y = np.where(left_last, self.right[x], x), np.where(left_last, y, self.left[y])
        return fine

    # -- exact merging -------------------------------------------------------------
    def exact(self, words: list[bytes]) -> list[list[int]]:
        """Lowest rank first, leftmost first; a merge in every word at each step."""
        out: list[list[int]] = [[]] * len(words)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        for start in range(0, len(order), 2048):
            some = order[start : start + 2048]
            short = [k for k in some if len(words[k]) <= 64]
            for k in some[len(short) :]:
                out[k] = self._exact_long([int(b) for b in self.base[np.frombuffer(words[k], np.uint8)]])
            if short:
                for k, ids in zip(short, self._exact_rows([words[k] for k in short]), strict=True):
                    out[k] = ids
        return out

    def _exact_rows(self, words: list[bytes]) -> list[list[int]]:
        wide = max(map(len, words)) + 1
        grid = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), np.uint8).reshape(len(words), wide)
        size = np.fromiter(map(len, words), np.int64, len(words))
        column = np.arange(wide)
        # beyond a word's end stands an id that no merge has
        ids = np.where(column < size[:, None], self.base[grid], len(self.rank))
        ranks = np.where(column[:-1] + 1 < size[:, None], self._merge_rank(ids[:, :-1], ids[:, 1:]), NEVER)
        out: list[list[int]] = [[]] * len(words)
        rows = np.arange(len(words))
        while True:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            for k in np.flatnonzero(best == NEVER).tolist():
                out[rows[k]] = ids[k, : size[k]].tolist()
            go = best < NEVER
            if not go.any():
                return out
            rows, ids, ranks, size, at, best = rows[go], ids[go], ranks[go], size[go] - 1, at[go], best[go]
            n = np.arange(len(rows))
            ids[n, at] = self.made[best]
            ids = np.take_along_axis(ids, np.minimum(column + (column > at[:, None]), wide - 1), axis=1)
            ids[n, size] = len(self.rank)
            ranks = np.take_along_axis(ranks, np.minimum(column[:-1] + (column[:-1] > at[:, None]), wide - 2), axis=1)
            ranks[:, -1] = NEVER
            ranks[n, at] = self._merge_rank(ids[n, at], ids[n, at + 1])
            inner = at > 0
            ranks[n[inner], at[inner] - 1] = self._merge_rank(ids[n[inner], at[inner] - 1], ids[n[inner], at[inner]])

    @cached_property
    def merge(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(left, right): (rank, token made); only long words ask for it."""
        order = self.pair_keys.tolist()
        return {(k >> 32, k & 0xFFFFFFFF): (r, m) for k, r, m in zip(order, self.pair_ranks.tolist(), self.made[self.pair_ranks].tolist(), strict=True)}

    def _exact_long(self, ids: list[int]) -> list[int]:
        """The same by a heap of pairs over a linked list, for words without end."""
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(*self.merge[pair], k) for k, pair in enumerate(zip(ids, ids[1:], strict=False)) if pair in self.merge]
        heap = [(r, k, made) for r, made, k in heap]
        heapq.heapify(heap)
        while heap:
            r, k, made = heapq.heappop(heap)
            nxt = after[k] if alive[k] else n
            if nxt >= n or self.merge.get((ids[k], ids[nxt])) != (r, made):
                continue
            ids[k], alive[nxt] = made, False
            after[k] = after[nxt]
            if after[k] < n:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (found := self.merge.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (found[0], a, found[1]))
        return [t for t, live in zip(ids, alive, strict=True) if live]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word; all pairs of all words are verified together."""
        guesses = [self.greedy(w) for w in words]
        sizes = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter((t for g in guesses for t in g), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inside = owner[1:] == owner[:-1]
        pairs, back = np.unique(flat[:-1][inside] << 32 | flat[1:][inside], return_inverse=True)
        broken = ~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
        failed = np.unique(owner[:-1][inside][broken]).tolist()
        for k, ids in zip(failed, self.exact([words[k] for k in failed]), strict=True):
            guesses[k] = ids
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in guesses]

    # -- texts ---------------------------------------------------------------------
    def _cut(self, chunk: str) -> list[str]:
        if chunk.isascii():
            return self.words.findall(chunk)
        return [chunk[a:b] for _, (a, b) in self.split(chunk)]

    def _learn(self, chunks: set[str], front: str, known: Recent) -> None:
        """Make sure that the table has the ids of `front` + chunk for every chunk."""
        cut = {c: self._cut(front + c) for c in known.lacking(chunks)}
        words = self.known_words
        asked: set[str] = set()
        for ws in cut.values():
            asked.update(ws)
        new = list(words.lacking(asked))
        if new:
            for w, ids in zip(new, self.encode_words([w.encode() for w in new]), strict=True):
                words.learn(w, ids)
        of = words.__getitem__
        for c, ws in cut.items():
            known.learn(c, of(ws[0]) if len(ws) == 1 else b"".join(map(of, ws)))
        words.turn()

    def _chunks(self, text: str) -> list[str]:
        """Pieces that the pattern never joins; all but the first have lost the space in front."""
        return self.seams.split(text) if self.odd_blank.search(text) else text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        plan: list[list[tuple[int, list[str]]]] = []
        for text in texts:
            parts = self.special_cut.split(text) if self.special_cut and any(s in text for s in self.special) else [text]
            plan.append([(self.special[p], []) if k % 2 else (-1, self._chunks(p)) for k, p in enumerate(parts) if k % 2 or p])
        tails: set[str] = set()
        for doc in plan:
            for _, chunks in doc:
                tails.update(chunks[1:])
        self._learn({c[0] for doc in plan for s, c in doc if s < 0}, "", self.known_heads)
        self._learn(tails, " ", self.known_tails)
        head, tail, out = self.known_heads.__getitem__, self.known_tails.__getitem__, []
        for doc in plan:
            got: list[bytes] = []
            for special, chunks in doc:
                if special >= 0:
                    got.append(struct.pack("<I", special))
                else:
                    got.append(head(chunks[0]))
                    got.extend(map(tail, chunks[1:]))
            out.append(b"".join(got))
        self.known_heads.turn()
        self.known_tails.turn()
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_LOADED: dict[str, ByteBpe] = {}


def load(spec: str) -> ByteBpe:
    """One model in each Python process."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(spec)
        release_memory()
    return _LOADED[key]


def read_spec(path: str | None = None) -> str:
    """The tokenizer file's text; by default the public byte-level vocabulary of this machine."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_decode(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array<int>) and decoded text."""
    bound_batches(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(spec.value)
        model.forget()
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                ids = model.encode([t or "" for t in part["text"].to_pylist()])
                texts = [model.decode(x) for x in ids]
                columns = [
                    part["doc_id"],
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                ] + ([pa.array(ids, pa.binary()), pa.array(texts, pa.string())] if with_ids else [])
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])
        model.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), schema)
