"""Greedy factorisation against a reference text, its codes, and decoding.

Each factor is the longest prefix of the rest that occurs in the reference: sequential
within a block, so blocks are the unit of parallelism. A block's factors stay together as
arrays in one row; coding, decoding and measuring them need no shuffle, and factors()
gives them as rows. The reference and its suffix array go to every task as a broadcast
of checked size.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import bits, codecs
from helixframe.operators.reference import suffix_array
from helixframe.session import spread

#: Characters of a suffix that are compared first; longer matches look further.
PROBE = 32
#: Characters that find a factor's part of the suffix order at once, and how many such parts are remembered.
HEAD, HEADS = 5, 200_000


def common_prefix(a: str, b: str) -> int:
    """How many characters two strings have in common at their start."""
    n = 0
    for x, y in zip(a[:PROBE], b[:PROBE], strict=False):
        if x != y:
            return n
        n += 1
    low, high = n, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


@dataclass
class ReferenceIndex:
    """A reference text with the order of its suffixes."""

    text: str
    order: array = field(default_factory=lambda: array("q"))
    #: Rows of the order whose suffixes begin with some HEAD characters, filled as these are met.
    spans: dict[str, tuple[int, int]] = field(default_factory=dict)

    @classmethod
    def of(cls, text: str) -> ReferenceIndex:
        return cls(text, array("q", suffix_array(text).astype(np.int64).tobytes()))

    def span(self, wanted: str, low: int = 0, high: int | None = None) -> tuple[int, int]:
        """The rows of the order whose suffixes begin with `wanted`, looked for between two rows."""
        ref, n = self.text, len(wanted)
        key = lambda p: ref[p : p + n]
        first = bisect_left(self.order, wanted, low, high, key=key)
        return first, bisect_right(self.order, wanted, first, high, key=key)

    def head(self, wanted: str) -> tuple[int, int]:
        """The same for HEAD characters, remembered."""
        found = self.spans.get(wanted)
        if found is None:
            if len(self.spans) >= HEADS:
                self.spans.clear()
            found = self.spans[wanted] = self.span(wanted)
        return found

    def longest(self, text: str, at: int, stop: int) -> tuple[int, int]:
        """Position and length of the longest prefix of text[at:stop]; of several places the first in suffix order."""
        ref, order, look, low, high = self.text, self.order, PROBE, 0, len(self.order)
        if stop - at >= HEAD:
            first, last = self.head(text[at : at + HEAD])
            if first < last:
                low, high = first, last
        while True:
            wanted = text[at : min(stop, at + look)]
            k = bisect_left(order, wanted, low, high, key=lambda p: ref[p : p + look])
            best = max((common_prefix(wanted, ref[p : p + look]) for p in order[max(k - 1, low) : min(k + 1, high)]), default=0)
            if best < look or at + look >= stop:
                break
            look *= 4
        if not best:
            return -1, 0
        return order[self.span(text[at : at + best], low, high)[0]], best

    def first_inside(self, wanted: str, start: int, stop: int) -> int:
        """Of the places start to stop (that too) where `wanted` stands the first in suffix order; -1 if there is none."""
        low, high = self.span(wanted)
        for k in range(low, high, 4096):
            places = np.frombuffer(self.order, np.int64)[k : min(k + 4096, high)]
            hit = np.flatnonzero((places >= start) & (places <= stop))
            if len(hit):
                return int(places[hit[0]])
        return -1

    def longest_inside(self, text: str, at: int, stop: int, start: int, end: int) -> tuple[int, int]:
        """The same as longest() where a match may only begin from start to end in the reference."""
        position, most = self.longest(text, at, stop)
        if not most or start <= position <= end:
            return position, most
        least, found = 0, -1
        while least < most:  # what begins inside with n characters does so with fewer
            middle = (least + most + 1) // 2
            place = self.first_inside(text[at : at + middle], start, end)
            least, most, found = (middle, most, place) if place >= 0 else (least, middle - 1, found)
        return found, least

    def longest_valid(self, text: str, at: int, stop: int, least: int, valid: np.ndarray) -> tuple[int, int]:
        """The longest prefix of `least` characters or more all of whose lengths from `least` on end at a valid place of the reference somewhere; else -1, 0."""
        found, n = (-1, 0), least
        low, high = self.span(text[at : at + least]) if stop - at >= least else (0, 0)
        while low < high:
            places = np.frombuffer(self.order, np.int64)[low:high]
            hit = np.flatnonzero(valid[places + n - 1])
            if not len(hit):
                break
            found, n = (int(places[hit[0]]), n), n + 1
            low, high = self.span(text[at : at + n], low, high) if at + n <= stop else (0, 0)
        return found

    def factors(self, text: str, inside: tuple[int, int] | None = None) -> tuple[list[int], list[int]]:
        positions, lengths, at, end = [], [], 0, len(text)
        while at < end:
            p, n = self.longest(text, at, end) if inside is None else self.longest_inside(text, at, end, *inside)
            if not n:
                raise ValueError(f"the reference lacks the symbol {text[at]!r}")
            positions.append(p)
            lengths.append(n)
            at += n
        return positions, lengths

    def valid_factors(self, text: str, least: int, valid: np.ndarray) -> tuple[list[int], list[int]]:
        """Matches of `least` characters or more; position -1 and length 1 for a character in none."""
        positions, lengths, at, end = [], [], 0, len(text)
        while at < end:
            p, n = self.longest_valid(text, at, end, least, valid)
            positions.append(p)
            lengths.append(max(n, 1))
            at += max(n, 1)
        return positions, lengths


ENCODED = "file_id long, block_no int, ref_pos array<long>, len array<long>"


def _rows(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    return zip(*(batch[c].to_pylist() for c in columns), strict=True)


def _encoded(keys: pa.RecordBatch, positions: list, lengths: list) -> pa.RecordBatch:
    kind = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([keys["file_id"], keys["block_no"], pa.array(positions, kind), pa.array(lengths, kind)], names=["file_id", "block_no", "ref_pos", "len"])


def _factorized(blocks: DataFrame, index: ReferenceIndex, of_block: Callable[[ReferenceIndex, str, int], tuple[list, list]]) -> DataFrame:
    shared = blocks.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            found = [of_block(index, text, start) for text, start in _rows(batch, "text", "block_start")]
            yield _encoded(batch, [p for p, _ in found], [n for _, n in found])

    return spread(blocks.select("file_id", "block_no", "block_start", "text"), "file_id", "block_no").mapInArrow(run, ENCODED)


def factorize(blocks: DataFrame, reference: str) -> DataFrame:
    """file_id, block_no, ref_pos, len: the factors of each block (file_id, block_no, block_start, text), as arrays."""
    return _factorized(blocks, ReferenceIndex.of(reference), lambda index, text, start: index.factors(text))


def factorize_near(blocks: DataFrame, reference: str, reach: int) -> DataFrame:
    """The same where a factor begins `reach` characters at most from the block's own place, so that positions of a block lie close together.

    The window moves with the blocks; beyond the reference's end it stays there. The reference
    repeats its alphabet within every reach (build_range_reference), or some symbol is missed.
    """
    size = len(reference)

    def near(index: ReferenceIndex, text: str, start: int) -> tuple[list, list]:
        return index.factors(text, (max(0, min(start, size) - reach), start + reach))

    return _factorized(blocks, ReferenceIndex.of(reference), near)


def factorize_valid(blocks: DataFrame, reference: str, least: int, valid: list[tuple[int, int]]) -> DataFrame:
    """Matches of `least` characters or more that end inside the ranges `valid` (from, to) of the reference; other characters stand alone at -1."""
    mask = np.zeros(len(reference), bool)
    for a, b in valid:
        mask[a:b] = True
    return _factorized(blocks, ReferenceIndex.of(reference), lambda index, text, start: index.valid_factors(text, least, mask))


def factors(encoded: DataFrame) -> DataFrame:
    """file_id, block_no, factor_no, ref_pos, len, text_off: a row for each factor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = [(np.cumsum(n) - n).tolist() for n in (np.array(x, np.int64) for x in batch["len"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(offsets, pa.list_(pa.int64()))], names=[*batch.schema.names, "text_off"])

    rows = encoded.select("file_id", "block_no", "ref_pos", "len").mapInArrow(run, f"{ENCODED}, text_off array<long>")
    rows = rows.select("file_id", "block_no", F.posexplode(F.arrays_zip("ref_pos", "len", "text_off")).alias("factor_no", "f"))
    return rows.select("file_id", "block_no", F.col("factor_no").cast("long").alias("factor_no"), "f.ref_pos", "f.len", "f.text_off")


def decode(encoded: DataFrame, reference: str) -> DataFrame:
    """file_id, block_no, text: pieces of the reference, put together in order."""
    shared = encoded.sparkSession.sparkContext.broadcast(reference)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref = shared.value
        for batch in batches:
            texts = ["".join(ref[a : a + m] for a, m in zip(p, n, strict=True)) for p, n in _rows(batch, "ref_pos", "len")]
            yield pa.RecordBatch.from_arrays([batch["file_id"], batch["block_no"], pa.array(texts, pa.string())], names=["file_id", "block_no", "text"])

    return encoded.select("file_id", "block_no", "ref_pos", "len").mapInArrow(run, "file_id long, block_no int, text string")


def join_blocks(blocks: DataFrame) -> DataFrame:
    """file_id, text: the blocks of each file in order."""
    ordered = F.array_sort(F.collect_list(F.struct("block_no", "text")))
    return blocks.groupBy("file_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"))


def block_widths(encoded: DataFrame) -> DataFrame:
    """file_id, block_no, n, low, high, width, delta_width: what the position codes of a block need."""
    rows = encoded.select("file_id", "block_no", F.size("ref_pos").cast("long").alias("n"), F.array_min("ref_pos").alias("low"), F.array_max("ref_pos").alias("high"))
    return rows.withColumn("width", bits.n_bits(F.col("high"))).withColumn("delta_width", bits.n_bits(F.col("high") - F.col("low")))


def encoded_bytes(encoded: DataFrame) -> DataFrame:
    """file_id, block_no, pos_bytes, len_bytes, bytes_len: sizes of a block's codes, by formula."""
    len_bits = F.aggregate("len", F.lit(0).cast("long"), lambda s, n: s + bits.golomb_bits(n))
    rows = encoded.select("file_id", "block_no", bits.words32(8 + F.size("ref_pos") * bits.n_bits(F.array_max("ref_pos"))).alias("pos_bytes"), bits.words32(len_bits).alias("len_bytes"))
    return rows.withColumn("bytes_len", F.col("pos_bytes") + F.col("len_bytes"))


def encode_blocks(encoded: DataFrame) -> DataFrame:
    """file_id, block_no, n, positions, lengths: the codes of each block as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, n = ([np.array(x, np.int64) for x in batch[c].to_pylist()] for c in ("ref_pos", "len"))
            yield pa.RecordBatch.from_arrays(
                [batch["file_id"], batch["block_no"], pa.array(list(map(len, p)), pa.int64()), pa.array(list(map(codecs.pack_maxbits, p)), pa.binary()), pa.array(list(map(codecs.pack_golomb, n)), pa.binary())],
                names=["file_id", "block_no", "n", "positions", "lengths"],
            )

    return encoded.select("file_id", "block_no", "ref_pos", "len").mapInArrow(run, "file_id long, block_no int, n long, positions binary, lengths binary")


def decode_blocks(packed: DataFrame) -> DataFrame:
    """The inverse: file_id, block_no, ref_pos, len."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(codecs.unpack_maxbits(p, n), codecs.unpack_golomb(x, n)) for n, p, x in _rows(batch, "n", "positions", "lengths")]
            yield _encoded(batch, [p for p, _ in found], [n for _, n in found])

    return packed.select("file_id", "block_no", "n", "positions", "lengths").mapInArrow(run, ENCODED)


def short_factor_segments(encoded: DataFrame, reference: str, min_length: int) -> DataFrame:
    """file_id, block_no, seg_start, seg_text: runs of factors shorter than min_length, where matches may hide that no factor holds."""
    shared = encoded.sparkSession.sparkContext.broadcast(reference)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref = shared.value
        for batch in batches:
            out: list[tuple[int, int, int, str]] = []
            for f, b, positions, lengths in _rows(batch, "file_id", "block_no", "ref_pos", "len"):
                at, start, parts = 0, 0, []
                for p, n in [*zip(positions, lengths, strict=True), (0, min_length)]:
                    if n < min_length:
                        start = start if parts else at
                        parts.append(ref[p : p + n])
                    elif parts:
                        out.append((f, b, start, "".join(parts)))
                        parts = []
                    at += n
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=["file_id", "block_no", "seg_start", "seg_text"])

    return encoded.select("file_id", "block_no", "ref_pos", "len").mapInArrow(run, "file_id long, block_no int, seg_start long, seg_text string")
