"""Byte-wise text functions over ASCII, and the registry of character filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_upper(text: Column) -> Column:
    """a-z only; upper() would also change letters beyond ASCII. All-ASCII texts take the faster way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.upper(text)).otherwise(F.translate(text, LOWER, UPPER))


def ascii_lower(text: Column) -> Column:
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def keep_acgt(text: Column) -> Column:
    """Nucleotides of a reference text."""
    return F.regexp_replace(ascii_upper(text), "[^ACGT]+", "")


def keep_acgnt(text: Column) -> Column:
    return F.regexp_replace(ascii_upper(text), "[^ACGNT]+", "")


def keep_alnum(text: Column) -> Column:
    return F.regexp_replace(ascii_upper(text), "[^A-Z0-9]+", "")


def keep_full(text: Column) -> Column:
    """Everything but NUL."""
    return F.replace(text, F.lit("\0"), F.lit(""))


def keep_one_line(text: Column) -> Column:
    """Neither NUL nor line feed."""
    return F.replace(keep_full(text), F.lit("\n"), F.lit(""))


#: Character filters by name; add to it to extend the engine.
FILTERS: dict[str, Callable[[Column], Column]] = {"full": keep_full, "basic": keep_acgnt, "nonl": keep_one_line, "acgt": keep_acgt, "alnum": keep_alnum}


def alphabet(name: str) -> list[str]:
    """Symbols that a filter lets through."""
    every = [chr(c) for c in range(1, 256)]
    return {"full": every, "basic": list("ACGNT"), "nonl": [c for c in every if c != "\n"]}[name]


def chars(text: Column) -> Column:
    """The characters of a text, in order."""
    return F.filter(F.split(text, ""), lambda c: c != "")


#: Characters of a text that stand as an array of their own at the same time.
PIECE = 1 << 20


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once a row and use it in `body`, which may hold lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def in_pieces(text: Column, found: Callable[[Column, Column], Column], overlap: int = 0) -> Column:
    """found(characters, offset) of every piece of a text, as one array.

    Pieces are PIECE characters and `overlap` more of what follows, so that texts of any length never stand as one array of characters.
    """
    return F.flatten(F.transform(slices(text, PIECE, overlap), lambda p, b: bind(chars(p), lambda c: found(c, b.cast("long") * PIECE))))


def slices(text: Column, size: int, overlap: int = 0) -> Column:
    """Pieces of `size` characters, each with `overlap` more of what follows; the last one is shorter.

    Work is linear in the text: an ASCII text is cut as bytes, any other one as characters,
    where substring() would count from the start for every piece.
    """
    n = F.char_length(text)
    numbers = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    as_bytes = bind(text.cast("binary"), lambda raw: F.transform(numbers, lambda b: F.substring(raw, b * size + 1, F.lit(size + overlap)).cast("string")))
    as_chars = bind(chars(text), lambda c: F.transform(numbers, lambda b: F.array_join(F.slice(c, b * size + 1, F.lit(size + overlap)), "")))
    return F.when((n > 0) & (n <= size), F.array(text)).when(F.octet_length(text) == n, as_bytes).otherwise(as_chars)


def nibble_code(seq: Column) -> Column:
    """Four bits a symbol, A1 C2 G3 T4 N5 and other 0, first symbol in the low half; as hexadecimal digits."""
    digits = F.regexp_replace(F.translate(seq, "ACGTN", "12345"), "[^1-5]", "0")
    even = F.when(F.char_length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits)
    return F.regexp_replace(even, "(.)(.)", "$2$1")


def nibble_decode(code: Column, n: Column) -> Column:
    """The first n symbols of a nibble code; what is no symbol becomes `?`."""
    digits = F.regexp_replace(code, "(.)(.)", "$2$1")
    return F.substring(F.translate(digits, "123450", "ACGTN?"), F.lit(1), n)


def rolling_hash(seq: Column, modulus: int = 15_485_863, base: int = 256) -> Column:
    """Polynomial hash of a text's characters."""
    return F.aggregate(chars(seq), F.lit(0).cast("long"), lambda h, c: (h * base + F.ascii(c)) % modulus)


def size_label(n: Column) -> Column:
    """A byte count for people: up to 1024 as bytes, then KB, MB, GB with two decimals."""
    scaled = lambda k, unit: F.concat(F.format_string("%.2f", F.floor(n * 100 / float(1 << (10 * k))) / 100), F.lit(unit))
    return F.when(n < 1025, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, scaled(1, " KB")).when(n < 1 << 30, scaled(2, " MB")).otherwise(scaled(3, " GB"))


def path_join(first: Column, second: Column) -> Column:
    """The two parts with exactly one slash between them, if either has one at most."""
    return F.concat(F.regexp_replace(first, "/$", ""), F.lit("/"), F.regexp_replace(second, "^/", ""))


def has_suffix(path: Column, suffix: str) -> Column:
    """Whether a path ends in the suffix and has a name before it."""
    return path.endswith(suffix) & (F.char_length(path) > len(suffix))


def climb_free(path: Column) -> Column:
    """A path without any `..` step."""
    return F.regexp_replace(path, r"(^|/)\.\.(?=/|$)", "$1")


def encode_threads(size: Column, block: int = 100_000, most: int = 4) -> Column:
    """Parallel encoders for a text: one for each 16 blocks, 1 to `most`."""
    return F.greatest(F.lit(1), F.least(F.lit(most), F.floor(size / (16 * block)))).cast("int")


def wants_write(flags: Column) -> Column:
    """Open flags that write: O_WRONLY or O_RDWR."""
    return flags.bitwiseAND(F.lit(3)).isin(1, 2)


def wants_append(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(1024)) != 0
