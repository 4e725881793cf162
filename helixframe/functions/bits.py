"""Sizes of integer codes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: log2 of the Golomb base.
GOLOMB_POWER = 6


def n_bits(n: Column) -> Column:
    """Binary digits of n; 1 for 0."""
    return F.char_length(F.bin(n))


def golomb_bits(n: Column, power: int = GOLOMB_POWER) -> Column:
    """Unary quotient with its end mark, then `power` bits of remainder."""
    return F.shiftrightunsigned(n, power) + 1 + power


def gamma_bits(n: Column) -> Column:
    """Elias gamma of n > 0."""
    return 2 * (n_bits(n) - 1) + 1


def varbyte_size(n: Column) -> Column:
    """Bytes of seven bits each that hold n, 1 to 9."""
    return F.greatest(F.lit(1), F.ceil(n_bits(n) / 7)).cast("int")


def words32(bits: Column) -> Column:
    """Bytes of a bit string that is filled up to whole 32-bit words."""
    return (4 * F.ceil(bits / 32)).cast("long")
