"""Lengths in bits of the integer codes, as Column functions; numbers count from 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = 0.6931471  # fixed value


def floor_log2(x: Column) -> Column:
    return F.length(F.bin(x.cast("long"))) - 1


def unary(x: Column) -> Column:
    return x


def binary(x: Column, most: Column) -> Column:
    """x in 1..most, truncated binary."""
    full = F.when(most > 1, floor_log2(most - 1) + 1).otherwise(0)
    return F.when(x <= F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2.0), full) - most, full - 1).otherwise(full)


def gamma(x: Column) -> Column:
    return 2 * floor_log2(x) + 1


def delta(x: Column) -> Column:
    low = floor_log2(x)
    return gamma(low + 1) + low


def block_size(n: Column, p: Column) -> Column:
    """The block for p of n, at least 1."""
    return F.greatest(F.floor(F.lit(0.5) + F.lit(LN2) * n / p), F.lit(1)).cast("long")


def block(x: Column, size: Column) -> Column:
    """Block code: the number of whole blocks in unary, the rest in binary."""
    return F.floor((x - 1) / size) + 1 + binary((x - 1) % size + 1, size)
