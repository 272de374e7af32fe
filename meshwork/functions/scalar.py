"""Scalar functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A prime, and two multipliers below it: products fit in 64 bits.
PRIME, FIRST, SECOND = 2147483647, 1103515245, 1852869643


def scrambled(v: Column, seed: int = 0) -> Column:
    """A number below 2**31 that spreads ids: two multiplications modulo a prime with a shift between them, in longs."""
    x = F.pmod(F.pmod(v.cast("long"), F.lit(PRIME).cast("long")) + F.lit(seed % PRIME).cast("long") + 1, F.lit(PRIME).cast("long"))
    x = F.pmod(x * F.lit(FIRST).cast("long"), F.lit(PRIME).cast("long"))
    x = x.bitwiseXOR(F.shiftright(x, 15))
    return F.pmod(x * F.lit(SECOND).cast("long"), F.lit(PRIME).cast("long"))


def scrambled_sql(v: str, seed: int = 0) -> str:
    """The same in SQL, for ids that are not negative."""
    x = f"(((({v}) % {PRIME} + {seed % PRIME} + 1) % {PRIME}) * {FIRST} % {PRIME})"
    return f"(xor({x}, {x} >> 15) * {SECOND} % {PRIME})"


def least_missing(numbers: Column) -> Column:
    """The least number from 0 on that an array of distinct integers lacks."""
    return F.array_min(F.array_except(F.sequence(F.lit(0), F.size(numbers)), numbers))


def power2_up(x: Column) -> Column:
    """The least power of two that is not below x; 1 for x below 1."""
    x = x.cast("long")
    width = F.length(F.bin(F.greatest(x - 1, F.lit(0).cast("long"))))
    return F.when(x <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), width.cast("int")))


def power2_down(x: Column) -> Column:
    """The largest power of two that is not above x; 0 for x below 1."""
    x = x.cast("long")
    return F.when(x < 1, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), (F.length(F.bin(x)) - 1).cast("int")))


def align_up(x: Column, unit: int) -> Column:
    return (F.ceil(x / unit) * unit).cast("long")


def align_down(x: Column, unit: int) -> Column:
    return (F.floor(x / unit) * unit).cast("long")
