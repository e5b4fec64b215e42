"""Column functions that several operators or users of their results need: norms, guards, codes and names of files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(value: Column, otherwise: float = 0.0) -> Column:
    """The value, or ``otherwise`` where it is null, not a number or infinite."""
    odd = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(odd, F.lit(otherwise)).otherwise(value)


def minkowski(a: Column, b: Column, p: float = 2) -> Column:
    """The p-norm of the difference of two arrays of one length."""
    powers = F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y).cast("double"), F.lit(p)))
    return F.pow(F.aggregate(powers, F.lit(0.0), lambda s, x: s + x), F.lit(1 / p))


def argmax(scores: Column) -> Column:
    """The 0-based place of the first largest entry of an array."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def log_or_null(value: Column) -> Column:
    """The natural logarithm; null, and no infinity, of what is not positive."""
    return F.when(value > 0, F.log(value))


def rolling_hash(values: Column, base: int = 31, modulus: int = 1_000_000_007) -> Column:
    """A polynomial hash of an array of integers."""
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda h, x: F.pmod(h * base + x.cast("bigint"), F.lit(modulus)))


def stamped(path: str, when: datetime | None = None) -> str:
    """The path with the time of a run in its name."""
    return f"{path}_{(when or datetime.now()).strftime('%Y%m%d_%H%M%S')}"
