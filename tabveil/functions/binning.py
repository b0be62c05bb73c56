"""Binning, un-binning and rounding as column expressions: whole-stage code, no Python on the workers."""

from __future__ import annotations

from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_ip(c: Column, prefix: int = 30) -> Column:
    return F.shiftright(c.cast("long"), 32 - prefix)


def bin_port(c: Column, threshold: int = 1024, size: int = 10) -> Column:
    return F.when(c < threshold, c.cast("long")).otherwise(threshold + F.floor((c - threshold) / size))


def bin_integer(c: Column, size: float) -> Column:
    """1-based bins."""
    return F.floor(c / F.lit(size)) + 1


def bin_exponential(c: Column, base: float = 2) -> Column:
    """Bin k holds base**(k-1) exclusive to base**k inclusive; everything up to 0 is in bin 0."""
    return F.when(c <= 0, F.lit(0).cast("long")).otherwise(F.ceil(F.ln(F.when(c > 0, c.cast("double"))) / F.lit(log(base))))


def _draw(n: Column, seed: int | None) -> Column:
    """A uniform integer from 0 to n - 1."""
    return F.floor(F.rand(seed) * n).cast("long")


def bounds(kind: str, c: Column, bin: float, threshold: int = 1024, first: Column | None = None) -> tuple[Column, Column]:
    """The least and the largest raw value that a bin decodes to (for floats the bounds of the interval)."""
    if kind == "binned-ip":
        low = F.shiftleft(c.cast("long"), 32 - int(bin))
        return low, low + ((1 << (32 - int(bin))) - 1)
    if kind == "binned-port":
        low = F.when(c < threshold, c.cast("long")).otherwise(threshold + (c.cast("long") - threshold) * int(bin))
        return low, F.when(c < threshold, c.cast("long")).otherwise(F.least(low + int(bin) - 1, F.lit(65535)))
    if kind in ("binned_integer", "timestamp"):
        low = (c.cast("long") - 1) * F.lit(bin).cast("long") + (first if first is not None else F.lit(0))
        return low, low + F.lit(bin).cast("long") - 1
    low, high = F.pow(F.lit(float(bin)), c.cast("double")), F.pow(F.lit(float(bin)), c.cast("double") + 1)
    return (F.floor(low), F.greatest(F.floor(low), F.floor(high) - 1)) if kind == "int-exponential" else (low, high)


def unbin(kind: str, c: Column, bin: float, threshold: int = 1024, first: Column | None = None, diff_bin: float = 0, seed: int | None = None) -> Column:
    """A random raw value of a bin. Timestamps fall in the first part of a bin, around half of `diff_bin`."""
    low, high = bounds(kind, c, bin, threshold, first)
    if kind == "timestamp" and diff_bin:
        spot = F.rint(F.greatest(F.lit(0.0), F.least(F.randn(seed) * (diff_bin / 4) + diff_bin / 2, F.lit(diff_bin - 1.0))))
        return (low + spot).cast("long")
    if kind == "float-exponential":
        return low + F.rand(seed) * (high - low)
    if kind == "binned-port":
        raw = low + _draw(F.lit(int(bin)), seed)
        return F.when(c < threshold, low).when(raw > 65535, 65534 + _draw(F.lit(2), seed)).otherwise(raw)
    return low + _draw(high - low + 1, seed)


def half_even(c: Column) -> Column:
    """Rounding to the nearest integer, halves to even."""
    return F.rint(c).cast("long")


def stochastic_round(c: Column, seed: int | None = None) -> Column:
    return (F.floor(c) + F.when(F.rand(seed) < c - F.floor(c), 1).otherwise(0)).cast("long")
