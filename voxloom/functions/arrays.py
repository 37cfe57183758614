"""Numbers over sample arrays and telemetry readings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rms(samples: Column) -> Column:
    """Root mean square; an empty array gives 0."""
    energy = F.aggregate(samples, F.lit(0.0), lambda acc, v: acc + v * v)
    return F.when(F.size(samples) > 0, F.sqrt(energy / F.size(samples))).otherwise(F.lit(0.0))


def peak(samples: Column) -> Column:
    """Largest absolute sample; an empty array gives 0."""
    return F.coalesce(F.array_max(F.transform(samples, lambda v: F.abs(v))), F.lit(0.0))


def round_half_even(value: Column, digits: int) -> Column:
    """Rounds the binary value with ties to even, unlike ``round``."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def gigabytes(size: Column) -> Column:
    return round_half_even(size / float(1024**3), 2)


def megabytes(size: Column) -> Column:
    return round_half_even(size / float(1024**2), 0)


def percent(part: Column, whole: Column) -> Column:
    return round_half_even(F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(0.0)), 1)
