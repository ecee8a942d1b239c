"""Quality bands, gates and guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def confidence_band5(c: Column) -> Column:
    return (
        F.when(c.isNull(), "unknown").when(c >= 0.95, "excellent").when(c >= 0.9, "good").when(c >= 0.75, "fair").when(c >= 0.5, "poor").otherwise("bad")
    )


def confidence_band3(c: Column) -> Column:
    return F.when(c >= 0.9, "high").when(c >= 0.75, "medium").otherwise("low")


def error_band5(cer: Column) -> Column:
    return F.when(cer <= 0.01, "excellent").when(cer <= 0.05, "good").when(cer <= 0.10, "fair").when(cer <= 0.25, "poor").otherwise("bad")


def confidence_gate(c: Column) -> Column:
    return F.when(c >= 0.9, "accept").when(c >= 0.5, "review").otherwise("reject")


def ratio(numerator: Column, denominator: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(empty))


def calibrated(p: Column, temperature: Column) -> Column:
    """sigmoid(logit(p) / T) with p clamped away from 0 and 1."""
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.round(1 / (1 + F.exp(-F.ln(q / (1 - q)) / temperature)), 6)
