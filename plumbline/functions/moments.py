"""Sample statistics with the bias corrections that pandas users expect."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def sample_skewness(g1: Column, n: Column, lo: Column, hi: Column) -> Column:
    """Adjusted Fisher-Pearson skewness; 0 for a constant column, NULL below 3 values."""
    n = n.cast("double")
    adjusted = g1 * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n >= 3, F.when(lo == hi, F.lit(0.0)).otherwise(adjusted))


def sample_kurtosis(g2: Column, n: Column, lo: Column, hi: Column) -> Column:
    """Adjusted excess kurtosis; 0 for a constant column, NULL below 4 values."""
    n = n.cast("double")
    adjusted = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.when(n >= 4, F.when(lo == hi, F.lit(0.0)).otherwise(adjusted))


def sample_std(std: Column, lo: Column, hi: Column) -> Column:
    """Sample deviation, exactly 0 for a constant column.

    Merging partial moments can leave a constant column with a deviation of
    1e-17 or so; equal extremes prove it constant.
    """
    return F.when((lo == hi) & std.isNotNull(), F.lit(0.0)).otherwise(std)
