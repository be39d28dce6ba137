"""Distribution shape, missing values and cardinality."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import (
    FLOATING,
    INTEGRAL,
    column_index,
    half_even,
    identity,
    plain_columns,
    quoted,
    with_position,
)
from .profile import column_facts, null_counts

# Decision limits of the profile.
MIN_VALUES_FOR_SHAPE = 5
NEAR_SYMMETRIC = 0.5
MCAR_SPREAD = 5
ID_LIKE_ABOVE = 95
LOW_CARDINALITY_BELOW = 1


def shape_label(skewness: Column) -> Column:
    return (
        F.when(F.abs(skewness) < NEAR_SYMMETRIC, "normal")
        .when(skewness > 0, "right_skewed")
        .when(skewness.isNotNull(), "left_skewed")
    )


def distributions(
    df: DataFrame, columns: str | Sequence[str] | None = None, facts: DataFrame | None = None
) -> DataFrame:
    """Moments and a shape label per numeric column with at least five values."""
    facts = facts if facts is not None else column_facts(df, columns, shape=True)
    return facts.where(F.col("n") >= MIN_VALUES_FOR_SHAPE).select(
        "col_pos",
        "col_name",
        "n",
        "mean",
        "std",
        "skewness",
        "kurtosis",
        shape_label(F.col("skewness")).alias("shape"),
        "min",
        "max",
    )


def missing(
    df: DataFrame,
    columns: str | Sequence[str] | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Columns with missing values: count and share of all rows."""
    counts = counts if counts is not None else null_counts(df, columns)
    return counts.where(F.col("null_count") > 0).select(
        "col_pos",
        "col_name",
        "null_count",
        F.try_divide(F.col("null_count") * 100.0, F.col("n_rows").cast("double")).alias("percent"),
    )


def missing_pattern(missing_table: DataFrame) -> DataFrame:
    """One row, or none if nothing is missing: are the shares alike across columns?"""
    share = half_even(F.col("percent"), 1)
    return (
        missing_table.agg((F.max(share) - F.min(share)).alias("spread"))
        .where(F.col("spread").isNotNull())
        .select(
            "spread",
            F.when(F.col("spread") < MCAR_SPREAD, "MCAR_suspected")
            .otherwise("MAR_or_MNAR_possible")
            .alias("pattern"),
        )
    )


def cell_groups(df: DataFrame, names: Sequence[str]) -> list[tuple[str, list[str]]]:
    """Columns that can share one unpivot without turning values into text.

    Each column is in one group, so however many groups there are, every column
    of a columnar file is still read once.
    """
    kinds: dict[str, list[str]] = {}
    for c in names:
        dtype = df.schema[c].dataType
        kind = (
            "bigint"
            if isinstance(dtype, INTEGRAL)
            else "double"
            if isinstance(dtype, FLOATING)
            else dtype.simpleString()
        )
        kinds.setdefault(kind, []).append(c)
    return list(kinds.items())


def distinct_counts(
    df: DataFrame, columns: str | Sequence[str] | None = None, *, approx: bool = False
) -> DataFrame:
    """Distinct present values per column, nested types left out.

    The exact count shuffles by (column, value) after duplicates are dropped in
    each task, so a frequent value costs one row per task. ``approx`` shuffles a
    sketch per column instead.
    """
    names = plain_columns(df, columns)
    count = F.approx_count_distinct("x", 0.01) if approx else F.count_distinct("x")
    parts = []
    for kind, members in cell_groups(df, names):
        cells = df.select(*[identity(df, c).cast(kind).alias(c) for c in members]).unpivot(
            [], [F.col(quoted(c)) for c in members], "col_name", "x"
        )
        parts.append(
            cells.groupBy("col_name").agg(
                F.count(F.lit(1)).alias("n_rows"), count.alias("n_distinct")
            )
        )
    if not parts:
        return column_index(df, []).selectExpr("*", "0L AS n_rows", "0L AS n_distinct")
    return with_position(reduce(DataFrame.union, parts), df, names).select(
        "col_pos",
        "col_name",
        "dtype",
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"),
    )


def cardinality(
    df: DataFrame, columns: str | Sequence[str] | None = None, *, approx: bool = False
) -> DataFrame:
    """Distinct values of every column and what their share of all rows suggests."""
    counts = distinct_counts(df, columns, approx=approx)
    ratio = half_even(
        F.try_divide(F.col("n_distinct") * 100.0, F.col("n_rows").cast("double")), 1
    )
    return counts.withColumn("ratio_pct", ratio).select(
        "col_pos",
        "col_name",
        "n_distinct",
        "ratio_pct",
        F.when(F.col("ratio_pct") > ID_LIKE_ABOVE, "id_like")
        .when(F.col("ratio_pct") < LOW_CARDINALITY_BELOW, "low_cardinality")
        .when(F.col("ratio_pct").isNotNull(), "mixed")
        .alias("label"),
    )
