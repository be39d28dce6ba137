"""Table profile: schema, null counts, describe, and the shared column facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import (
    column_index,
    long_form,
    numeric_columns,
    present,
    quoted,
    wanted_columns,
    with_position,
)
from ..functions.moments import sample_kurtosis, sample_skewness, sample_std
from ..functions.shared_pass import SharedPass

QUARTILES = (0.25, 0.5, 0.75)
APPROX_ACCURACY = 10_000


def schema_table(df: DataFrame) -> DataFrame:
    """``(col_pos, col_name, dtype)``; touches no data."""
    return column_index(df, df.columns)


def head(df: DataFrame, n: int = 5, order_by: str | Sequence[str] | None = None) -> DataFrame:
    """The first ``n`` rows. Spark tables have no order unless one is named."""
    ordered = df.orderBy(*([order_by] if isinstance(order_by, str) else order_by)) if order_by else df
    return ordered.limit(n)


def null_counts(df: DataFrame, columns: str | Sequence[str] | None = None) -> DataFrame:
    """Rows and missing values per column: one aggregate, one row per task shuffled.

    No rows if none of the named columns exists.
    """
    names = wanted_columns(df, columns)
    if not names:
        return column_index(df, []).select(
            "col_pos", "col_name", F.lit(0).cast("bigint").alias("n_rows"), F.lit(0).cast("bigint").alias("null_count")
        )
    totals = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count(present(df, c)).alias(f"n{i}") for i, c in enumerate(names)],
    )
    lines = [
        F.struct(
            F.lit(i).alias("col_pos"),
            F.lit(c).alias("col_name"),
            F.col("n_rows"),
            (F.col("n_rows") - F.col(f"n{i}")).alias("null_count"),
        )
        for i, c in enumerate(names)
    ]
    return totals.select(F.inline(F.array(*lines)))


def overview(df: DataFrame) -> DataFrame:
    """Compact profile: rows, columns, total missing values, the column names."""
    return null_counts(df).agg(
        F.max("n_rows").alias("n_rows"),
        F.count(F.lit(1)).alias("n_cols"),
        F.sum("null_count").alias("nulls"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("col_pos", "col_name"))),
                lambda s: s["col_name"],
            ),
            ",",
        ).alias("columns"),
    )


def column_facts(
    df: DataFrame,
    columns: str | Sequence[str] | None = None,
    *,
    shape: bool = False,
    include_decimal: bool = False,
) -> DataFrame:
    """One pass over the numeric columns: counts, mean, deviation, extremes.

    With ``shape``, skewness and excess kurtosis as well. One row per column.
    """
    names = numeric_columns(df, columns, include_decimal)
    if not names:
        return column_index(df, []).select(
            "*", *[F.lit(None).cast(t).alias(c) for c, t in _FACT_TYPES[: 8 if shape else 6]]
        )
    lo, hi = F.min("x"), F.max("x")
    stats = [
        F.count(F.lit(1)).alias("n_rows"),
        F.count("x").alias("n"),
        F.avg("x").alias("mean"),
        sample_std(F.stddev_samp("x"), lo, hi).alias("std"),
        lo.alias("min"),
        hi.alias("max"),
    ]
    if shape:
        stats += [
            sample_skewness(F.skewness("x"), F.count("x"), lo, hi).alias("skewness"),
            sample_kurtosis(F.kurtosis("x"), F.count("x"), lo, hi).alias("kurtosis"),
        ]
    facts = long_form(df, names).groupBy("col_name").agg(*stats)
    counted = with_position(facts, df, names)
    return counted.select(
        "col_pos",
        "col_name",
        "dtype",
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("n", F.lit(0)).alias("n"),
        "mean",
        "std",
        "min",
        "max",
        *(["skewness", "kurtosis"] if shape else []),
    )


_FACT_TYPES = [
    ("n_rows", "bigint"),
    ("n", "bigint"),
    ("mean", "double"),
    ("std", "double"),
    ("min", "double"),
    ("max", "double"),
    ("skewness", "double"),
    ("kurtosis", "double"),
]


def fixed(report: DataFrame) -> DataFrame:
    """A computed report kept as literal rows, so later steps don't scan the data again.

    For reports whose size follows the number of columns, never the number of rows.
    """
    return report.sparkSession.createDataFrame(report.collect(), report.schema)


def describe(
    df: DataFrame,
    columns: str | Sequence[str] | None = None,
    *,
    approx: bool = False,
    include_decimal: bool = False,
) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles per numeric column.

    Quartiles are exact. One scan keeps moments and a quantile summary of each column, a second one
    settles the quartiles (``functions.shared_pass``); both run when this is called. ``approx`` takes
    Spark's sketch in one lazy pass.
    """
    names = numeric_columns(df, columns, include_decimal)
    if approx and names:
        facts = column_facts(df, columns, include_decimal=include_decimal)
        cuts = (
            long_form(df, names)
            .groupBy("col_name")
            .agg(
                F.percentile_approx("x", list(QUARTILES), APPROX_ACCURACY).alias("q"),
            )
        )
        table = facts.join(F.broadcast(cuts), "col_name", "left").select(
            facts["*"], *[F.col("q")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75"))]
        )
        return _describe_order(table)
    state = SharedPass(df, names, quantiles=True)
    cuts = state.quantiles(QUARTILES)
    return _describe_order(facts_table(state, {n: {c: q[i] for c, q in cuts.items()} for i, n in enumerate(("p25", "p50", "p75"))}))


def _describe_order(table: DataFrame) -> DataFrame:
    return table.select(
        "col_pos", "col_name", "dtype", "n_rows", "n", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def facts_table(state: SharedPass, extra: dict[str, dict[str, float | None]] | None = None) -> DataFrame:
    """The facts of a pass, as ``column_facts`` with shape gives them, and more columns of doubles by name."""
    extra = extra or {}
    lines = [
        (f["col_pos"], f["col_name"], f["dtype"], *[f[c] for c, _ in _FACT_TYPES], *[v[f["col_name"]] for v in extra.values()])
        for f in state.facts()
    ]
    types = [*_FACT_TYPES, *[(n, "double") for n in extra]]
    return state.df.sparkSession.createDataFrame(
        lines, "col_pos int, col_name string, dtype string, " + ", ".join(f"{quoted(c)} {t}" for c, t in types)
    )


def null_table(state: SharedPass, columns: Sequence[str]) -> DataFrame:
    """``null_counts`` of columns that a pass has looked at."""
    found = state.present_counts()
    return state.df.sparkSession.createDataFrame(
        [(i, c, state.n_rows, state.n_rows - found[c]) for i, c in enumerate(columns)],
        "col_pos int, col_name string, n_rows bigint, null_count bigint",
    )
