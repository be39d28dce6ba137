"""Outliers by quartile fences or z-score: bounds, impact on the mean, row flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import as_double, long_form, numeric_columns
from ..functions.shared_pass import SharedPass
from .profile import fixed

# Decision limits.
MIN_VALUES = 10
FENCE = 1.5
Z_LIMIT = 3
METHODS = ("auto", "iqr", "zscore")


def outlier_bounds(
    df: DataFrame,
    columns: str | Sequence[str] | None = None,
    method: str = "auto",
    state: SharedPass | None = None,
) -> DataFrame:
    """``(col_pos, col_name, n, mean, std, lower, upper)`` per column that can be tested.

    Columns with fewer than ten values or a zero quartile range are left out.
    The bounds are computed here, so that applying them is one further scan.
    ``state`` is a pass over the same columns, with quantile summaries unless
    the method is ``zscore``.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    state = state or SharedPass(df, numeric_columns(df, columns), quantiles=method != "zscore")
    enough = {f["col_name"]: f for f in state.facts() if f["n"] >= MIN_VALUES}
    if method == "zscore":
        limits = {c: [f["mean"] + side * Z_LIMIT * f["std"] for side in (-1, 1)] for c, f in enough.items()}
    else:
        quartiles = state.quantiles((0.25, 0.75), list(enough))
        # NaN, from infinite quartiles, equals itself here.
        varied = {c: (q1, q3) for c, (q1, q3) in quartiles.items() if q1 != q3 and not (q1 != q1 and q3 != q3)}
        limits = {c: [q1 - (q3 - q1) * FENCE, q3 + (q3 - q1) * FENCE] for c, (q1, q3) in varied.items()}
    return df.sparkSession.createDataFrame(
        [tuple(enough[c][k] for k in ("col_pos", "col_name", "n", "mean", "std")) + tuple(lim) for c, lim in limits.items()],
        "col_pos int, col_name string, n bigint, mean double, std double, lower double, upper double",
    )


def _outside(x: Column, method: str, mean: Column, std: Column, lower: Column, upper: Column):
    if method == "zscore":
        return (std > 0) & (F.abs(x - mean) > std * Z_LIMIT)
    return (x < lower) | (x > upper)


def outliers(
    df: DataFrame,
    columns: str | Sequence[str] | None = None,
    method: str = "auto",
    bounds: DataFrame | None = None,
) -> DataFrame:
    """Per column with outliers: count, share of present values, bounds, pull on the mean."""
    bounds = fixed(bounds if bounds is not None else outlier_bounds(df, columns, method))
    tested = [r.col_name for r in bounds.collect()]
    if not tested:
        return bounds.selectExpr(
            "col_pos", "col_name", "0L AS count", "0D AS percent", "lower", "upper",
            "0D AS mean_with", "0D AS mean_without", "0D AS impact_pct",
        )
    # One row per column: the broadcast is bounded by the table's width.
    cells = long_form(df, tested).join(F.broadcast(bounds), "col_name")
    x = F.col("x")
    out = _outside(x, method, *[F.col(c) for c in ("mean", "std", "lower", "upper")])
    pull = F.try_divide(
        F.abs(F.col("mean_with") - F.col("mean_without")), F.abs(F.col("mean_with"))
    )
    return (
        cells.groupBy("col_pos", "col_name", "lower", "upper")
        .agg(
            F.count_if(out).alias("count"),
            F.count("x").alias("n"),
            F.avg("x").alias("mean_with"),
            F.avg(F.when(~out, x)).alias("mean_without"),
        )
        .where(F.col("count") > 0)
        .select(
            "col_pos",
            "col_name",
            "count",
            (F.col("count") * 100.0 / F.col("n")).alias("percent"),
            "lower",
            "upper",
            "mean_with",
            "mean_without",
            F.when(F.col("mean_with") == 0, 0.0).otherwise(pull * 100).alias("impact_pct"),
        )
    )


def flag_outliers(
    df: DataFrame, columns: str | Sequence[str] | None = None, method: str = "auto"
) -> DataFrame:
    """The table with one ``<column>_outlier`` boolean per numeric column.

    Bounds are fitted first and enter as literals, so flagging is a projection:
    no join and no shuffle.
    """
    fitted = {r.col_name: r for r in outlier_bounds(df, columns, method).collect()}
    flags = {}
    for c in numeric_columns(df, columns):
        row = fitted.get(c)
        if row is None:
            flags[f"{c}_outlier"] = F.lit(False)
        else:
            limits = [F.lit(row[k]) for k in ("mean", "std", "lower", "upper")]
            flags[f"{c}_outlier"] = F.coalesce(
                _outside(as_double(df, c), method, *limits), F.lit(False)
            )
    return df.withColumns(flags)
