"""The explain report: all analyses of a table, a summary and the key findings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import half_even, number_text, numeric_columns, wanted_columns
from ..functions.shared_pass import SharedPass
from . import correlate, distribution, outliers as fences
from .profile import facts_table, fixed, null_table

ACTIONS = ("explain", "correlate", "outliers", "profile")
# How much of each list the summary shows.
SUMMARY_ITEMS = 3
INSIGHT_ITEMS = 2
SKEW_WORTH_MENTION = 1


@dataclass(frozen=True)
class Findings:
    """Small reports of one table; a section that was not asked for is ``None``."""

    shape: DataFrame
    correlations: DataFrame | None = None
    outliers: DataFrame | None = None
    distributions: DataFrame | None = None
    missing: DataFrame | None = None
    cardinality: DataFrame | None = None

    def summary(self) -> DataFrame:
        return summary(self)

    def insights(self) -> DataFrame:
        return insights(self)

    def alerts(self) -> DataFrame:
        return alerts(self)

    def table(self) -> DataFrame:
        return tidy(self)


def explain(
    df: DataFrame,
    action: str = "explain",
    columns: str | Sequence[str] | None = None,
    method: str = "auto",
    threshold: float = correlate.STRONG_ABOVE,
) -> Findings:
    """Run the analyses of ``action`` and keep their reports.

    The report sizes follow the number of columns. Each is computed once and
    kept, because the summary, the findings and the tidy table all read them.
    """
    if action not in ACTIONS:
        raise ValueError(f"action must be one of {', '.join(ACTIONS)}")
    numeric, named = numeric_columns(df, columns), wanted_columns(df, columns)
    paired = action in ("explain", "correlate") and len(numeric) >= 2
    fenced, shaped = action in ("explain", "outliers"), action in ("explain", "profile")
    state = SharedPass(
        df,
        numeric,
        pairs=paired,
        quantiles=fenced and method != "zscore",
        counted=[c for c in named if c not in numeric] if shaped else [],
    )
    shape = df.sparkSession.createDataFrame(
        [(state.n_rows, len(df.columns), len(numeric))], "n_rows bigint, n_cols int, n_numeric int"
    )
    found: dict[str, DataFrame] = {}
    if paired:
        pairs = correlate.named_pairs(state.pairs(), numeric)
        found["correlations"] = correlate.strong_correlations(df, columns, threshold, pairs)
    if fenced:
        limits = fences.outlier_bounds(df, columns, method, state)
        found["outliers"] = fences.outliers(df, columns, method, limits)
    if shaped:
        found["distributions"] = distribution.distributions(df, facts=facts_table(state))
        found["missing"] = distribution.missing(df, counts=null_table(state, named))
    if action == "profile":
        found["cardinality"] = distribution.cardinality(df, named)
    return Findings(shape, **{name: fixed(report) for name, report in found.items()})


def _items(kind: str, report: DataFrame, order: tuple, text: Column, weight: Column) -> DataFrame:
    first, second, third = order
    return report.select(
        F.lit(kind).alias("kind"),
        F.struct(
            first.cast("double").alias("a"),
            second.cast("int").alias("b"),
            third.cast("int").alias("c"),
            text.alias("text"),
        ).alias("item"),
        weight.cast("bigint").alias("weight"),
    )


def _by_strength():
    return -F.abs(half_even(F.col("r"), 3)), F.col("i"), F.col("j")


def _by_position():
    return F.col("col_pos"), F.lit(0), F.lit(0)


def _r_text() -> Column:
    return number_text(F.col("r"), 3)


def _first_items(kind: str, limit: int) -> Column:
    mine = F.collect_list(F.when(F.col("kind") == kind, F.col("item")))
    texts = F.transform(F.slice(F.array_sort(mine), 1, limit), lambda s: s["text"])
    return F.array_join(texts, ", ")


def summary(found: Findings) -> DataFrame:
    """One row: the shape, the first few findings of each section, and a sentence of them."""
    one = F.lit(1)
    parts = [
        found.shape.select(
            F.lit("shape").alias("kind"),
            F.lit(None).cast("struct<a:double,b:int,c:int,text:string>").alias("item"),
            F.lit(0).cast("bigint").alias("weight"),
        )
    ]
    if found.missing is not None:
        parts.append(_items("missing", found.missing, _by_position(), F.col("col_name"), one))
    if found.correlations is not None:
        pair = F.concat(F.col("col1"), F.lit("~"), F.col("col2"), F.lit(" (r="), _r_text(), F.lit(")"))
        parts.append(_items("pair", found.correlations, _by_strength(), pair, one))
    if found.outliers is not None:
        parts.append(
            _items("outlier", found.outliers, _by_position(), F.col("col_name"), F.col("count"))
        )
    if found.distributions is not None:
        skewed = found.distributions.where(
            F.abs(half_even(F.col("skewness"), 3)) > SKEW_WORTH_MENTION
        )
        parts.append(_items("skewed", skewed, _by_position(), F.col("col_name"), one))
    kinds = ("missing", "pair", "outlier", "skewed")
    totals = reduce(DataFrame.union, parts).agg(
        *[_first_items(k, SUMMARY_ITEMS).alias(k) for k in kinds],
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds],
        F.coalesce(F.sum(F.when(F.col("kind") == "outlier", F.col("weight"))), F.lit(0)).alias(
            "outlier_rows"
        ),
    )
    rows, cols, nums = found.shape.first()
    sentence = F.concat_ws(
        ". ",
        F.lit(f"dataset: {rows} rows x {cols} columns ({nums} numeric)"),
        F.when(F.col("n_missing") > 0, F.concat(F.lit("missing: "), "missing", F.lit(" ("), "n_missing", F.lit(" columns)"))),
        F.when(F.col("n_pair") > 0, F.concat(F.lit("strong correlation: "), "pair")),
        F.when(F.col("n_outlier") > 0, F.concat(F.lit("outliers: "), "outlier", F.lit(" ("), "outlier_rows", F.lit(" values)"))),
        F.when(F.col("n_skewed") > 0, F.concat(F.lit("skewed: "), "skewed")),
    )
    return totals.select(
        F.lit(rows).cast("bigint").alias("n_rows"),
        F.lit(cols).alias("n_cols"),
        F.lit(nums).alias("n_numeric"),
        F.col("missing").alias("missing_columns"),
        F.col("n_missing").alias("n_missing_columns"),
        F.col("pair").alias("top_correlations"),
        F.col("outlier").alias("outlier_columns"),
        F.col("outlier_rows").alias("n_outliers"),
        F.col("skewed").alias("skewed_columns"),
        F.concat(sentence, F.lit(".")).alias("summary"),
    )


def insights(found: Findings) -> DataFrame:
    """The two strongest pairs and the first two outlier columns, as sentences in order."""
    parts = []
    if found.correlations is not None:
        text = F.concat(
            F.col("col1"), F.lit(" and "), F.col("col2"), F.lit(": "), F.col("strength"),
            F.lit(" (r="), _r_text(), F.lit(")"),
        )
        top = found.correlations.orderBy(*_by_strength()).limit(INSIGHT_ITEMS)
        parts.append(_items("1_pair", top, _by_strength(), text, F.lit(1)))
    if found.outliers is not None:
        text = F.concat(
            F.col("col_name"), F.lit(": "), F.col("count").cast("string"), F.lit(" outliers ("),
            number_text(F.col("percent"), 1), F.lit("%) shift the mean by "),
            number_text(F.col("impact_pct"), 1), F.lit("%"),
        )
        top = found.outliers.orderBy("col_pos").limit(INSIGHT_ITEMS)
        parts.append(_items("2_outlier", top, _by_position(), text, F.lit(1)))
    if not parts:
        return found.shape.sparkSession.createDataFrame([], "rank int, insight string")
    ordered = F.array_sort(F.collect_list(F.struct("kind", "item")))
    return (
        reduce(DataFrame.union, parts)
        .agg(ordered.alias("all"))
        .select(F.posexplode("all").alias("rank", "entry"))
        .select((F.col("rank") + 1).alias("rank"), F.col("entry.item.text").alias("insight"))
    )


def alerts(found: Findings) -> DataFrame:
    """Compact form: summary sentence, and strong pairs plus outlier columns counted."""
    total = sum(r.count() for r in (found.correlations, found.outliers) if r is not None)
    return summary(found).select("summary", F.lit(total).cast("bigint").alias("alerts"))


def _melt(section: str, report: DataFrame, subject: Column, values: Sequence[str], label: Column):
    cells = [
        F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values
    ]
    return (
        report.select(subject.alias("subject"), label.alias("label"), F.explode(F.array(*cells)).alias("m"))
        .select(F.lit(section).alias("section"), "subject", "m.metric", "m.value", "label")
    )


def tidy(found: Findings) -> DataFrame:
    """Everything found as ``(section, subject, metric, value, label)``."""
    none = F.lit(None).cast("string")
    name = F.col("col_name")
    parts = [_melt("shape", found.shape, F.lit("table"), ["n_rows", "n_cols", "n_numeric"], none)]
    if found.correlations is not None:
        pair = F.concat_ws("~", "col1", "col2")
        parts.append(_melt("correlations", found.correlations, pair, ["r"], F.col("strength")))
        warning = correlate.multicollinearity_warning(found.correlations).where("warning")
        parts.append(
            _melt("multicollinearity", warning, F.lit("table"), ["strong_pairs"], F.lit("warning"))
        )
    if found.outliers is not None:
        metrics = ["count", "percent", "lower", "upper", "impact_pct"]
        parts.append(_melt("outliers", found.outliers, name, metrics, none))
    if found.distributions is not None:
        metrics = ["mean", "std", "skewness", "kurtosis", "min", "max"]
        parts.append(_melt("distributions", found.distributions, name, metrics, F.col("shape")))
    if found.missing is not None:
        parts.append(_melt("missing", found.missing, name, ["null_count", "percent"], none))
        pattern = distribution.missing_pattern(found.missing)
        parts.append(
            _melt("missing_pattern", pattern, F.lit("table"), ["spread"], F.col("pattern"))
        )
    if found.cardinality is not None:
        metrics = ["n_distinct", "ratio_pct"]
        parts.append(_melt("cardinality", found.cardinality, name, metrics, F.col("label")))
    return reduce(DataFrame.union, parts)
