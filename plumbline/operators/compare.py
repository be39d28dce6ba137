"""Comparison of successive runs: progress, best run, trend, when to stop.

Everything is grouped by ``experiment``, so one job compares any number of them.
An experiment may hold a large part of all runs: its rows are numbered in parts
that know how the part before them ended, not by a window over the experiment,
and the rest is one aggregate that combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import half_even, number_text
from ..functions.numbering import numbered_with_lags

# Decision limits.
TREND_STEP = 1
TARGET_ACCURACY = 95
CONVERGED_STEP = 1.0
DEGRADED_STEP = 5
MAX_ITERATIONS = 5


def experiment(spark: SparkSession, job_ids: str | Sequence[str], name: str = "experiment") -> DataFrame:
    """``(experiment, iteration, job_id)`` from an ordered list of run ids."""
    ids = job_ids.split(",") if isinstance(job_ids, str) else job_ids
    ids = [i for i in (j.strip() for j in ids) if i]
    if len(ids) < 2:
        raise ValueError("a comparison needs at least two run ids")
    return spark.createDataFrame(
        [(name, i, j) for i, j in enumerate(ids, 1)],
        "experiment string, iteration bigint, job_id string",
    )


def lagged(rows: DataFrame, depth: int) -> DataFrame:
    """The rows with ``nth``, the accuracies of the ``depth`` rows before each, and the last one that is there.

    Missing iterations leave no gap and repeated ones are rows of their own. A
    huge experiment is spread over parts, see ``numbered_with_lags``.
    """
    return numbered_with_lags(rows, "experiment", ["iteration", "job_id"], "accuracy", depth)


def iterations(
    experiments: DataFrame, traced: DataFrame, runs: DataFrame | None = None
) -> DataFrame:
    """The compared runs in order, each with its results and its change in accuracy.

    ``traced`` has one row per run. A run id that is unknown (to ``runs``, or to
    ``traced`` without it) has ``error`` = ``not_found`` and no results.
    """
    results = traced.select(
        "job_id",
        F.col("accuracy_last").alias("accuracy"),
        F.coalesce("convergence", F.lit("unknown")).alias("convergence"),
        "loss_first",
        "loss_last",
        "features_used",
        "tp",
        "fp",
        "fn",
        "tn",
        "total_epochs",
        F.lit(True).alias("known"),
    )
    if runs is not None:
        listed = runs.select(F.col("id").alias("job_id"), F.lit(True).alias("listed"))
        results = listed.join(results, "job_id", "left").withColumn(
            "known", F.col("listed")
        ).drop("listed")
    steps = lagged(experiments.join(results, "job_id", "left"), 2)
    delta = half_even(F.col("accuracy") - F.col("accuracy_1"), 2)
    earlier = half_even(F.col("accuracy_1") - F.col("accuracy_2"), 2)
    return steps.select(
        "experiment",
        "iteration",
        "nth",
        "job_id",
        "accuracy",
        delta.alias("accuracy_delta"),
        earlier.alias("previous_delta"),
        "accuracy_before",
        F.when(F.col("known"), F.coalesce("convergence", F.lit("unknown"))).alias("convergence"),
        "loss_first",
        "loss_last",
        "features_used",
        "tp",
        "fp",
        "fn",
        "tn",
        "total_epochs",
        F.when(F.col("known").isNull(), "not_found").alias("error"),
    )


def compare(table: DataFrame) -> DataFrame:
    """One row per experiment from ``iterations``: best run, trend, stop advice, summary.

    The summary names the first and last accuracy; ``comparison_lines`` has all.
    """
    acc, at = F.col("accuracy"), F.col("nth")
    valid_at = F.when(acc.isNotNull(), at)
    joined = table.groupBy("experiment").agg(
        F.count(F.lit(1)).alias("n_iterations"),
        F.count("accuracy").alias("n_valid"),
        F.max(F.when(acc.isNotNull(), F.struct(acc.alias("a"), (-at).alias("o"), F.col("iteration").alias("i")))).alias("best"),
        F.max_by(F.struct("accuracy_delta", "previous_delta"), at).alias("recent"),
        F.min_by("accuracy", valid_at).alias("first_accuracy"),
        F.max_by("accuracy", valid_at).alias("last"),
        F.max_by("accuracy_before", valid_at).alias("previous"),
    )
    last, previous = F.col("last"), F.col("previous")
    best_accuracy = F.coalesce(F.col("best.a"), F.lit(0.0))
    deltas = F.filter(
        F.array("recent.accuracy_delta", "recent.previous_delta"), lambda d: d.isNotNull()
    )
    settled = (F.size(deltas) > 0) & F.forall(deltas, lambda d: F.abs(d) < CONVERGED_STEP)
    rule = (
        F.when(best_accuracy >= TARGET_ACCURACY, "target_reached")
        .when(F.col("n_valid") >= 3, F.when(settled, "converged"))
        .when(last < previous - DEGRADED_STEP, "degraded")
    )
    stop = F.coalesce(rule, F.when(F.col("n_iterations") >= MAX_ITERATIONS, "max_iterations"))
    gain = F.coalesce("recent.accuracy_delta", F.lit(0.0))
    total = F.when(
        F.col("n_valid") >= 2, half_even(last - F.col("first_accuracy"), 2)
    ).otherwise(0.0)
    return joined.select(
        "experiment",
        "n_iterations",
        "n_valid",
        F.coalesce("best.i", F.lit(0)).alias("best_iteration"),
        best_accuracy.alias("best_accuracy"),
        F.when(F.col("n_valid") < 2, "unknown")
        .when(last > previous + TREND_STEP, "improving")
        .when(last < previous - TREND_STEP, "degrading")
        .otherwise("plateau")
        .alias("trend"),
        stop.isNotNull().alias("should_stop"),
        F.coalesce(stop, F.when(gain > 0, "improving").otherwise("keep_trying")).alias("reason"),
        total.alias("total_delta"),
        F.concat(
            F.col("n_iterations").cast("string"), F.lit(" iterations: "),
            _percent(F.col("first_accuracy")), F.lit(" -> "), _percent(last),
            F.lit(" (total "), number_text(total, 2, signed=True), F.lit("%p)"),
        ).alias("summary"),
    )


def _percent(accuracy):
    return F.coalesce(F.concat(number_text(accuracy, 2), F.lit("%")), F.lit("N/A"))


def comparison_lines(table: DataFrame) -> DataFrame:
    """``(experiment, line_no, text)``: the chain of accuracies from ``iterations``, a line per run."""
    return table.select("experiment", F.col("nth").alias("line_no"), _percent(F.col("accuracy")).alias("text"))


def compact_comparison(compared: DataFrame) -> DataFrame:
    return compared.select(
        "experiment", "summary", "best_accuracy", "trend", "should_stop", "reason"
    )
