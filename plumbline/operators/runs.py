"""Run and task records: lists, elapsed times, iteration reports, experiment reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import log_patterns as P
from ..functions.columns import clock_seconds, number_text
from ..session import cut_lineage
from .compare import lagged

# List and text lengths of the short task list.
NEWEST_TASKS = 20
DESCRIPTION_CHARS = 60


def run_list(runs: DataFrame, now: str | None = None) -> DataFrame:
    """Runs, newest first, with elapsed (finished) or running (not finished) seconds.

    ``now`` is a time as the records write it; the session's clock by default.
    """
    runs = runs.withColumn("now", F.lit(now) if now else F.localtimestamp())
    started, finished = clock_seconds(runs, "started_at"), clock_seconds(runs, "finished_at")
    return runs.select(
        "id",
        "name",
        "status",
        "submitted_at",
        "started_at",
        "finished_at",
        (finished - started).alias("elapsed_seconds"),
        F.when(
            finished.isNull() & (F.col("status") == "running"), clock_seconds(runs, "now") - started
        ).alias("running_seconds"),
    ).orderBy(F.desc("submitted_at"), "id")


def task_list(
    tasks: DataFrame, limit: int | None = NEWEST_TASKS, chars: int | None = DESCRIPTION_CHARS
) -> DataFrame:
    """Newest tasks: description (``chars`` of it), iterations done, accuracy of the last one."""
    table = tasks.select(
        "id",
        (F.col("task") if chars is None else F.substring("task", 1, chars)).alias("task"),
        "status",
        "submitted_at",
        F.coalesce(F.array_size("iterations"), F.lit(0)).alias("n_iterations"),
        F.try_element_at("iterations", F.lit(-1))["accuracy"].alias("current_accuracy"),
        F.when(F.col("status") == "completed", F.col("best_accuracy")).alias("best_accuracy"),
    )
    newest = table.orderBy(F.desc("submitted_at"), F.desc("id"))
    return newest if limit is None else newest.limit(limit)


def iteration_reports(transcripts: DataFrame) -> DataFrame:
    """What each transcript reports about its iteration; the first match of a field counts."""
    out = F.col("output")
    actions = P.captured(out, P.REPORT_ACTIONS)
    return transcripts.select(
        "task_id",
        "iteration",
        P.captured(out, P.REPORT_ACCURACY).try_cast("double").alias("accuracy"),
        F.coalesce(
            F.transform(F.split(actions, ","), lambda a: P.stripped(a)),
            F.array().cast("array<string>"),
        ).alias("actions"),
        P.captured(out, P.REPORT_JOB).alias("job_id"),
        P.captured(out, P.REPORT_FEATURES).try_cast("int").alias("features"),
        F.coalesce(F.lower(P.captured(out, P.REPORT_STOP)) == "true", F.lit(False)).alias(
            "should_stop"
        ),
        F.coalesce(P.stripped(P.captured(out, P.REPORT_REASON)), F.lit("")).alias("reason"),
        F.length(out).alias("raw_output_length"),
    )


def iteration_changes(reports: DataFrame) -> DataFrame:
    """Change of accuracy to the report before; a missing or zero side gives none."""
    steps = lagged(reports.withColumnRenamed("task_id", "experiment"), 1)
    change = F.col("accuracy") - F.col("accuracy_1")
    both = (F.col("accuracy") != 0) & (F.col("accuracy_1") != 0)
    return steps.select(
        F.col("experiment").alias("task_id"),
        *[c for c in reports.columns if c != "task_id"],
        "nth",
        F.when(both, change).alias("change"),
    )


def _totals(changes: DataFrame) -> DataFrame:
    rank = F.struct(F.coalesce("accuracy", F.lit(0.0)).alias("a"), (-F.col("nth")).alias("o"))
    best = F.max_by(F.struct("iteration", "accuracy"), rank)
    grouped = changes.groupBy("task_id").agg(F.count(F.lit(1)).alias("total_iterations"), best.alias("best"))
    return grouped.select(
        "task_id",
        "total_iterations",
        F.col("best.iteration").alias("best_iteration"),
        F.col("best.accuracy").alias("best_accuracy"),
    )


def experiment_report(reports: DataFrame) -> DataFrame:
    """Per task: its iterations and the best one; ``experiment_report_lines`` has the text."""
    return _totals(iteration_changes(reports))


def experiment_report_lines(reports: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """``(task_id, line_no, text)``: each task's report, a line per row.

    Line 0 sums the task up, with its data set and description if ``tasks`` has
    them; each iteration follows. No cell grows with the number of iterations.
    """
    changes = cut_lineage(iteration_changes(reports))
    totals = _totals(changes)
    if tasks is not None:
        named = tasks.select(F.col("id").alias("task_id"), "task", "dataset")
        totals = totals.join(named, "task_id", "left")
        about = F.concat_ws(": ", F.element_at(F.split("dataset", "/"), -1), "task")
    else:
        about = F.lit("")
    first = totals.select(
        "task_id",
        F.lit(0).cast("bigint").alias("line_no"),
        F.concat_ws(
            "; ",
            F.nullif(about, F.lit("")),
            F.concat(F.col("total_iterations").cast("string"), F.lit(" iterations")),
            F.concat(F.lit("best "), _accuracy("best_accuracy"), F.lit(" in iteration "), F.col("best_iteration").cast("string")),
        ).alias("text"),
    )
    each = changes.select(
        "task_id",
        F.col("nth").cast("bigint").alias("line_no"),
        F.concat_ws(
            "; ",
            F.concat(F.lit("iteration "), F.col("iteration").cast("string")),
            F.concat(
                _accuracy("accuracy"),
                F.coalesce(F.concat(F.lit(" ("), number_text(F.col("change"), 1, True), F.lit("%p)")), F.lit("")),
            ),
            F.nullif(F.array_join("actions", ", "), F.lit("")),
        ).alias("text"),
    )
    return first.unionByName(each)


def _accuracy(name: str):
    return F.coalesce(F.concat(number_text(F.col(name), 2), F.lit("%")), F.lit("no accuracy"))
