"""Training metrics from run logs: extraction per line, results per run.

Log lines are ``(job_id, line_no, line)`` with ``line_no`` increasing in a run.
One run may own a large part of all lines: every per-run result is an aggregate
that combines in the map tasks, and "the last k lines" is a rank with a constant
limit, which Spark applies in each task before the shuffle.

Accuracies are percentages; values on a 0-1 scale are taken as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import log_patterns as P
from ..functions.columns import half_even
from ..functions.numbering import numbered
from ..session import cut_lineage

# Tail length and decision limits.
TRACE_TAIL = 100
LOG_TAIL = 50
RECENT = 3
# Spark limits a rank before the shuffle up to this length (its default).
GROUP_LIMIT = 1000
PLATEAU_RANGE = 1.0
FINISHED = ("completed", "failed")


def tail(lines: DataFrame, n: int = LOG_TAIL) -> DataFrame:
    """The last ``n`` lines of each run.

    A short tail is cut in each task before the shuffle. Spark does so up to a
    fixed length; for a longer one, line numbers alone are numbered in ranges and
    each run's lines are kept from the number where its tail begins.
    """
    if n < GROUP_LIMIT:
        newest = W.partitionBy("job_id").orderBy(F.desc("line_no"))
        ranked = lines.withColumn("from_end", F.row_number().over(newest))
        return ranked.where(F.col("from_end") <= n).drop("from_end")
    places = numbered(lines.select("job_id", "line_no"), "job_id", ["line_no"])
    sizes = places.groupBy("job_id").agg(F.max("nth").alias("n_lines"))
    begin = F.greatest(F.col("n_lines") - n + 1, F.lit(1))
    cuts = places.join(sizes, "job_id").where(F.col("nth") == begin)
    cuts = cuts.select("job_id", F.col("line_no").alias("from_line"))
    kept = lines.join(cuts, "job_id").where(F.col("line_no") >= F.col("from_line"))
    return kept.select(*lines.columns)


def finished_lines(
    lines: DataFrame, runs: DataFrame, n: int | None = TRACE_TAIL
) -> DataFrame:
    """Log lines of finished runs; a run whose log is blank gives its stored output.

    Tails are kept, ``n`` lines a run at most, because they are looked at twice.
    """
    done = runs.where(F.col("status").isin(*FINISHED))
    ended = done.select(F.col("id").alias("job_id"))
    logs = cut_lineage(tail(lines, n)) if n else lines
    logs = logs.join(ended, "job_id", "left_semi")
    written = logs.groupBy("job_id").agg(F.max(F.col("line").rlike(r"\S")).alias("has_text"))
    silent = done.join(
        written.where("has_text"), F.col("id") == F.col("job_id"), "left_anti"
    )
    # Spark 4.1 takes a union of two inputs hashed by the same key as hashed itself,
    # and fails when adaptive execution has merged the partitions of one of them.
    # A computed key keeps it from assuming that; the next step shuffles by run.
    stored = silent.select(
        F.concat("id", F.lit("")).alias("job_id"), F.posexplode(F.split("result.stdout", "\n"))
    ).select("job_id", (F.col("pos") + 1).cast("bigint").alias("line_no"), F.col("col").alias("line"))
    return logs.unionByName(stored)


def extract_metrics(lines: DataFrame) -> DataFrame:
    """Metrics of each line (first match of each pattern), other columns kept."""
    line = F.col("line")

    def cell(group: int, name: str) -> Column:
        return P.metric(line, "TP", P.CONFUSION, "bigint", group).alias(name)

    confusion = F.struct(cell(1, "tp"), cell(2, "fp"), cell(3, "fn"), cell(4, "tn"))
    return lines.select(
        *[c for c in lines.columns if c != "line"],
        P.metric(line, "poch", P.EPOCH, "bigint").alias("epoch"),
        P.metric(line, "oss", P.LOSS, "double").alias("loss"),
        P.metric(line, "cc", P.ACCURACY, "double").alias("accuracy"),
        F.when(confusion["tp"].isNotNull(), confusion).alias("confusion"),
        P.metric(line, "recision", P.PRECISION, "double").alias("precision"),
        P.metric(line, "ecall", P.RECALL, "double").alias("recall"),
        P.metric(line, "1", P.F1, "double").alias("f1"),
        P.metric(line, "eature", P.FEATURES, "bigint").alias("features_used"),
        P.metric(line, "aram", P.PARAMS, "bigint").alias("params"),
    )


# What ``extract_metrics`` finds on a line.
METRICS = ("epoch", "loss", "accuracy", "confusion", "precision", "recall", "f1", "features_used", "params")


def first_seen(name: str) -> Column:
    return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("line_no")))


def last_seen(name: str) -> Column:
    return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("line_no")))


def run_aggregates() -> list[Column]:
    """Per-run aggregates over extracted metrics; the stream uses the same ones."""
    return [
        F.max("epoch").alias("total_epochs"),
        first_seen("loss").alias("loss_first"),
        last_seen("loss").alias("loss_last"),
        first_seen("accuracy").alias("accuracy_first"),
        last_seen("accuracy").alias("accuracy_last"),
        F.max("accuracy").alias("accuracy_best"),
        last_seen("confusion").alias("confusion"),
        last_seen("precision").alias("precision"),
        last_seen("recall").alias("recall"),
        last_seen("f1").alias("f1"),
        last_seen("features_used").alias("features_used"),
        last_seen("params").alias("params"),
    ]


def loss_trend() -> Column:
    return F.when(F.col("loss_last") < F.col("loss_first"), "decreasing").when(
        F.col("loss_last").isNotNull(), "rising_or_flat"
    )


def recent_accuracies(metrics: DataFrame, n: int = RECENT) -> DataFrame:
    """The last ``n`` accuracy lines of each run, with ``from_end`` = 1 for the newest."""
    newest = W.partitionBy("job_id").orderBy(F.desc("line_no"))
    return (
        metrics.where(F.col("accuracy").isNotNull())
        .select("job_id", "line_no", "accuracy")
        .withColumn("from_end", F.row_number().over(newest))
        .where(F.col("from_end") <= n)
    )


def convergence(recent: DataFrame) -> DataFrame:
    """``(job_id, convergence)`` from the last three accuracies; NULL with fewer."""
    last = recent.groupBy("job_id").agg(latest_accuracies().alias("latest"))
    return last.select("job_id", convergence_of(F.col("latest")).alias("convergence"))


def latest_accuracies(n: int = RECENT) -> Column:
    """The last ``n`` accuracies of a group of few rows, newest first."""
    found = F.collect_list(F.when(F.col("accuracy").isNotNull(), F.struct("line_no", "accuracy")))
    return F.slice(F.sort_array(found, asc=False), 1, n)["accuracy"]


def convergence_of(latest: Column) -> Column:
    """What the last three accuracies, newest first, say."""
    spread = F.array_max(latest) - F.array_min(latest)
    return (
        F.when(F.size(latest) < RECENT, None)
        .when(spread < PLATEAU_RANGE, "plateau")
        .when(F.get(latest, F.lit(0)) > F.get(latest, F.lit(RECENT - 1)), "improving")
        .otherwise("overfitting")
    )


def decisive(metrics: DataFrame, n: int = RECENT) -> DataFrame:
    """The few metric lines of each run that its results depend on, found in the tasks that read them.

    These are, per task and run, the first and last line of each metric, those of
    the largest epoch and the best accuracy, and the last ``n`` with an accuracy.
    Aggregates over what is left give the same results as over all lines.
    """
    names = [c for c in metrics.columns if c not in ("job_id", "line_no")]

    def needed(table: pa.Table) -> pa.Table:
        job = table.column("job_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        line = table.column("line_no").to_numpy()
        order = np.lexsort((line, job))
        kept = np.zeros(len(table), bool)

        def ends(rows: np.ndarray, most: int) -> None:
            """The first row and the last few of each run among ordered rows."""
            fresh = np.append(True, job[rows][1:] != job[rows][:-1])
            kept[rows[fresh]] = True
            last = np.flatnonzero(np.append(fresh[1:], True))
            for k in range(most):
                kept[rows[np.maximum(last - k, 0)]] = True

        ends(order, 1)  # a run without any metric has a row, too
        for name in names:
            there = table.column(name).is_valid().to_numpy()
            rows = order[there[order]]
            if not len(rows):
                continue
            ends(rows, n if name == "accuracy" else 1)
            if name in ("epoch", "accuracy"):
                value = table.column(name).to_numpy()
                ends(rows[np.lexsort((value[rows], job[rows]))], 1)
        return table.filter(pa.array(kept))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, limit = None, 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            # What is held is looked through again when it has doubled.
            if len(held) > limit:
                held = needed(held)
                limit = 2 * len(held) + 50_000
        if held is not None and len(held):
            yield from needed(held).combine_chunks().to_batches()

    return metrics.mapInArrow(work, metrics.schema)


def trace(lines: DataFrame, runs: DataFrame | None = None, tail_lines: int | None = TRACE_TAIL) -> DataFrame:
    """One row per run: losses, accuracies, convergence, the last of every other metric.

    With ``runs``, finished runs only, their status beside; ``tail_lines=None``
    reads whole logs. A log is read and parsed once: tails are short, and of
    whole logs each task passes on the lines that decide alone.
    """
    if runs is not None:
        lines = finished_lines(lines, runs, tail_lines)
    elif tail_lines:
        lines = tail(lines, tail_lines)
    metrics = extract_metrics(lines)
    if not tail_lines:
        metrics = decisive(metrics.select("job_id", "line_no", *METRICS))
    results = metrics.groupBy("job_id").agg(*run_aggregates(), latest_accuracies().alias("latest"))
    results = results.withColumn("convergence", convergence_of(F.col("latest"))).drop("latest")
    if runs is not None:
        done = runs.where(F.col("status").isin(*FINISHED))
        results = done.select(F.col("id").alias("job_id"), "status").join(results, "job_id", "left")
    fallen = F.col("loss_last") < F.col("loss_first") * 0.5
    drop = F.try_divide(F.col("loss_last"), F.col("loss_first"))
    reduction = F.when(fallen, half_even((1 - drop) * 100, 0).cast("int"))
    return results.select(
        "job_id",
        *(["status"] if runs is not None else []),
        "total_epochs",
        half_even(F.col("loss_first"), 4).alias("loss_first"),
        half_even(F.col("loss_last"), 4).alias("loss_last"),
        loss_trend().alias("loss_trend"),
        reduction.alias("loss_reduction_pct"),
        half_even(F.col("accuracy_first"), 2).alias("accuracy_first"),
        half_even(F.col("accuracy_last"), 2).alias("accuracy_last"),
        half_even(F.col("accuracy_best"), 2).alias("accuracy_best"),
        "convergence",
        "confusion.tp",
        "confusion.fp",
        "confusion.fn",
        "confusion.tn",
        "precision",
        "recall",
        "f1",
        "features_used",
        "params",
        F.coalesce(
            F.nullif(
                F.concat_ws(
                    " ",
                    F.concat(F.lit("final accuracy "), F.col("accuracy_last").cast("string"), F.lit("%.")),
                    F.concat(F.lit("convergence: "), "convergence", F.lit(".")),
                    F.concat(F.lit("loss fell by "), reduction.cast("string"), F.lit("%.")),
                ),
                F.lit(""),
            ),
            F.lit("no metrics found"),
        ).alias("summary"),
    )


def compact_trace(traced: DataFrame) -> DataFrame:
    return traced.select(
        "job_id", "summary", F.col("accuracy_last").alias("accuracy"),
        F.coalesce("convergence", F.lit("unknown")).alias("convergence"),
    )
