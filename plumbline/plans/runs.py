"""Run log, comparison, task and streaming queries.

The logs are derived from ``events``: 20 runs, with ``event_id`` as line number.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, diagnose, runlog, runs
from ..session import work_path
from ..streaming.run_metrics import RunBoard, windowed_metrics
from .diagnosis import RULES_USED, VERDICT_SQL, rules_table
from .registry import SQL, query, rounded, selected, table

# One text for both engines.
LINES_SQL = """
SELECT concat('job_', lpad(cast(user_id % 20 AS varchar(10)), 2, '0')) AS job_id, event_id AS line_no,
  CASE
    WHEN event_id % 50 = 0 THEN concat('TP: ', event_id % 97, ' FP: ', event_id % 13, ' FN: ', event_id % 17, ' TN: ', event_id % 89)
    WHEN event_id % 50 = 25 THEN concat('Precision: 0.', lpad(cast(event_id % 1000 AS varchar(10)), 3, '0'),
         ' Recall: 0.', lpad(cast(event_id * 7 % 1000 AS varchar(10)), 3, '0'),
         ' F1: 0.', lpad(cast(event_id * 11 % 1000 AS varchar(10)), 3, '0'),
         ' Features: ', 10 + event_id % 30, ' Params: 12,', lpad(cast(event_id % 1000 AS varchar(10)), 3, '0'))
    WHEN event_id % 41 = 0 THEN 'Epoch loss: 0.5. acc: bad'
    WHEN event_id % 43 = 0 THEN 'step loss=0.5 acc=0.9'
    WHEN event_id % 7 = 0 THEN 'checkpoint saved'
    ELSE concat('Epoch ', event_id, ' loss: 0.', lpad(cast(event_id * 7919 % 10000 AS varchar(10)), 4, '0'),
         ' acc: ', 40 + event_id % 59, '.', lpad(cast(event_id * 31 % 100 AS varchar(10)), 2, '0'), '%')
  END AS line
FROM events
"""
RUNS_SQL = """
SELECT concat('job_', lpad(cast(user_id % 20 AS varchar(10)), 2, '0')) AS id,
  concat('run ', user_id % 20) AS name,
  CASE WHEN user_id % 20 = 3 THEN 'running' WHEN user_id % 20 = 7 THEN 'failed' ELSE 'completed' END AS status,
  min(ts) AS submitted_at, min(ts) AS started_at,
  CASE WHEN user_id % 20 = 3 THEN NULL ELSE max(ts) END AS finished_at
FROM events GROUP BY user_id % 20
"""


def log_lines(spark, folder):
    return selected(spark, folder, LINES_SQL, "events")


def run_records(spark, folder):
    stored = F.struct(F.lit(0).alias("exit_code"), F.lit("").alias("stdout"), F.lit("").alias("stderr"))
    return selected(spark, folder, RUNS_SQL, "events").withColumn("result", stored)


METRICS_SQL = r"""
SELECT job_id, line_no,
  try_cast(nullif(regexp_extract(line, '[Ee]poch\s*[:\[]?\s*(\d+)', 1), '') AS BIGINT) AS epoch,
  try_cast(nullif(regexp_extract(line, '[Ll]oss[:\s]+([\d.]+)', 1), '') AS DOUBLE) AS loss,
  try_cast(nullif(regexp_extract(line, '[Aa]cc(?:uracy)?[:\s]+([\d.]+)%?', 1), '') AS DOUBLE) AS accuracy,
  CASE WHEN regexp_matches(line, 'TP[=:\s]+(\d+).*?FP[=:\s]+(\d+).*?FN[=:\s]+(\d+).*?TN[=:\s]+(\d+)')
    THEN line END AS cm,
  try_cast(nullif(regexp_extract(line, '[Pp]recision[=:\s]+([\d.]+)%?', 1), '') AS DOUBLE) AS precision,
  try_cast(nullif(regexp_extract(line, '[Rr]ecall[=:\s]+([\d.]+)%?', 1), '') AS DOUBLE) AS recall,
  try_cast(nullif(regexp_extract(line, '[Ff]1[=:\s]+([\d.]+)%?', 1), '') AS DOUBLE) AS f1,
  try_cast(nullif(regexp_extract(line, '[Ff]eatures?[=:\s]+(\d+)', 1), '') AS BIGINT) AS features_used,
  try_cast(replace(nullif(regexp_extract(line, '[Pp]arams?[=:\s]+([\d,]+)', 1), ''), ',', '') AS BIGINT) AS params
FROM lines
"""
CM = r"TP[=:\s]+(\d+).*?FP[=:\s]+(\d+).*?FN[=:\s]+(\d+).*?TN[=:\s]+(\d+)"


def confusion_sql(text: str) -> str:
    return ", ".join(
        f"try_cast(nullif(regexp_extract({text}, '{CM}', {g}), '') AS BIGINT) AS {n}"
        for g, n in enumerate(["tp", "fp", "fn", "tn"], 1)
    )


@query("extract_metrics", f"WITH lines AS ({LINES_SQL}), m AS ({METRICS_SQL}) SELECT * EXCLUDE (cm), {confusion_sql('cm')} FROM m")
def extract_metrics(spark, folder):
    metrics = runlog.extract_metrics(log_lines(spark, folder))
    return metrics.select("*", "confusion.*").drop("confusion")


def _pick(which: str, name: str) -> str:
    return f"arg_{which}({name}, line_no) FILTER (WHERE {name} IS NOT NULL)"


def results_sql(tail: int | None) -> str:
    """CTEs ``lines``, ``m`` and ``results``: one row per run, unrounded."""
    rank = "row_number() OVER (PARTITION BY job_id ORDER BY line_no DESC)"
    cut = f"QUALIFY {rank} <= {tail}" if tail else ""
    return f"""lines AS (SELECT * FROM ({LINES_SQL}) {cut}), m AS ({METRICS_SQL}),
    r AS (SELECT job_id, max(epoch) AS total_epochs,
        {_pick("min", "loss")} AS loss_first, {_pick("max", "loss")} AS loss_last,
        {_pick("min", "accuracy")} AS accuracy_first, {_pick("max", "accuracy")} AS accuracy_last,
        max(accuracy) AS accuracy_best, {_pick("max", "cm")} AS cm,
        {_pick("max", "precision")} AS precision, {_pick("max", "recall")} AS recall,
        {_pick("max", "f1")} AS f1, {_pick("max", "features_used")} AS features_used,
        {_pick("max", "params")} AS params
      FROM m GROUP BY job_id),
    last3 AS (SELECT job_id, accuracy, row_number() OVER (PARTITION BY job_id ORDER BY line_no DESC) AS k
              FROM m WHERE accuracy IS NOT NULL QUALIFY k <= 3),
    conv AS (SELECT job_id, CASE WHEN count(*) < 3 THEN NULL
        WHEN max(accuracy) - min(accuracy) < 1.0 THEN 'plateau'
        WHEN max(accuracy) FILTER (WHERE k = 1) > max(accuracy) FILTER (WHERE k = 3) THEN 'improving'
        ELSE 'overfitting' END AS convergence FROM last3 GROUP BY job_id),
    results AS (SELECT job_id, total_epochs, printf('%.4f', loss_first)::DOUBLE AS loss_first,
        printf('%.4f', loss_last)::DOUBLE AS loss_last,
        CASE WHEN loss_last < loss_first THEN 'decreasing'
             WHEN loss_last IS NOT NULL THEN 'rising_or_flat' END AS loss_trend,
        CASE WHEN loss_last < loss_first * 0.5
             THEN printf('%.0f', (1 - loss_last / loss_first) * 100)::DOUBLE::INTEGER END AS loss_reduction_pct,
        printf('%.2f', accuracy_first)::DOUBLE AS accuracy_first, printf('%.2f', accuracy_last)::DOUBLE AS accuracy_last,
        printf('%.2f', accuracy_best)::DOUBLE AS accuracy_best, convergence, {confusion_sql("cm")},
        precision, recall, f1, features_used, params
      FROM r LEFT JOIN conv USING (job_id))"""


@query("trace_runs", f"WITH {results_sql(None)} SELECT * FROM results")
def trace_runs(spark, folder):
    """Whole logs of all runs."""
    return runlog.trace(log_lines(spark, folder), tail_lines=None).drop("summary")


@query(
    "trace_finished_runs",
    f"""WITH {results_sql(100)}, runs AS ({RUNS_SQL})
        SELECT id AS job_id, status, results.* EXCLUDE (job_id) FROM runs LEFT JOIN results ON id = job_id
        WHERE status IN ('completed', 'failed')""",
)
def trace_finished_runs(spark, folder):
    """The last 100 lines of finished runs, as the trace action reads them."""
    traced = runlog.trace(log_lines(spark, folder), run_records(spark, folder))
    return traced.drop("summary")


@query(
    "trace_compact",
    f"""WITH {results_sql(100)}
        SELECT job_id, accuracy_last AS accuracy, coalesce(convergence, 'unknown') AS convergence FROM results""",
)
def trace_compact(spark, folder):
    return runlog.compact_trace(runlog.trace(log_lines(spark, folder))).drop("summary")


@query(
    "log_tail",
    f"""SELECT job_id, line_no, line FROM ({LINES_SQL})
        QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY line_no DESC) <= 50""",
)
def log_tail(spark, folder):
    return runlog.tail(log_lines(spark, folder))


@query(
    "run_list",
    f"""SELECT id, name, status, round(epoch(finished_at) - epoch(started_at), 3) AS elapsed_seconds,
          CASE WHEN status = 'running'
            THEN round(epoch(TIMESTAMP '2025-01-01 00:00:00') - epoch(started_at), 3) END AS running_seconds
        FROM ({RUNS_SQL})""",
)
def run_list(spark, folder):
    listed = runs.run_list(run_records(spark, folder), now="2025-01-01T00:00:00")
    return rounded(listed.drop("submitted_at", "started_at", "finished_at"), 3)


def report_for(job_id: str) -> str:
    return f"""WITH {results_sql(None)}, verdict AS ({VERDICT_SQL})
      SELECT verdict.*, '{job_id}' AS job_id, accuracy_last AS accuracy,
        coalesce(convergence, 'unknown') AS convergence, loss_trend, tp, fp, fn, tn, features_used
      FROM verdict LEFT JOIN (SELECT * FROM results WHERE job_id = '{job_id}') ON true"""


@query("diagnosis_report", report_for("job_05"))
def diagnosis_report(spark, folder):
    """The data verdict joined to the results of one run."""
    traced = runlog.trace(log_lines(spark, folder), tail_lines=None)
    found = diagnose.diagnose(rules_table(spark, folder), ",".join(RULES_USED), lengths=diagnose.SHORT)
    return diagnose.diagnosis_report(found, traced, "job_05")


@query(
    "diagnosis_compact",
    f"""SELECT severity, summary, n_recommendations, accuracy, convergence
        FROM ({report_for("job_11")})""",
)
def diagnosis_compact(spark, folder):
    traced = runlog.trace(log_lines(spark, folder), tail_lines=None)
    found = diagnose.diagnose(rules_table(spark, folder), ",".join(RULES_USED), lengths=diagnose.SHORT)
    return diagnose.compact_diagnosis(diagnose.diagnosis_report(found, traced, "job_11"))


@query("log_tail_long", f"""SELECT job_id, line_no, line FROM (SELECT *, row_number() OVER
       (PARTITION BY job_id ORDER BY line_no DESC) AS k FROM ({LINES_SQL})) WHERE k <= 2000""")
def log_tail_long(spark, folder):
    return runlog.tail(log_lines(spark, folder), 2000)


@query(
    "trace_summary",
    f"""WITH {results_sql(None)} SELECT job_id, coalesce(nullif(concat_ws(' ',
          'final accuracy ' || accuracy_last || '%.', 'convergence: ' || convergence || '.',
          CASE WHEN loss_last < loss_first * 0.5
            THEN 'loss fell by ' || round_even((1 - loss_last / loss_first) * 100, 0)::INT || '%.' END), ''),
          'no metrics found') AS summary FROM results""",
)
def trace_summary(spark, folder):
    return runlog.trace(log_lines(spark, folder), tail_lines=None).select("job_id", "summary")


# Experiments of three runs; the third run of the last is unknown.
EXPERIMENTS_SQL = """
SELECT DISTINCT concat('exp_', lpad(cast((user_id % 20 - user_id % 20 % 3) / 3 AS varchar(10)), 2, '0')) AS experiment,
  cast(user_id % 20 % 3 + 1 AS bigint) AS iteration,
  CASE WHEN user_id % 20 = 10 THEN 'lost' ELSE
    concat('job_', lpad(cast(user_id % 20 AS varchar(10)), 2, '0')) END AS job_id
FROM events
"""
EXPERIMENTS_SQL = EXPERIMENTS_SQL.replace("(user_id % 20 - user_id % 20 % 3) / 3", "cast(floor(user_id % 20 / 3) AS int)")

ITERATIONS_SQL = f"""{results_sql(None)}, experiments AS ({EXPERIMENTS_SQL}),
  steps AS (SELECT experiment, iteration, e.job_id, accuracy_last AS accuracy, results.* EXCLUDE (job_id),
      CASE WHEN results.job_id IS NULL THEN 'not_found' END AS error
    FROM experiments e LEFT JOIN results ON e.job_id = results.job_id),
  its AS (SELECT *, printf('%.2f', accuracy - lag(accuracy) OVER o)::DOUBLE AS accuracy_delta,
      printf('%.2f', lag(accuracy) OVER o - lag(accuracy, 2) OVER o)::DOUBLE AS previous_delta
    FROM steps WINDOW o AS (PARTITION BY experiment ORDER BY iteration))"""


@query(
    "compare_iterations",
    f"""WITH {ITERATIONS_SQL} SELECT experiment, iteration, job_id, accuracy, accuracy_delta, previous_delta,
          CASE WHEN error IS NULL THEN coalesce(convergence, 'unknown') END AS convergence,
          loss_first, loss_last, features_used, tp, fp, fn, tn, total_epochs, error FROM its""",
)
def compare_iterations(spark, folder):
    traced = runlog.trace(log_lines(spark, folder), tail_lines=None)
    return compare.iterations(selected(spark, folder, EXPERIMENTS_SQL, "events"), traced).drop("nth", "accuracy_before")


@query(
    "compare_lines",
    f"""WITH {ITERATIONS_SQL} SELECT experiment, row_number() OVER (PARTITION BY experiment ORDER BY iteration) AS line_no,
          CASE WHEN accuracy IS NULL THEN 'N/A' ELSE printf('%.2f', accuracy) || '%' END AS text FROM its""",
)
def compare_lines(spark, folder):
    """The chain of accuracies of each experiment, a line per run."""
    traced = runlog.trace(log_lines(spark, folder), tail_lines=None)
    return compare.comparison_lines(compare.iterations(selected(spark, folder, EXPERIMENTS_SQL, "events"), traced))


# Experiments of 1 to 6 runs with gaps, repeated iterations and unknown runs, one run per order.
STEPS_SQL = """
SELECT concat('exp_', o_custkey) AS experiment, cast(floor(o_orderkey / 3) AS bigint) AS iteration,
  concat('run_', o_orderkey) AS job_id, CASE WHEN o_orderkey % 9 = 0 THEN NULL
    WHEN o_custkey % 5 = 0 THEN cast(60 + o_orderkey % 3 AS double) * 1.0 ELSE cast(40 + o_orderkey % 53 AS double) END AS accuracy
FROM orders
"""


@query(
    "compare_gaps",
    f"""WITH s AS ({STEPS_SQL}), its AS (SELECT *, row_number() OVER o AS nth, lag(accuracy) OVER o AS p1, lag(accuracy, 2) OVER o AS p2
        FROM s WINDOW o AS (PARTITION BY experiment ORDER BY iteration, job_id)),
      g AS (SELECT experiment, count(*) AS n_iterations, count(accuracy) AS n_valid, coalesce(max(accuracy), 0) AS best_accuracy,
        arg_max(coalesce(accuracy - p1, -9999), nth) AS d1, arg_max(coalesce(p1 - p2, -9999), nth) AS d2,
        list(accuracy ORDER BY nth) FILTER (accuracy IS NOT NULL) AS a FROM its GROUP BY experiment),
      r AS (SELECT *, nullif(d1, -9999) AS e1, nullif(d2, -9999) AS e2, a[-1] AS last, a[-2] AS previous FROM g),
      t AS (SELECT *, CASE WHEN best_accuracy >= 95 THEN 'target_reached'
          WHEN n_valid >= 3 THEN CASE WHEN (e1 IS NOT NULL OR e2 IS NOT NULL)
              AND coalesce(abs(e1) < 1, true) AND coalesce(abs(e2) < 1, true) THEN 'converged' END
          WHEN last < previous - 5 THEN 'degraded' END AS rule FROM r)
    SELECT experiment, n_iterations, n_valid, best_accuracy, rule IS NOT NULL OR n_iterations >= 5 AS should_stop,
      coalesce(rule, CASE WHEN n_iterations >= 5 THEN 'max_iterations' WHEN coalesce(e1, 0) > 0 THEN 'improving'
        ELSE 'keep_trying' END) AS reason,
      CASE WHEN n_valid >= 2 THEN last - a[1] ELSE 0 END AS total_delta FROM t""",
)
def compare_gaps(spark, folder):
    """Neighbours are the rows before, whatever their iteration numbers."""
    steps = selected(spark, folder, STEPS_SQL, "orders")
    known = steps.select("job_id", F.col("accuracy").alias("accuracy_last"))
    empty = {c: F.lit(None).cast("double") for c in ("loss_first", "loss_last", "features_used", "tp", "fp", "fn", "tn")}
    traced = known.withColumns(empty | {"convergence": F.lit("plateau"), "total_epochs": F.lit(1)})
    compared = compare.compare(compare.iterations(steps.drop("accuracy"), traced))
    return compared.select("experiment", "n_iterations", "n_valid", "best_accuracy", "should_stop", "reason", "total_delta")


@query(
    "compare_runs",
    f"""WITH {ITERATIONS_SQL},
      v AS (SELECT experiment, accuracy, row_number() OVER (PARTITION BY experiment ORDER BY iteration DESC) AS k
            FROM its WHERE accuracy IS NOT NULL),
      g AS (SELECT experiment, max(iteration) AS n_iterations, count(accuracy) AS n_valid,
          coalesce(max(accuracy), 0) AS best_accuracy,
          arg_max(accuracy_delta, iteration) AS d1_or, arg_min(accuracy, iteration) AS first_accuracy,
          count(*) AS n_rows
        FROM its GROUP BY experiment),
      d AS (SELECT its.experiment, accuracy_delta AS d1, previous_delta AS d2 FROM its JOIN g
            ON its.experiment = g.experiment AND its.iteration = g.n_iterations),
      best AS (SELECT its.experiment, min(iteration) AS best_iteration FROM its JOIN g
               ON its.experiment = g.experiment AND its.accuracy = g.best_accuracy GROUP BY its.experiment),
      e AS (SELECT g.*, d1, d2, coalesce(best_iteration, 0) AS best_iteration,
          (SELECT accuracy FROM v WHERE v.experiment = g.experiment AND k = 1) AS last,
          (SELECT accuracy FROM v WHERE v.experiment = g.experiment AND k = 2) AS previous
        FROM g JOIN d USING (experiment) LEFT JOIN best USING (experiment)),
      s AS (SELECT *, CASE WHEN best_accuracy >= 95 THEN 'target_reached'
          WHEN n_valid >= 3 THEN CASE WHEN (d1 IS NOT NULL OR d2 IS NOT NULL)
              AND coalesce(abs(d1) < 1, true) AND coalesce(abs(d2) < 1, true) THEN 'converged' END
          WHEN last < previous - 5 THEN 'degraded' END AS rule,
          CASE WHEN n_valid >= 2 THEN printf('%.2f', last - first_accuracy)::DOUBLE ELSE 0 END AS total_delta FROM e)
    SELECT experiment, n_iterations, n_valid, best_iteration, best_accuracy,
      CASE WHEN n_valid < 2 THEN 'unknown' WHEN last > previous + 1 THEN 'improving'
        WHEN last < previous - 1 THEN 'degrading' ELSE 'plateau' END AS trend,
      rule IS NOT NULL OR n_iterations >= 5 AS should_stop,
      coalesce(rule, CASE WHEN n_iterations >= 5 THEN 'max_iterations'
        WHEN coalesce(d1, 0) > 0 THEN 'improving' ELSE 'keep_trying' END) AS reason,
      total_delta,
      n_iterations || ' iterations: ' || CASE WHEN first_accuracy IS NULL THEN 'N/A -> N/A' ELSE printf('%.2f', first_accuracy) || '% -> ' || printf('%.2f', last) || '%' END || ' (total ' || printf('%+.2f', total_delta) || '%p)' AS summary
    FROM s""",
)
def compare_runs(spark, folder):
    traced = runlog.trace(log_lines(spark, folder), tail_lines=None)
    return compare.compare(compare.iterations(selected(spark, folder, EXPERIMENTS_SQL, "events"), traced))


TRANSCRIPTS_SQL = r"""
SELECT concat('task_', cast(floor(o_orderkey / 4) AS int)) AS task_id, cast(o_orderkey % 4 AS int) AS iteration,
  concat('=== ITERATION ', o_orderkey % 4, ' COMPLETE ===', chr(10),
    CASE WHEN o_orderkey % 11 = 0 THEN 'Accuracy: unknown' ELSE concat('Accuracy: ', 50 + o_custkey % 49, '.', lpad(cast(o_custkey * 7 % 100 AS varchar(10)), 2, '0'), '%') END, chr(10),
    'Actions: drop_redundant,  ', lower(o_orderpriority), chr(10),
    'Job ID: job', o_orderkey, chr(10),
    CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE concat('Features: ', o_custkey % 40, chr(10)) END,
    'Should Stop: ', CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'false' END, chr(10),
    'Reason: status ', o_orderstatus, chr(10), '===') AS output
FROM orders
"""
REPORTS_SQL = r"""
SELECT task_id, iteration,
  try_cast(nullif(regexp_extract(output, 'Accuracy:\s*([\d.]+)%', 1), '') AS DOUBLE) AS accuracy,
  list_transform(string_split(nullif(regexp_extract(output, 'Actions:\s*(.+)', 1), ''), ','), lambda a: trim(a)) AS actions,
  nullif(regexp_extract(output, 'Job ID:\s*(\S+)', 1), '') AS job_id,
  try_cast(nullif(regexp_extract(output, 'Features:\s*(\d+)', 1), '') AS INTEGER) AS features,
  coalesce(lower(nullif(regexp_extract(output, '(?i)Should Stop:\s*(true|false)', 1), '')) = 'true', false) AS should_stop,
  trim(regexp_extract(output, 'Reason:\s*(.+)', 1)) AS reason
FROM (""" + TRANSCRIPTS_SQL + ")"


def transcripts(spark, folder):
    return selected(spark, folder, TRANSCRIPTS_SQL, "orders")


@query(
    "iteration_reports",
    f"SELECT * REPLACE (array_to_string(actions, '|') AS actions) FROM ({REPORTS_SQL})",
)
def iteration_reports(spark, folder):
    reports = runs.iteration_reports(transcripts(spark, folder))
    return reports.withColumn("actions", F.array_join("actions", "|")).drop("raw_output_length")


CHANGES_SQL = f"""SELECT *, CASE WHEN accuracy <> 0 AND p <> 0 THEN accuracy - p END AS change FROM
  (SELECT *, lag(accuracy) OVER (PARTITION BY task_id ORDER BY iteration) AS p FROM ({REPORTS_SQL}))"""


@query(
    "experiment_report",
    f"""WITH c AS ({CHANGES_SQL}), g AS (SELECT task_id, count(*) AS total_iterations,
        arg_max(iteration, coalesce(accuracy, 0) * 1000 - iteration) AS best_iteration,
        arg_max(coalesce(accuracy, -1), coalesce(accuracy, 0) * 1000 - iteration) AS best
      FROM c GROUP BY task_id)
    SELECT task_id, total_iterations, best_iteration, nullif(best, -1) AS best_accuracy
    FROM g""",
)
def experiment_report(spark, folder):
    return runs.experiment_report(runs.iteration_reports(transcripts(spark, folder)))


@query(
    "experiment_report_lines",
    f"""WITH c AS ({CHANGES_SQL}), g AS (SELECT task_id, count(*) AS total_iterations,
        arg_max(iteration, coalesce(accuracy, 0) * 1000 - iteration) AS best_iteration,
        arg_max(coalesce(accuracy, -1), coalesce(accuracy, 0) * 1000 - iteration) AS best FROM c GROUP BY task_id)
    SELECT task_id, 0 AS line_no, total_iterations || ' iterations; best '
      || CASE WHEN best = -1 THEN 'no accuracy' ELSE printf('%.2f', best) || '%' END || ' in iteration ' || best_iteration AS text FROM g
    UNION ALL SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY iteration), 'iteration ' || iteration || '; '
      || CASE WHEN accuracy IS NULL THEN 'no accuracy' ELSE printf('%.2f', accuracy) || '%' END
      || CASE WHEN change IS NULL THEN '' ELSE ' (' || printf('%+.1f', change) || '%p)' END
      || '; ' || array_to_string(actions, ', ') FROM c""",
)
def experiment_report_lines(spark, folder):
    return runs.experiment_report_lines(runs.iteration_reports(transcripts(spark, folder)))


@query(
    "experiment_report_header",
    f"""SELECT l.task_id, l.line_no,
          CASE WHEN line_no = 0 AND status IS NOT NULL THEN 'part' || k % 5 || '.csv: study ' || status || '; ' ELSE '' END || text AS text
        FROM ({SQL["experiment_report_lines"]}) l LEFT JOIN
          (SELECT 'task_' || (o_orderkey // 4) AS task_id, o_orderkey // 4 AS k, min(o_orderstatus) AS status
           FROM orders WHERE o_orderkey // 4 % 3 > 0 GROUP BY ALL) t ON t.task_id = l.task_id""",
)
def experiment_report_header(spark, folder):
    """Reports that begin with the data set and the description of tasks that have them."""
    number = F.floor(F.col("o_orderkey") / 4)
    tasks = table(spark, folder, "orders").groupBy(number.alias("k")).agg(F.min("o_orderstatus").alias("status"))
    tasks = tasks.where("k % 3 > 0").select(
        F.concat(F.lit("task_"), "k").alias("id"),
        F.concat(F.lit("study "), "status").alias("task"),
        F.concat(F.lit("/data/sets/part"), F.col("k") % 5, F.lit(".csv")).alias("dataset"),
    )
    return runs.experiment_report_lines(runs.iteration_reports(transcripts(spark, folder)), tasks)


@query(
    "task_list",
    """SELECT 'task_' || o_orderkey AS id,
         substr(repeat('explore ' || o_orderpriority || ' ', 8), 1, 60) AS task,
         CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'running' END AS status,
         o_orderdate AS submitted_at, n::INTEGER AS n_iterations, last AS current_accuracy,
         CASE WHEN o_orderstatus = 'F' THEN best END AS best_accuracy
       FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_quantity) AS best,
           arg_max(l_quantity, l_linenumber * 1000 + l_quantity) AS last FROM lineitem GROUP BY l_orderkey)
         ON l_orderkey = o_orderkey
       WHERE n IS NOT NULL
       ORDER BY submitted_at DESC, id DESC LIMIT 20""",
)
def task_list(spark, folder):
    """Orders as tasks and their lines as iterations."""
    lines = table(spark, folder, "lineitem")
    step = F.struct(F.col("l_linenumber").alias("iteration"), F.col("l_quantity").alias("accuracy"))
    done = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_list(step)).alias("iterations"), F.max("l_quantity").alias("best_accuracy")
    )
    tasks = table(spark, folder, "orders").join(done, "o_orderkey").select(
        F.concat(F.lit("task_"), "o_orderkey").alias("id"),
        F.repeat(F.concat(F.lit("explore "), "o_orderpriority", F.lit(" ")), 8).alias("task"),
        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"),
        F.col("o_orderdate").alias("submitted_at"),
        "iterations",
        "best_accuracy",
    )
    return runs.task_list(tasks)


LIVE_COLUMNS = """job_id, total_epochs, loss_first, loss_last, loss_trend, accuracy_first, accuracy_last,
    accuracy_best, tp, fp, fn, tn, precision, recall, f1, features_used, params"""


def event_stream(spark, folder):
    """``events`` as a file stream, with lines as in ``LINES_SQL``."""
    schema = table(spark, folder, "events").schema
    stream = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    )
    text = LINES_SQL.split("AS line_no,", 1)[1].rsplit("AS line\n", 1)[0]
    job = LINES_SQL.split("SELECT", 1)[1].split(" AS job_id", 1)[0]
    return stream.select(
        "ts", F.expr(job).alias("job_id"), F.col("event_id").alias("line_no"), F.expr(text).alias("line")
    )


@query("stream_run_metrics", f"WITH {results_sql(None)} SELECT {LIVE_COLUMNS}, convergence FROM results")
def stream_run_metrics(spark, folder):
    """Live metrics and convergence kept by two streams; equal to the batch trace."""
    board = RunBoard(spark)
    lines = event_stream(spark, folder)
    for stream in (board.start_metrics(lines.drop("ts")), board.start_recent(lines.drop("ts"))):
        stream.awaitTermination()
    live = board.metrics().join(board.convergence(), "job_id", "left")
    return live.select("*", "confusion.*").select(
        *[c.strip() for c in LIVE_COLUMNS.split(",")], "convergence"
    )


@query(
    "live_metrics_by_day",
    f"""WITH lines AS (SELECT l.*, e.ts FROM ({LINES_SQL}) l JOIN events e ON e.event_id = l.line_no),
        m AS (SELECT x.*, lines.ts FROM ({METRICS_SQL}) x JOIN lines USING (line_no))
      SELECT strftime(ts, '%Y-%m-%d') AS day, m.job_id, max(epoch) AS total_epochs,
        {_pick("max", "loss")} AS loss_last, {_pick("max", "accuracy")} AS accuracy_last
      FROM m GROUP BY ALL""",
)
def live_metrics_by_day(spark, folder):
    """The windowed form, run in batch over the whole table."""
    lines = log_lines(spark, folder).join(
        table(spark, folder, "events").select(F.col("event_id").alias("line_no"), "ts"), "line_no"
    )
    return windowed_metrics(lines).select(
        F.date_from_unix_date((F.unix_seconds("during.start") / 86400).cast("int"))
        .cast("string")
        .alias("day"),
        "job_id",
        "total_epochs",
        "loss_last",
        "accuracy_last",
    )


@query(
    "stream_windows",
    f"""WITH lines AS (SELECT l.*, e.ts FROM ({LINES_SQL}) l JOIN events e ON e.event_id = l.line_no),
        m AS (SELECT x.*, lines.ts FROM ({METRICS_SQL}) x JOIN lines USING (line_no))
      SELECT strftime(ts, '%Y-%m-%d') AS day, m.job_id, max(epoch) AS total_epochs,
        {_pick("max", "loss")} AS loss_last, {_pick("max", "accuracy")} AS accuracy_last
      FROM m WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""",
)
def stream_windows(spark, folder):
    """The stream's closed windows, each written once its day can't change any more."""
    path = work_path(spark, "stream-windows")
    stream = windowed_metrics(event_stream(spark, folder)).writeStream.outputMode("append").format("parquet")
    stream = stream.option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path)
    stream.awaitTermination()
    closed = spark.read.parquet(path)
    day = F.date_from_unix_date((F.unix_seconds("during.start") / 86400).cast("int")).cast("string")
    return closed.select(day.alias("day"), "job_id", "total_epochs", "loss_last", "accuracy_last")
