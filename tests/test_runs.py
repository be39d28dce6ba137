"""Run logs, comparison rules, task reports, streaming."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions.numbering import numbered_with_lags
from plumbline.operators import compare, diagnose, runlog, runs
from plumbline.streaming.run_metrics import RunBoard, live_metrics, windowed_metrics


def log(spark, **jobs):
    lines = [(j, i, text) for j, block in jobs.items() for i, text in enumerate(block.splitlines(), 1)]
    return spark.createDataFrame(lines, "job_id string, line_no bigint, line string")


def one(spark, text):
    return runlog.trace(log(spark, a=text)).first()


def test_patterns_of_one_line(spark):
    lines = """Epoch [3/10] loss: 0.5312, Acc: 81.5%
epoch 4 val_loss: 0.25 accuracy 90
loss=0.1 acc=0.9
TP: 5 FP: 1 FN=2 TN 9
Precision: 0.91 Recall=88% F1: 0.9
Features: 33 Params: 1,234,567
loss: 0.5. acc: 1.2.3 epoch: 5
nothing here"""
    rows = {r.line_no: r for r in runlog.extract_metrics(log(spark, a=lines)).collect()}
    assert (rows[1].epoch, rows[1].loss, rows[1].accuracy) == (3, 0.5312, 81.5)
    assert (rows[2].epoch, rows[2].loss, rows[2].accuracy) == (4, 0.25, 90)
    assert rows[3].loss is None and rows[3].accuracy is None
    assert tuple(rows[4].confusion) == (5, 1, 2, 9)
    assert (rows[5].precision, rows[5].recall, rows[5].f1) == (0.91, 88, 0.9)
    assert (rows[6].features_used, rows[6].params) == (33, 1234567)
    assert rows[7].loss is None and rows[7].accuracy is None and rows[7].epoch == 5
    assert all(v is None for k, v in rows[8].asDict().items() if k not in ("job_id", "line_no"))


@pytest.mark.parametrize(
    "accuracies, verdict",
    [
        ("80 80.5 80.9", "plateau"),
        ("50 80 82 85", "improving"),
        ("50 90 88 85", "overfitting"),
        ("0.5 0.7 0.95", "plateau"),
        ("80 90", None),
    ],
)
def test_convergence(spark, accuracies, verdict):
    text = "\n".join(f"acc: {a}" for a in accuracies.split())
    assert one(spark, text).convergence == verdict


def test_trace_values(spark):
    r = one(spark, "Epoch 1 loss: 0.8 acc: 50\nEpoch 2 loss: 0.41 acc: 70.126\nEpoch 3 loss: 0.2 acc: 69\nPrecision: 0.5\nPrecision: 0.6")
    assert (r.total_epochs, r.loss_first, r.loss_last, r.loss_trend) == (3, 0.8, 0.2, "decreasing")
    assert (r.accuracy_first, r.accuracy_last, r.accuracy_best) == (50, 69, 70.13)
    assert (r.loss_reduction_pct, r.precision, r.tp) == (75, 0.6, None)
    assert r.summary.startswith("final accuracy 69.0%. convergence: ")
    empty = one(spark, "hello")
    assert empty.summary == "no metrics found" and empty.loss_trend is None
    assert one(spark, "loss: 1\nloss: 1").loss_trend == "rising_or_flat"


def test_tail_and_stored_output(spark):
    lines = log(spark, a="\n".join(f"Epoch {i} acc: {i}" for i in range(150)), blank=" \n\t\n", running="acc: 1")
    records = spark.createDataFrame(
        [
            ("a", "completed", (0, "", "")),
            ("blank", "failed", (1, "acc: 5\nacc: 6", "")),
            ("unlogged", "completed", (0, "acc: 7", "")),
            ("running", "running", None),
        ],
        "id string, status string, result struct<exit_code:int,stdout:string,stderr:string>",
    )
    got = {r.job_id: r for r in runlog.trace(lines, records).collect()}
    assert set(got) == {"a", "blank", "unlogged"}
    assert (got["a"].accuracy_first, got["a"].accuracy_last) == (50, 149)
    assert (got["blank"].accuracy_first, got["blank"].accuracy_last) == (5, 6)
    assert got["unlogged"].accuracy_last == 7
    assert runlog.trace(lines, records, None).where("job_id = 'a'").first().accuracy_first == 0
    assert runlog.tail(lines, 1000).where("job_id = 'a'").count() == 150
    assert runlog.tail(lines, 5).where("job_id = 'a'").count() == 5
    long = spark.range(5000).selectExpr("concat('j', id % 2) AS job_id", "id * 3 AS line_no", "'x' AS line")
    kept = runlog.tail(long, 2000).groupBy("job_id").agg(F.count("*").alias("n"), F.min("line_no").alias("m")).collect()
    assert {r.job_id: (r.n, r.m) for r in kept} == {"j0": (2000, 3000), "j1": (2000, 3003)}
    assert runlog.compact_trace(runlog.trace(lines)).where("job_id = 'running'").first().convergence == "unknown"


def compared(spark, *accuracies):
    experiments = compare.experiment(spark, ",".join(f"j{i}" for i in range(len(accuracies))))
    traced = runlog.trace(
        log(spark, **{f"j{i}": f"acc: {a}" if a is not None else "none" for i, a in enumerate(accuracies)})
    )
    return compare.iterations(experiments, traced)


@pytest.mark.parametrize(
    "accuracies, trend, stop, reason",
    [
        ((96, 94), "degrading", True, "target_reached"),
        ((80, 80.5, 81), "plateau", True, "converged"),
        ((80, 70), "degrading", True, "degraded"),
        ((60, 80, 70), "degrading", False, "keep_trying"),
        ((60, 70, 60, 70, 80), "improving", True, "max_iterations"),
        ((60, 70), "improving", False, "improving"),
        ((60, None, 60.5), "plateau", False, "keep_trying"),
        ((None, None), "unknown", False, "keep_trying"),
        ((60, None, 90, 90.5), "plateau", True, "converged"),
        ((60, 60.5, 90, None), "improving", False, "keep_trying"),
    ],
)
def test_stop_rules(spark, accuracies, trend, stop, reason):
    r = compare.compare(compared(spark, *accuracies)).first()
    assert (r.trend, r.should_stop, r.reason) == (trend, stop, reason)


def test_comparison_with_gaps_and_ties(spark):
    table = compared(spark, 70, None, 80, 80)
    steps = {r.iteration: r for r in table.collect()}
    assert [steps[i].accuracy_delta for i in (1, 2, 3, 4)] == [None, None, None, 0]
    r = compare.compare(table).first()
    assert (r.best_iteration, r.best_accuracy, r.n_valid, r.total_delta) == (3, 80, 3, 10)
    assert r.summary == "4 iterations: 70.00% -> 80.00% (total +10.00%p)"
    lines = compare.comparison_lines(table).orderBy("line_no").collect()
    assert [x.text for x in lines] == ["70.00%", "N/A", "80.00%", "80.00%"]
    nothing = compare.compare(compared(spark, None, None)).first()
    assert (nothing.best_iteration, nothing.best_accuracy, nothing.total_delta) == (0, 0, 0)


def test_unknown_runs(spark):
    traced = runlog.trace(log(spark, a="acc: 1"))
    table = compare.iterations(compare.experiment(spark, "a, lost"), traced)
    got = {r.job_id: (r.error, r.convergence) for r in table.collect()}
    assert got == {"a": (None, "unknown"), "lost": ("not_found", None)}
    listed = spark.createDataFrame([("a",), ("lost",)], "id string")
    errors = compare.iterations(compare.experiment(spark, "a,lost"), traced, listed)
    assert errors.where("error IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        compare.experiment(spark, "a")


def test_missing_and_repeated_iterations(spark):
    reports = spark.createDataFrame(
        [("t", 0, 50.0, "a"), ("t", 2, 60.0, "b"), ("t", 2, 65.0, "c"), ("t", 7, 64.0, "d")],
        "task_id string, iteration int, accuracy double, job_id string",
    )
    rows = runs.iteration_changes(reports).orderBy("nth").collect()
    assert [(r.nth, r.iteration, r.job_id, r.change) for r in rows] == [
        (1, 0, "a", None), (2, 2, "b", 10), (3, 2, "c", 5), (4, 7, "d", -1)
    ]
    assert runs.experiment_report(reports).first().total_iterations == 4


def test_a_thousand_and_more_iterations(spark):
    steps = spark.range(1500).selectExpr("'e' AS experiment", "id AS iteration", "concat('j', id) AS job_id", "double(id % 90) AS accuracy")
    places = {r.iteration: (r.nth, r.accuracy_1) for r in compare.lagged(steps, 1).collect()}
    assert places == {i: (i + 1, (i - 1) % 90 if i else None) for i in range(1500)}
    reports = steps.withColumnsRenamed({"experiment": "task_id"}).selectExpr("*", "array('a') AS actions")
    assert runs.experiment_report_lines(reports).count() == 1501


def test_iteration_reports(spark):
    text = """=== ITERATION 1 COMPLETE ===
Accuracy: 84.87%
Actions: drop_redundant,\tstandardize
Job ID: 0a1b2c3d4e5f
Features: 33
should stop: TRUE
Reason: improving\t
===
Accuracy: 1%"""
    df = spark.createDataFrame([("t", 1, text), ("t", 2, "crashed")], "task_id string, iteration int, output string")
    full, empty = sorted(runs.iteration_reports(df).collect(), key=lambda r: r.iteration)
    assert (full.accuracy, full.actions, full.job_id) == (84.87, ["drop_redundant", "standardize"], "0a1b2c3d4e5f")
    assert (full.features, full.should_stop, full.reason) == (33, True, "improving")
    assert (empty.accuracy, empty.actions, empty.should_stop, empty.reason) == (None, [], False, "")


def test_experiment_report(spark):
    reports = spark.createDataFrame(
        [("t", 0, 46.32, ["baseline"]), ("t", 1, 84.87, ["a", "b"]), ("t", 2, None, []), ("t", 3, 84.87, ["c"]), ("u", 0, None, [])],
        "task_id string, iteration int, accuracy double, actions array<string>",
    ).withColumn("job_id", F.lit("j"))
    tasks = spark.createDataFrame([("t", "classify wear", "data/mill.csv")], "id string, task string, dataset string")
    got = {r.task_id: r for r in runs.experiment_report(reports).collect()}
    assert (got["t"].best_iteration, got["t"].best_accuracy, got["t"].total_iterations) == (1, 84.87, 4)
    lines = {(r.task_id, r.line_no): r.text for r in runs.experiment_report_lines(reports, tasks).collect()}
    assert lines["t", 0] == "mill.csv: classify wear; 4 iterations; best 84.87% in iteration 1"
    assert lines["t", 1] == "iteration 0; 46.32%; baseline"
    assert lines["t", 2].startswith("iteration 1; 84.87% (+38.") and lines["t", 2].endswith("%p); a, b")
    assert lines["t", 4] == "iteration 3; 84.87%; c"
    assert lines["u", 0] == "1 iterations; best no accuracy in iteration 0"


def test_run_and_task_lists(spark):
    records = spark.createDataFrame(
        [
            ("a", "x", "completed", "2024-03-31T01:00:00", "2024-03-31T01:30:00.250000", "2024-03-31T03:30:00"),
            ("b", "y", "running", "2024-03-31T02:00:00", "2024-03-31T02:00:00", None),
            ("c", "z", "queued", "2024-03-30T00:00:00", None, None),
        ],
        "id string, name string, status string, submitted_at string, started_at string, finished_at string",
    )
    got = runs.run_list(records, now="2024-03-31T02:00:30").collect()
    assert [r.id for r in got] == ["b", "a", "c"]
    assert got[1].elapsed_seconds == pytest.approx(7199.75)
    assert got[0].running_seconds == pytest.approx(30) and got[2].running_seconds is None
    tasks = spark.createDataFrame(
        [(f"t{i:02}", "d" * 80, "completed", f"2024-01-{i + 1:02}", [(1, 50.0), (2, 60.0 + i)] if i else [], 70.0) for i in range(25)],
        "id string, task string, status string, submitted_at string, iterations array<struct<iteration:int,accuracy:double>>, best_accuracy double",
    )
    listed = runs.task_list(tasks).collect()
    assert len(listed) == 20 and listed[0].id == "t24" and listed[0].current_accuracy == 84
    assert len(listed[0].task) == 60
    last = runs.task_list(tasks, None).where("id = 't00'").first()
    assert (last.n_iterations, last.current_accuracy) == (0, None)


def test_report_of_unfinished_run(spark):
    df = spark.range(30).selectExpr("id", "id * 2 AS twice")
    found = diagnose.diagnose(df)
    report = diagnose.diagnosis_report(found, runlog.trace(log(spark, a="acc: 9")), "other").first()
    assert (report.accuracy, report.convergence, report.severity) == (None, "unknown", "warning")


def numbered(lines):
    return [(j, i, f"Epoch {i} loss: {1 / (i + 1):.4f} acc: {50 + i * 7 % 45}", f"2024-01-0{1 + i // 20} 00:00:{i % 60:02}") for j, i in lines]


def test_stream_equals_batch(spark, tmp_path):
    """Files arrive out of order, in several micro-batches."""
    data = numbered([(j, i) for i in range(60) for j in ("a", "b", "c")])
    schema = "job_id string, line_no bigint, line string, ts string"
    everything = spark.createDataFrame(data, schema)
    for k, part in enumerate((data[90:150], data[150:], data[:90])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
    source = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")).drop("ts")
    )
    board = RunBoard(spark, str(tmp_path / "board"))
    board.start_metrics(source).awaitTermination()
    board.start_recent(source).awaitTermination()
    live = {r.job_id: r.asDict() for r in board.metrics().collect()}
    batch = {r.job_id: r.asDict() for r in live_metrics(everything.drop("ts")).collect()}
    assert live == batch and len(live) == 3
    verdicts = {r.job_id: r.convergence for r in board.convergence().collect()}
    traced = {r.job_id: r.convergence for r in runlog.trace(everything.drop("ts"), tail_lines=None).collect()}
    assert verdicts == traced


def test_board_can_be_opened_again(spark, tmp_path):
    schema = "job_id string, line_no bigint, line string"
    spark.createDataFrame([("a", 1, "acc: 5")], schema).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    RunBoard(spark, str(tmp_path / "board")).start_metrics(source).awaitTermination()
    assert RunBoard(spark, str(tmp_path / "board")).metrics().first().accuracy_last == 5


def test_closed_windows_equal_batch(spark, tmp_path):
    data = numbered([(j, i) for i in range(60) for j in ("a", "b")])
    schema = "job_id string, line_no bigint, line string, ts string"
    frame = spark.createDataFrame(data, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    frame.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    (
        windowed_metrics(source).writeStream.outputMode("append").format("parquet")
        .option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start().awaitTermination()
    )
    closed = {(r.job_id, r.during.start): r.asDict(True) for r in spark.read.parquet(out).collect()}
    batch = {(r.job_id, r.during.start): r.asDict(True) for r in windowed_metrics(frame).collect()}
    assert 0 < len(closed) < len(batch)
    assert all(batch[k] == v for k, v in closed.items())


@pytest.mark.parametrize("parts", [1, 4, 60])
def test_lags_go_on_across_parts(spark, parts):
    rng = random.Random(parts)
    rows = []
    for key, n in (("a", 1), ("b", 90), ("c", 3), (None, 25), ("d", 1), ("e", 40)):
        rows += [(key, i, f"j{i}", rng.choice([None, float(i), rng.random()])) for i in range(n)]
    rows += [("b", 7, "j7", 1.0), ("b", 7, "k", None)]
    want = {}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2], r[3] is not None, r[3] or 0))
        values = [r[3] for r in mine]
        for n in range(len(mine)):
            before = [v for v in values[:n] if v is not None]
            lags = [values[n - k] if n >= k else None for k in (1, 2, 3)]
            want[key, n + 1] = (mine[n][1], mine[n][2], *lags, before[-1] if before else None)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "k string, o int, j string, v double")
        found = numbered_with_lags(df, "k", ["o", "j", "v"], "v", 3).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(r.k, r.nth): (r.o, r.j, r.v_1, r.v_2, r.v_3, r.v_before) for r in found} == want
    assert len(found) == len(rows)


def test_decisive_lines_decide(spark):
    rng = random.Random(1)
    lines = []
    for job in ("a", "b", "c", "hot"):
        for n in range(4000 if job == "hot" else rng.choice([1, 2, 40])):
            text = rng.choice(
                [f"Epoch {rng.randrange(90)} loss: {rng.random():.3f}", f"acc: {rng.random() * 100:.2f}%", "saved",
                 f"TP: {n} FP: 1 FN: 2 TN: 3", f"F1: 0.{n % 10} Params: {n}", f"Precision: 0.5 Features: {n}"]
            )
            lines.append((job, n, text))
    rng.shuffle(lines)
    df = spark.createDataFrame(lines, "job_id string, line_no long, line string").repartition(5)
    metrics = runlog.extract_metrics(df).select("job_id", "line_no", *runlog.METRICS)
    few = runlog.decisive(metrics)
    assert few.count() < 4 * 5 * 30

    def results(rows):
        return rows.groupBy("job_id").agg(*runlog.run_aggregates(), runlog.latest_accuracies().alias("latest")).collect()

    assert sorted(map(repr, results(few))) == sorted(map(repr, results(metrics)))
    assert runlog.decisive(metrics.limit(0)).count() == 0


def test_a_whole_log_is_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    lines = spark.range(3000).selectExpr("concat('j', id % 3) AS job_id", "id AS line_no", "concat('acc: ', id % 100) AS line")
    traced = runlog.trace(lines.mapInArrow(passed, lines.schema), tail_lines=None)
    assert traced.count() == 3 and read.value == 3000
    assert {r.convergence for r in traced.collect()} <= {"improving", "overfitting", "plateau"}


def test_a_board_of_many_batches_stays_small(spark, tmp_path):
    rng = random.Random(3)
    board, want = RunBoard(spark, str(tmp_path / "board")), {}

    def batch(n):
        rows = [(job, float(n), None if n % 3 else n) for job in rng.sample("abcdefgh", rng.randrange(0, 4))]
        return rows, spark.createDataFrame(rows, "job_id string, loss double, epoch int").coalesce(1)

    for n in range(45):
        rows, df = batch(n)
        if n in (8, 26, 27):
            # Some of a batch was written before its task failed; it is replayed with what it holds.
            board.store(df, n)
        board.store(df, n)
        want |= {job: (loss, epoch) for job, loss, epoch in rows}
        if n in (0, 1, 8, 26, 27, 44):
            assert {r.job_id: (r.loss, r.epoch) for r in board.metrics().collect()} == want
    # 45 batches are 1200 in threes.
    folders = [p for p in (tmp_path / "board" / "metrics").glob("*/*") if p.is_dir()]
    assert len(folders) <= 10 and len(board._manifest(44)) == 3
    assert len(list((tmp_path / "board" / "manifest").iterdir())) == 2
