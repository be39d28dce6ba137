"""Plan shapes that decide whether a job survives large data, and exact rounding."""

import math
import os
import random
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plumbline.functions.columns import half_even, number_text
from plumbline.operators import correlate, distribution, features, outliers, profile, runlog, sqlpage

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(f"{FOLDER}/lineitem.parquet")


def test_facts_shuffle_partial_aggregates_only(lineitem):
    text = plan(profile.column_facts(lineitem.select("l_quantity", "l_comment" if "l_comment" in lineitem.columns else "l_shipdate", "l_tax"), shape=True))
    assert text.count("Exchange hashpartitioning(col_name") == 1
    assert "partial_" in text.split("Exchange hashpartitioning")[1]
    assert "l_shipdate" not in text  # only numeric columns are read


def test_flags_and_transforms_are_projections(lineitem):
    for df in (
        outliers.flag_outliers(lineitem, "l_quantity"),
        features.standardize(lineitem, ["l_tax"]),
        features.log_transform(lineitem, ["l_extendedprice"]),
        features.one_hot(lineitem, "l_returnflag"),
    ):
        assert "Exchange" not in plan(df) and "Join" not in plan(df)


def test_tail_is_limited_before_the_shuffle(spark):
    lines = spark.range(1000).selectExpr("concat('j', id % 3) AS job_id", "id AS line_no", "'acc: 1' AS line")
    assert "Partial" in plan(runlog.tail(lines, 5)) and "WindowGroupLimit" in plan(runlog.tail(lines, 5))


def test_distinct_counts_shuffle_by_value(lineitem):
    assert "Exchange hashpartitioning(col_name#" in plan(distribution.distinct_counts(lineitem.select("l_partkey")))
    text = plan(distribution.distinct_counts(lineitem.select("l_partkey")))
    first = text[text.rindex("Exchange hashpartitioning") :]
    assert first.startswith("Exchange hashpartitioning(col_name#") and "x#" in first.split(")")[0]


def test_correlation_sends_states_alone(lineitem):
    text = plan(correlate.correlations(lineitem.select("l_tax", "l_quantity")))
    assert "MapInArrow" in text and "ArrowEvalPython" not in text
    assert text.count("Scan parquet") == 1 and "Exchange hashpartitioning(kind" in text


def test_no_python_and_no_cross_join_in_queries(spark):
    # Matrix products, and the few lines of a log that decide, found in Arrow batches.
    allowed_python = {"correlations_lineitem", "multicollinearity_lineitem", "multicollinear_pairs_lineitem", "trace_runs"}
    for name in (
        "null_counts_injected", "cardinality_orders",
        "iteration_reports", "rolling_events", "rolling_events_hot_keys", "oversample_labels",
        "version_diff", "class_weighted_rows_labels", *allowed_python,
    ):
        text = plan(entry.queries()[name](spark, FOLDER))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name
        assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text, name
        assert name in allowed_python or "MapInArrow" not in text, name


def test_entry_and_registry(spark):
    first = entry.entry(spark)
    assert first.count() == 11 and first.columns[:2] == ["col_pos", "col_name"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 90


def test_rounding_is_exact(spark):
    rng = random.Random(5)
    values = [rng.uniform(-999, 999) for _ in range(500)]
    values += [rng.randint(-99_999, 99_999) / 1000 for _ in range(2000)]
    values += [rng.randint(-4000, 4000) / 16 for _ in range(500)]
    values += [2.675, 0.125, 18.85, 4.25, -0.0001, 0.0, 1e12 + 0.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (1, 2, 3, 4):
        got = df.select("v", half_even(F.col("v"), digits).alias("r"), number_text(F.col("v"), digits).alias("t"))
        for row in got.collect():
            assert row.r == round(row.v, digits)
            assert row.t == f"{row.v:.{digits}f}"
    null = spark.sql("SELECT CAST(NULL AS double) AS v").select(number_text(F.col("v"), 1), half_even(F.col("v"), 1))
    assert tuple(null.first()) == (None, None)


def test_rounding_at_any_size(spark):
    rng = random.Random(12)
    values = [700000.005, 1e15 + 0.125, 2.0**52 + 0.5, 4503599627370497.5, 1e300, 2.0**53 / 100, 45035996273704.965]
    values += [rng.choice([-1, 1]) * rng.random() * 10 ** rng.uniform(-3, 15.9) for _ in range(150_000)]
    # Ties and their neighbours: halves of a step at every size.
    for _ in range(100_000):
        tie = (2 * rng.randrange(int(10 ** rng.uniform(1, 15))) + 1) / (2 * 10 ** rng.choice([1, 2, 3]))
        values += [tie, math.nextafter(tie, 0), math.nextafter(tie, math.inf)]
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    for digits in (0, 1, 2, 4):
        got = df.select("v", half_even(F.col("v"), digits).alias("r")).toPandas()
        want = np.array([round(v, digits) for v in got["v"]])
        assert (got["r"].to_numpy() == want).all()
    odd = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),)], "v double")
    assert [str(r.r) for r in odd.select(half_even(F.col("v"), 2).alias("r")).collect()] == ["inf", "-inf", "nan"]


def test_ranks_of_a_value_that_fills_a_column(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 20)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.range(0, 20_000, numPartitions=4).selectExpr(
            "CASE WHEN id % 10 > 0 THEN 5 ELSE id END AS hot", "pmod(hash(id), 97) AS ties", "double(id * id) AS all",
            "CASE WHEN id % 500 = 0 THEN double('infinity') ELSE -id END AS ends", "CAST(1 AS double) AS same",
        )
        found = {(r.col1, r.col2): r.r for r in correlate.spearman(table).collect()}
        cells = table.selectExpr("0 AS col", "monotonically_increasing_id() AS row", "double(hot) AS x")
        sizes = [
            n for (n,) in correlate.average_ranks(cells).groupBy(F.spark_partition_id()).count().select("count").collect()
        ]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = table.toPandas().rank().corr()
    for (a, b), r in found.items():
        assert r is None if "same" in (a, b) else r == pytest.approx(want.loc[a, b], abs=1e-9)
    assert len(sizes) == 20 and max(sizes) <= 2 * sorted(sizes)[10]


def test_entry_without_a_library_of_the_training_data_package():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    root = os.path.dirname(os.path.abspath(entry.__file__))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=60)
    assert done.returncode == 0 and done.stdout.split()[1] == "False" and int(done.stdout.split()[0]) > 100


def test_views_of_the_caller_stay(spark):
    spark.range(3).createOrReplaceTempView("orders")
    found = sqlpage.query(spark, "SELECT count(*) AS n FROM orders JOIN more", {"orders": spark.range(7), "more": spark.range(2)})
    assert found.first().n == 14
    assert spark.table("orders").count() == 3
    assert not [t for t in spark.catalog.listTables() if t.name == "more"]
    entry.queries()["sql_join"](spark, FOLDER).count()
    assert spark.table("orders").count() == 3
    spark.catalog.dropTempView("orders")
