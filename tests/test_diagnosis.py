"""Explain, diagnosis rules, feature transforms."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import diagnose, explain, features
from plumbline.operators.correlate import correlations
from plumbline.plans.diagnosis import drop_id_orders


@pytest.fixture(scope="module")
def sensors(spark):
    """A small table like the case study: sensors of an experiment, class column last."""
    return spark.range(400).selectExpr(
        "CAST(id % 4 AS int) AS experiment_id",
        "CAST(id AS int) AS step",
        "sin(id) * 10 AS x_velocity",
        "cos(id * 3) AS x_accel",
        "CAST(hash(id) % 1000 AS double) AS x_power",
        "CAST(hash(id) % 1000 AS double) * 2 AS x_power_copy",
        "IF(id % 100 = 0, 5000D, CAST(id % 7 AS double)) AS feed_rate",
        "2.5D AS const_col",
        "IF(id % 10 = 0, 'worn', 'unworn') AS tool_state",
    )


def test_explain_sections(sensors):
    found = explain.explain(sensors)
    sections = {r.section for r in found.table().collect()}
    assert sections == {"shape", "correlations", "outliers", "distributions"}
    line = found.summary().first()
    assert line.n_numeric == 8 and "x_power~x_power_copy (r=1.000)" in line.summary
    assert line.skewed_columns == "feed_rate"
    assert found.insights().first().insight == "x_power and x_power_copy: strong_positive (r=1.000)"
    assert found.alerts().first().alerts == 2


def test_explain_actions(sensors):
    assert explain.explain(sensors, "correlate").distributions is None
    profile = explain.explain(sensors, "profile")
    assert profile.outliers is None and profile.cardinality.count() == 9
    assert explain.explain(sensors, "outliers", method="zscore").outliers.count() == 1
    assert explain.explain(sensors.select("tool_state"), "explain").insights().count() == 0
    with pytest.raises(ValueError):
        explain.explain(sensors, "guess")


def test_explain_missing(spark):
    df = spark.range(50).selectExpr("id", "IF(id < 5, NULL, id * id) AS gap", "IF(id < 10, NULL, 'x') AS text")
    found = explain.explain(df)
    line = found.summary().first()
    assert (line.missing_columns, line.n_missing_columns) == ("gap, text", 2)
    pattern = [r for r in found.table().collect() if r.section == "missing_pattern"]
    assert pattern[0].label == "MAR_or_MNAR_possible"


def test_diagnosis_of_sensors(sensors):
    found = diagnose.diagnose(sensors, "x_power, step")
    got = [(r.priority, r.action, r.columns) for r in found.recommendations.orderBy("priority").collect()]
    assert got == [
        (1, "drop_redundant", ["x_power_copy"]),
        (2, "add_features", ["experiment_id", "x_velocity", "x_accel", "x_power_copy", "feed_rate", "const_col"]),
        (3, "transform_skewed", ["feed_rate"]),
        (4, "oversampling", ["tool_state"]),
        (5, "add_rolling_stats", ["x_velocity", "x_accel"]),
        (6, "standardize", []),
    ]
    verdict = found.verdict.first()
    assert (verdict.severity, verdict.n_recommendations) == ("critical", 6)
    assert [r.col_name for r in found.low_variance.collect()] == ["const_col"]
    assert found.unused.first().unused_numeric == got[1][2]


def test_silent_diagnosis(spark):
    df = spark.range(100).selectExpr("id AS a", "hash(id) % 50 AS b")
    found = diagnose.diagnose(df)
    assert found.recommendations.count() == 0
    assert found.verdict.first().severity == "info"
    assert found.imbalance.count() == 0


def test_pair_thresholds(spark):
    pairs = spark.createDataFrame(
        [(0, 1, "a", "b", 9, 0.7), (0, 2, "a", "c", 9, 0.95004), (1, 2, "b", "c", 9, -0.96), (0, 3, "a", "d", 9, None)],
        "i int, j int, col1 string, col2 string, n bigint, r double",
    )
    found = diagnose.multicollinear_pairs(None, 0.7, pairs).collect()
    assert [(r.col1, r.col2, r.r, r.action) for r in found] == [
        ("b", "c", 0.96, "drop_one"),
        ("a", "c", 0.95, "drop_one"),  # rounded it is not "perfect"
        ("a", "b", 0.7, "monitor"),
    ]
    from plumbline.operators.correlate import strong_correlations

    assert strong_correlations(None, threshold=0.7, pairs=pairs).count() == 2


def classes(spark, *counts):
    values = [(i, f"c{k}") for k, n in enumerate(counts) for i in range(n)]
    return spark.createDataFrame(values, "i int, label string")


@pytest.mark.parametrize(
    "counts, action",
    [((10, 50), "oversampling"), ((11, 50), "class_weight"), ((25, 50), None), ((40,), None)],
)
def test_class_ratio_limits(spark, counts, action):
    found = diagnose.class_imbalance(classes(spark, *counts).select("label")).collect()
    assert [r.action for r in found] == ([action] if action else [])


def test_last_imbalanced_column_wins(spark):
    df = spark.range(100).selectExpr(
        "IF(id < 10, 'a', 'b') AS first", "IF(id < 20, 1, 0) AS second", "id AS many", "true AS flat"
    )
    assert diagnose.class_imbalance(df).first().target_column == "second"
    assert diagnose.class_imbalance(df, target="first").first().target_column == "first"
    text = df.withColumn("text", F.when(F.col("many") < 3, "twice").otherwise(F.col("many").cast("string")))
    assert diagnose.class_imbalance(text).first().target_column == "text"
    many = df.withColumn("text", F.concat(F.lit("t"), F.col("many")))
    counted = {r.col_name: r.n_classes for r in diagnose.categorical_columns(many).collect()}
    assert counted == {"first": 2, "second": 2, "flat": 1, "text": 100}


def test_every_column_counts_unless_asked(spark):
    """60 columns in 30 redundant pairs, the wide range in the last one."""
    df = spark.range(300).select(
        *[(F.sin(F.col("id") * (k + 1)) * (10_000 if k == 29 else 1)).alias(f"c{k}_{half}") for k in range(30) for half in "ab"]
    )
    found = diagnose.diagnose(df, "c0_a")
    redundant = found.recommendations.where("action = 'drop_redundant'").first()["columns"]
    assert set(redundant) >= {f"c{k}_b" for k in range(30)}
    assert found.recommendations.where("action = 'standardize'").count() == 1
    assert len(found.unused.first().unused_numeric) == 59
    short = diagnose.diagnose(df, "c0_a", lengths=diagnose.SHORT)
    assert len(short.recommendations.where("action = 'drop_redundant'").first()["columns"]) == 5
    assert len(short.unused.first().unused_numeric) == 15


def test_one_infinity_is_no_strong_pair(spark):
    df = spark.range(200).selectExpr("double(id) AS a", "IF(id = 7, double('infinity'), double(id)) AS b", "IF(id = 7, NULL, double(id % 13)) AS c")
    wide = df.selectExpr("*", *[f"a % {k} AS d{k}" for k in range(3, 9)])
    for table in (df, wide):
        pairs = {(r.col1, r.col2): r.r for r in correlations(table).collect()}
        assert pairs["a", "b"] is None and pairs["b", "c"] == pytest.approx(pairs["a", "c"], abs=1e-12)
    assert diagnose.multicollinear_pairs(df).count() == 0


def test_categorical_columns(spark):
    df = spark.range(1000).selectExpr(
        "id % 10 AS ten", "id % 11 AS eleven", "id", "CAST(id AS string) AS text", "array(id) AS nested", "CAST(NULL AS int) AS none"
    )
    got = {r.col_name: r.n_classes for r in diagnose.categorical_columns(df).collect()}
    assert got == {"ten": 10, "text": 1000, "none": 0} or got == {"ten": 10, "text": None, "none": 0}


def test_skewed_left_and_order(spark):
    df = spark.range(200).selectExpr("IF(id = 0, -1e6D, id) AS left", "IF(id = 0, 1e6D, id) AS right", "id")
    got = [(r.col_name, r.action) for r in diagnose.skewed_features(df).collect()]
    assert got == [("left", "reflect_log"), ("right", "log_transform")]


def test_transforms_on_edges(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (4.0, 5.0, 2.0), (9.0, 5.0, float("nan"))], "v double, c double, n double")
    log = [r.v for r in features.log_transform(df, ["v"]).collect()]
    assert log == pytest.approx([0, math.log1p(3), math.log1p(8)])
    assert [r.v for r in features.reflect_log(df, ["v"]).collect()] == pytest.approx([math.log1p(8), math.log1p(5), 0])
    assert [r.v for r in features.sqrt_transform(df, ["v"]).collect()] == pytest.approx([0, math.sqrt(3), math.sqrt(8)])
    scaled = features.standardize(df).collect()
    assert [r.c for r in scaled] == [0, 0, 0]
    assert sum(r.v for r in scaled) == pytest.approx(0)
    assert [r.n for r in scaled] == [None, 0, None]


def test_fit_is_reused(spark):
    train = spark.createDataFrame([(0.0,), (2.0,)], "v double")
    fit = features.fit_numeric(train)
    test = spark.createDataFrame([(4.0,)], "v double")
    assert features.standardize(test, fit=fit).first().v == pytest.approx(3)


def test_oversample_balances_and_keeps_rows(spark):
    df = classes(spark, 7, 3, 2)
    grown = features.oversample(df, "label", "i").toPandas()
    assert grown.groupby("label").size().tolist() == [7, 7, 7]
    copies = grown[grown.label == "c2"].groupby("i").size()
    assert copies.to_dict() == {0: 4, 1: 3}
    withnull = df.unionByName(spark.createDataFrame([(1, None)], "i int, label string"))
    assert features.oversample(withnull, "label", "i").where("label IS NULL").count() == 1


def test_rolling_blocks_equal_plain_window(spark):
    df = spark.range(500).selectExpr(
        "IF(id % 3 = 0, NULL, id % 2) AS k", "CAST(id DIV 40 AS int) AS t", "id", "IF(id % 17 = 0, NULL, sin(id)) AS v"
    )
    args = (["v"], "k", ["t", "id"], [3, 8])
    plain = features.rolling_stats(df, *args).toPandas().sort_values("id").reset_index(drop=True)
    split = features.rolling_stats(df, *args, hot_rows=20, block=10).toPandas()
    split = split.sort_values("id").reset_index(drop=True)
    pd.testing.assert_frame_equal(plain, split)
    one = plain[plain.k == 1]
    expected = one.v.rolling(8, min_periods=8).mean()
    assert one.v_mean_8.isna().equals(expected.isna())
    assert (one.v_mean_8 - expected).abs().max() < 1e-12


def test_one_hot_cap(spark):
    df = classes(spark, 2, 1)
    assert features.one_hot(df, "label").columns == ["i", "label_c0", "label_c1"]
    with pytest.raises(ValueError):
        features.one_hot(df, "label", max_values=1)


def test_apply_all_recommendations(sensors):
    found = diagnose.diagnose(sensors.drop("step"), "x_power")
    applied = features.apply_recommendations(
        sensors, found.recommendations, target="tool_state", key="step",
        partition_by="experiment_id", order_by=["step"],
    )
    assert "x_power_copy" not in applied.columns and "x_velocity_mean_50" in applied.columns
    sizes = {r.tool_state: r["count"] for r in applied.groupBy("tool_state").count().collect()}
    assert sizes == {"worn": 360, "unworn": 360}
    with pytest.raises(ValueError):
        features.apply_recommendations(sensors, found.recommendations)


def test_drop_id_columns(sensors):
    assert "step" not in features.drop_id_columns(sensors).columns
    assert features.drop_id_columns(sensors, ["experiment_id"]).columns[0] == "step"


def test_a_bursty_key_is_cut_into_even_blocks(spark):
    """All rows but one lie close together, the last one far off; text orders work as well."""
    rows = spark.range(1001).selectExpr("1 AS k", "IF(id = 1000, 1000000000L, id) AS t", "lpad(id, 5, '0') AS s", "double(id % 7) AS x")
    for order in (["t"], ["s"]):
        plain = {r.s: r.x_mean_5 for r in features.rolling_stats(rows, ["x"], "k", order, [5]).collect()}
        cut = features.rolling_stats(rows, ["x"], "k", order, [5], hot_rows=100, block=20)
        assert {r.s: r.x_mean_5 for r in cut.collect()} == pytest.approx(plain)


def test_missing_classes_and_column_order(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b"), (3, float("nan"), "c"), (4, None, "d"), (5, 1.0, "e")], "k int, y double, z string")
    assert features.class_weights(df, "y").count() == 2
    assert features.add_class_weight(df, "y").columns == ["k", "y", "z", "class_weight"]
    copies = {r.k: r["count"] for r in features.oversample(df, "y", "k").groupBy("k").count().collect()}
    assert copies == {1: 1, 2: 2, 3: 1, 4: 1, 5: 1}
    index = {r.z: r.z_index for r in features.one_hot_index(df, "z").collect()}
    assert index == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4}


def test_oversampling_of_keys_from_end_to_end(spark):
    df = spark.range(300).selectExpr("IF(id < 100, 'a', 'b') AS y", "IF(id % 2 = 0, 9223372036854775807L - id, -9223372036854775808L + id) AS k")
    found = features.oversample(df, "y", "k")
    assert {r.y: r["count"] for r in found.groupBy("y").count().collect()} == {"a": 200, "b": 200}


def test_a_price_is_dropped_from_many_orders_as_from_few(spark, tmp_path):
    """More copies of the orders have new keys and the same prices, which then look less like ids."""
    few = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    shifted = {k: F.expr(f"{k} + copy * 1000000") for k in ("o_orderkey", "o_custkey")}
    few.crossJoin(spark.range(20).withColumnRenamed("id", "copy")).withColumns(shifted).drop("copy").write.parquet(
        f"{tmp_path}/orders.parquet"
    )
    many = spark.read.parquet(f"{tmp_path}/orders.parquet")
    for folder, df in (("/root/testdata/sf0.001", few), (str(tmp_path), many)):
        found, expected = drop_id_orders(spark, folder), df.select("o_custkey", "o_orderstatus")
        assert found.columns == expected.columns
        assert found.exceptAll(expected).isEmpty() and expected.exceptAll(found).isEmpty()
    assert features.drop_id_columns(few, [], ["o_totalprice"]).columns == few.drop("o_totalprice").columns
