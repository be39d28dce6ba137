"""Order statistics, profile, distribution, correlation and outliers on edge cases."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions.shared_pass import SharedPass, Summary, exact_ranks
from plumbline.operators import correlate, diagnose, distribution, explain, outliers, profile


def rows(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")


PROBABILITIES = [0, 0.1, 0.25, 0.5, 0.75, 0.99, 1]


def quantiles(df, column="v", probabilities=PROBABILITIES):
    return SharedPass(df, [column], quantiles=True).quantiles(probabilities)[column]


@pytest.mark.parametrize(
    "values",
    [
        list(range(100)),
        [5.0] * 30 + [1.0, 9.0],
        [math.exp(i / 3) for i in range(120)],
        [-1e308, 1e308, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0],
        [1.0, 1.0 + 2**-52, 1.0 + 2**-51, 1.0 + 2**-50, 3.0, 4.0, 7.0, 8.0, 9.0],
        [7.0],
        [1.0, 2.0],
    ],
)
def test_quantiles_are_exact(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    with np.errstate(over="ignore"):
        # Order statistics must be values of the column; interpolation is linear.
        expected = [float(pd.Series(values, dtype="float64").quantile(p)) for p in PROBABILITIES]
    finite = [(a, b) for a, b in zip(quantiles(df), expected) if math.isfinite(b)]
    assert np.allclose(*zip(*finite), rtol=1e-12)


@pytest.mark.parametrize(
    "value",
    [
        "pmod(hash(id), 1000003) * 1.5",
        "exp(pmod(hash(id), 1000) / 20.0) + id",
        "CASE WHEN id % 10 < 9 THEN 7 ELSE id END",  # one value in 90 % of the rows
        "CASE WHEN id % 3 = 0 THEN double('-infinity') WHEN id % 3 = 1 THEN id ELSE NULL END",
        "CASE WHEN id % 5 = 0 THEN double('nan') WHEN id % 50 = 1 THEN double('infinity') ELSE -id END",
        "id * id",
    ],
)
def test_brackets_settle_every_rank(spark, value):
    # Blocks are full and summaries reduced, so the second scan decides.
    df = spark.range(0, 300_000, numPartitions=3).selectExpr(f"CAST({value} AS double) AS v")
    values = np.sort(df.where("v IS NOT NULL AND NOT isnan(v)").toPandas()["v"].to_numpy())
    ranks = [0, 1, len(values) // 3, len(values) // 2, len(values) - 2, len(values) - 1]
    state = SharedPass(df, ["v"], quantiles=True)
    found = exact_ranks(df, {"v": ranks}, {"v": state._columns[0].quantiles[0]})
    assert [found["v", r] for r in ranks] == values[ranks].tolist()


def test_summaries_keep_their_bound():
    rng = np.random.default_rng(8)
    for draw in (lambda n: rng.normal(size=n), lambda n: rng.integers(0, 50, n) ** 3.0, lambda n: np.exp(rng.normal(0, 9, n))):
        blocks = [draw(int(rng.integers(1, 4000))) for _ in range(40)]
        summary = Summary.merged([Summary.of(b).reduced(64) for b in blocks], 64)
        values = np.sort(np.concatenate(blocks))
        assert summary.weights.sum() == len(values) and len(summary.points) <= 65
        upto = np.searchsorted(summary.points, values, "right")
        estimate = np.append(0, np.cumsum(summary.weights))[upto]
        assert np.abs(estimate - np.searchsorted(values, values, "right")).max() <= summary.error
        for rank in range(0, len(values), 997):
            lo, hi = summary.bracket(rank)
            assert (lo is None or lo < values[rank]) and values[rank] <= hi or lo == hi == values[rank]


def test_quantiles_with_infinities_and_missing(spark):
    values = [float("-inf"), 1.0, 2.0, 3.0, 4.0, 5.0, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert quantiles(df, "v", [0, 0.5, 1]) == [float("-inf"), 3.0, float("inf")]


def test_pass_equals_aggregates(spark):
    df = spark.range(0, 20_000, numPartitions=7).selectExpr(
        "1e9D + id % 3 AS far", "CASE WHEN id % 4 = 0 THEN NULL ELSE sqrt(id) END AS gaps", "pow(id, 5) AS steep",
        "2.5D AS same", "CASE WHEN id = 9 THEN double('infinity') ELSE id END AS endless",
        "CASE WHEN id > 19000 THEN 0.1D * id END AS late", "CAST(NULL AS double) AS none",
    )
    state = SharedPass(df, df.columns, pairs=True)
    want = rows(profile.column_facts(df, shape=True), "col_name")
    for fact in state.facts():
        for key in ("n_rows", "n", "mean", "std", "min", "max", "skewness", "kurtosis"):
            expected = want[fact["col_name"]][key]
            close = expected if expected is None else pytest.approx(expected, rel=1e-9, abs=1e-6, nan_ok=True)
            assert fact[key] == close, (fact["col_name"], key)
    table = df.toPandas().replace([np.inf, -np.inf], np.nan)
    r = (table - table.mean()).corr()
    for p in state.pairs().collect():
        a, b = df.columns[p.i], df.columns[p.j]
        assert p.n == (df.toPandas()[[a, b]].notna().all(axis=1)).sum()
        if {a, b} != {"endless", "late"} and "endless" in (a, b) or "same" in (a, b) or "none" in (a, b):
            assert p.r is None
        else:
            assert p.r == pytest.approx(r.loc[a, b], abs=1e-7), (a, b)


def test_wide_tables_are_paired_in_tiles(spark):
    wide = spark.range(0, 300, numPartitions=3).select(
        *[((F.hash("id", F.lit(i)) % 100) + (F.col("id") if i % 7 == 0 else 0)).cast("double").alias(f"c{i}") for i in range(200)]
    )
    found = {(p.i, p.j): p.r for p in correlate.correlations(wide).collect()}
    r = wide.toPandas().corr().to_numpy()
    assert len(found) == 200 * 199 // 2
    assert all(abs(found[i, j] - r[i, j]) < 1e-9 for i, j in found)


def scans(spark, df, action):
    """How often an action reads the table's rows."""
    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    action(df.mapInArrow(passed, df.schema))
    return read.value / df.count()


def test_few_scans(spark, lineitem):
    table = lineitem.select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linenumber")
    assert scans(spark, table, lambda df: profile.describe(df).collect()) <= 2
    assert scans(spark, table, lambda df: correlate.correlations(df).collect()) == 1
    assert scans(spark, table, lambda df: explain.explain(df).table().collect()) <= 3
    assert scans(spark, table, lambda df: diagnose.diagnose(df).recommendations.collect()) <= 3
    assert scans(spark, table, lambda df: outliers.outliers(df).collect()) <= 3


def test_describe_equals_pandas(spark, lineitem):
    found = profile.describe(lineitem).toPandas().set_index("col_name")
    table = lineitem.toPandas()
    expected = table[list(found.index)].describe().T
    for ours, theirs in zip(
        ["n", "mean", "std", "min", "p25", "p50", "p75", "max"], expected.columns
    ):
        assert np.allclose(found[ours].astype(float), expected[theirs], rtol=1e-9), ours


def test_approximate_quartiles_are_close(lineitem):
    exact = rows(profile.describe(lineitem, "l_extendedprice"), "col_name")["l_extendedprice"]
    near = rows(profile.describe(lineitem, "l_extendedprice", approx=True), "col_name")["l_extendedprice"]
    assert abs(near.p50 - exact.p50) / exact.p50 < 0.01


def test_distribution_equals_pandas(lineitem):
    found = distribution.distributions(lineitem).toPandas().set_index("col_name")
    table = lineitem.toPandas()[list(found.index)]
    assert np.allclose(found["skewness"], table.skew())
    assert np.allclose(found["kurtosis"], table.kurtosis())


def test_constant_null_and_short_columns(spark):
    df = spark.createDataFrame(
        [(1.1, None, float("nan"), i) for i in range(12)],
        "const double, empty double, nan double, id int",
    )
    facts = rows(profile.column_facts(df, shape=True), "col_name")
    assert (facts["const"].std, facts["const"].skewness, facts["const"].kurtosis) == (0, 0, 0)
    assert facts["empty"].n == facts["nan"].n == 0
    assert facts["nan"]["mean"] is None and facts["nan"].n_rows == 12
    missing = rows(distribution.missing(df), "col_name")
    assert missing["empty"].percent == missing["nan"].percent == 100
    assert "const" not in missing
    described = rows(profile.describe(df), "col_name")
    assert described["empty"].p50 is None and described["const"].p25 == 1.1


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_few_rows(spark, n):
    df = spark.createDataFrame([(float(i * i),) for i in range(n)], "v double")
    fact = profile.column_facts(df, shape=True).first()
    assert (fact.std is None) == (n == 1)
    assert (fact.skewness is None) == (n < 3)
    assert (fact.kurtosis is None) == (n < 4)


def test_thresholds_of_four_five_nine_ten_rows(spark):
    def made(n):
        return spark.createDataFrame([(float(i),) for i in range(n - 1)] + [(1e6,)], "v double")

    assert distribution.distributions(made(4)).count() == 0
    assert distribution.distributions(made(5)).count() == 1
    assert outliers.outliers(made(9)).count() == 0
    assert outliers.outliers(made(10)).count() == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, b double, c string")
    assert [r.n_rows for r in profile.column_facts(df).collect()] == [0, 0]
    assert distribution.missing(df).count() == 0
    assert distribution.missing_pattern(distribution.missing(df)).count() == 0
    labels = [(r.ratio_pct, r.label) for r in distribution.cardinality(df).collect()]
    assert labels == [(None, None)] * 3
    assert outliers.outliers(df).count() == 0
    assert correlate.strong_correlations(df).count() == 0
    assert profile.describe(df).count() == 2


def test_no_numeric_columns(spark):
    df = spark.createDataFrame([("x", True)], "s string, b boolean")
    assert profile.describe(df).count() == 0
    assert distribution.distributions(df).count() == 0
    assert outliers.outliers(df).count() == 0
    assert correlate.correlations(df).count() == 0


def test_numeric_types_and_unknown_columns(spark):
    df = spark.sql("SELECT 1Y a, 2S b, 3 c, 4L d, 5F e, 6D f, true g, 7.5BD h, 'x' i")
    assert [r.col_name for r in profile.column_facts(df).collect()] == list("abcdef")
    assert [r.col_name for r in profile.column_facts(df, "h, d", include_decimal=True).collect()] == ["h", "d"]
    assert [r.col_name for r in profile.column_facts(df, "f, nowhere, a").collect()] == ["f", "a"]


def test_odd_column_names(spark):
    df = spark.createDataFrame([(float(i), i) for i in range(20)], "`a.b` double, `c``d` int")
    assert [r.col_name for r in profile.describe(df).collect()] == ["a.b", "c`d"]
    assert correlate.correlations(df).first().r == pytest.approx(1)
    assert distribution.cardinality(df).count() == 2
    assert outliers.flag_outliers(df).columns[-1] == "c`d_outlier"


def test_missing_pattern(spark):
    df = spark.createDataFrame([(None if i < 20 else i, None if i < 22 else i, i) for i in range(100)], "a int, b int, c int")
    assert distribution.missing_pattern(distribution.missing(df)).first().pattern == "MCAR_suspected"
    both = distribution.missing(df.withColumn("a", F.when(F.col("c") > 30, F.col("c"))))
    assert distribution.missing_pattern(both).first().pattern == "MAR_or_MNAR_possible"


def test_cardinality_labels(spark):
    df = spark.range(1000).selectExpr("id", "id % 5 AS few", "id % 100 AS some", "CAST(NULL AS string) AS none")
    labels = {r.col_name: (r.n_distinct, r.label) for r in distribution.cardinality(df).collect()}
    assert labels == {
        "id": (1000, "id_like"),
        "few": (5, "low_cardinality"),
        "some": (100, "mixed"),
        "none": (0, "low_cardinality"),
    }
    near = {r.col_name: r.n_distinct for r in distribution.cardinality(df, approx=True).collect()}
    assert abs(near["id"] - 1000) < 50 and near["few"] == 5


@pytest.mark.parametrize("width", [2, 10])
def test_correlation_equals_pandas_with_gaps(spark, width):
    rng = np.random.default_rng(7)
    table = pd.DataFrame(rng.normal(1e6, 3, (300, width)), columns=[f"c{i}" for i in range(width)])
    table["c1"] = table["c0"] * 2 + rng.normal(0, 1, 300)
    table = table.mask(rng.random(table.shape) < 0.1)
    table["const"] = 0.1
    table["none"] = np.nan
    found = rows(correlate.correlations(spark.createDataFrame(table)), "col1", "col2")
    expected = table.corr()
    for (a, b), r in found.items():
        theirs = expected.loc[a, b]
        assert (r.r is None) if math.isnan(theirs) else r.r == pytest.approx(theirs, abs=1e-9)
        assert r.n == table[[a, b]].dropna().shape[0]


def test_correlation_order_breaks_ties_by_position(spark):
    df = spark.range(50).selectExpr("id AS a", "id * 2 AS b", "-id AS c")
    found = correlate.strong_correlations(df).collect()
    assert [(r.col1, r.col2) for r in found] == [("a", "b"), ("a", "c"), ("b", "c")]
    assert [r.strength for r in found] == ["strong_positive", "strong_negative", "strong_negative"]
    assert not correlate.multicollinearity_warning(correlate.strong_correlations(df)).first().warning


def test_spearman_equals_pandas(spark):
    table = pd.DataFrame({"a": [1, 2, 2, 4, 5, 9], "b": [9.0, 7.0, 8.0, 8.0, 1.0, None], "c": [3, 3, 3, 3, 3, 4]})
    found = rows(correlate.spearman(spark.createDataFrame(table)), "col1", "col2")
    complete = table.dropna()
    assert found["a", "b"].r == pytest.approx(complete.corr("spearman").loc["a", "b"])
    assert found["a", "c"].r is None


def test_outliers_zero_range_zero_mean_and_method(spark):
    flat = spark.createDataFrame([(1.0,)] * 20 + [(99.0,)], "v double")
    assert outliers.outliers(flat).count() == 0  # the quartile range is zero
    assert outliers.outliers(flat, method="zscore").first()["count"] == 1
    centred = spark.createDataFrame([(float(v),) for v in [*range(-8, 9), -100, 100]], "v double")
    found = outliers.outliers(centred).first()
    assert (found["count"], found.impact_pct) == (2, 0)
    with pytest.raises(ValueError):
        outliers.outliers(flat, method="median")


@pytest.mark.parametrize("method", ["iqr", "zscore"])
def test_outliers_equal_pandas(spark, method):
    rng = np.random.default_rng(3)
    v = pd.Series(np.concatenate([rng.normal(10, 2, 400), [60, 70, -40]]))
    v[5] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"v": v, "id": range(len(v))}))
    s = v.dropna()
    if method == "iqr":
        q1, q3 = s.quantile([0.25, 0.75])
        mask = (s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))
    else:
        mask = ((s - s.mean()) / s.std()).abs() > 3
    found = outliers.outliers(df, "v", method).first()
    assert found["count"] == mask.sum()
    assert found.percent == pytest.approx(mask.sum() / len(s) * 100)
    assert found.impact_pct == pytest.approx(abs(s.mean() - s[~mask].mean()) / abs(s.mean()) * 100)
    flags = outliers.flag_outliers(df, "v", method).where("v_outlier").select("id").collect()
    assert {r.id for r in flags} == set(mask[mask].index)
