"""Profile and explain queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import correlate, distribution, explain, outliers, profile
from .registry import SQL, query, rounded, selected, table, union_sql

LINEITEM = {
    "l_orderkey": "bigint",
    "l_partkey": "bigint",
    "l_suppkey": "bigint",
    "l_linenumber": "int",
    "l_quantity": "double",
    "l_extendedprice": "double",
    "l_discount": "double",
    "l_tax": "double",
}
DERIVED = {
    "disc_price": "l_extendedprice * (1 - l_discount)",
    "charge": "l_extendedprice * (1 + l_tax)",
    "qty_sq": "l_quantity * l_quantity",
}
LINEITEM_TYPES = LINEITEM | {c: "double" for c in DERIVED}
LINEITEM_SQL = (
    "(SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in DERIVED.items()) + " FROM lineitem)"
)


def lineitem_derived(spark, folder):
    df = table(spark, folder, "lineitem")
    return df.withColumns({c: F.expr(e) for c, e in DERIVED.items()})


def describe_sql(columns: dict[str, str], source: str) -> str:
    return union_sql(
        f"""SELECT {i} AS col_pos, '{c}' AS col_name, '{kind}' AS dtype,
            count(*) AS n_rows, count({c}) AS n,
            round(avg({c}::DOUBLE), 6) AS mean, round(stddev_samp({c}::DOUBLE), 6) AS std,
            round(min({c})::DOUBLE, 6) AS min,
            round(quantile_cont({c}::DOUBLE, 0.25), 6) AS p25,
            round(quantile_cont({c}::DOUBLE, 0.5), 6) AS p50,
            round(quantile_cont({c}::DOUBLE, 0.75), 6) AS p75,
            round(max({c})::DOUBLE, 6) AS max
        FROM {source}"""
        for i, (c, kind) in enumerate(columns.items())
    )


@query("describe_lineitem", describe_sql(LINEITEM_TYPES, LINEITEM_SQL))
def describe_lineitem(spark, folder):
    return rounded(profile.describe(lineitem_derived(spark, folder)))


@query(
    "describe_orders",
    describe_sql({"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double"}, "orders"),
)
def describe_orders(spark, folder):
    return rounded(profile.describe(table(spark, folder, "orders")))


NAN_VALUES = "CASE WHEN event_type = 'error' THEN NULL ELSE value END"


@query(
    "describe_nan_events",
    describe_sql({"value": "double"}, f"(SELECT {NAN_VALUES} AS value FROM events)"),
)
def describe_nan_events(spark, folder):
    """NaN is missing: error events carry NaN here and NULL in the SQL."""
    df = table(spark, folder, "events").select(
        F.when(F.col("event_type") == "error", float("nan")).otherwise(F.col("value")).alias("value")
    )
    return rounded(profile.describe(df))


@query(
    "overview_orders",
    """SELECT count(*) AS n_rows, 6::BIGINT AS n_cols, 0::BIGINT AS nulls,
       'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS columns
       FROM orders""",
)
def overview_orders(spark, folder):
    return profile.overview(table(spark, folder, "orders"))


@query(
    "head_orders",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50",
)
def head_orders(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return profile.head(df, 50, order_by="o_orderkey")


INJECTED = ["l_orderkey", "l_linenumber", "l_tax", "l_shipdate"]
INJECTED_SQL = """(SELECT l_orderkey, nullif(l_linenumber, 1) AS l_linenumber,
    nullif(l_tax, 0) AS l_tax, l_shipdate FROM lineitem)"""


def lineitem_injected(spark, folder):
    """The test tables hold no missing values, so two columns get some."""
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        F.nullif("l_linenumber", F.lit(1)).alias("l_linenumber"),
        F.when(F.col("l_tax") == 0, float("nan")).otherwise(F.col("l_tax")).alias("l_tax"),
        "l_shipdate",
    )


NULLS_SQL = union_sql(
    f"""SELECT {i} AS col_pos, '{c}' AS col_name, count(*) AS n_rows,
        count(*) - count({c}) AS null_count FROM {INJECTED_SQL}"""
    for i, c in enumerate(INJECTED)
)


@query("null_counts_injected", NULLS_SQL)
def null_counts_injected(spark, folder):
    return profile.null_counts(lineitem_injected(spark, folder))


@query(
    "missing_injected",
    f"""SELECT col_pos, col_name, null_count, round(null_count * 100.0::DOUBLE / n_rows, 6) AS percent
        FROM ({NULLS_SQL}) WHERE null_count > 0""",
)
def missing_injected(spark, folder):
    return rounded(distribution.missing(lineitem_injected(spark, folder)))


@query(
    "missing_pattern_injected",
    f"""WITH p AS (SELECT printf('%.1f', null_count * 100.0::DOUBLE / n_rows)::DOUBLE AS p
          FROM ({NULLS_SQL}) WHERE null_count > 0)
        SELECT round(max(p) - min(p), 6) AS spread,
          CASE WHEN max(p) - min(p) < 5 THEN 'MCAR_suspected' ELSE 'MAR_or_MNAR_possible' END AS pattern
        FROM p HAVING count(*) > 0""",
)
def missing_pattern_injected(spark, folder):
    return rounded(distribution.missing_pattern(distribution.missing(lineitem_injected(spark, folder))))


def distribution_sql(columns: list[str], source: str) -> str:
    return union_sql(
        f"""SELECT col_pos, col_name, n, round(mean, 6) AS mean, round(std, 6) AS std,
            round(s, 6) AS skewness, round(k, 6) AS kurtosis,
            CASE WHEN abs(s) < 0.5 THEN 'normal' WHEN s > 0 THEN 'right_skewed'
                 WHEN s IS NOT NULL THEN 'left_skewed' END AS shape,
            round(lo, 6) AS min, round(hi, 6) AS max
        FROM (SELECT {i} AS col_pos, '{c}' AS col_name, count({c}) AS n,
                avg({c}::DOUBLE) AS mean, stddev_samp({c}::DOUBLE) AS std,
                CASE WHEN min({c}) = max({c}) THEN 0.0::DOUBLE ELSE skewness({c}::DOUBLE) END AS s,
                CASE WHEN min({c}) = max({c}) THEN 0.0::DOUBLE ELSE kurtosis({c}::DOUBLE) END AS k,
                min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi
              FROM {source})
        WHERE n >= 5"""
        for i, c in enumerate(columns)
    )


EVENTS_WIDE = ["event_id", "user_id", "value", "value_sq", "const_col"]
EVENTS_WIDE_SQL = """(SELECT event_id, user_id, event_type, value, value * value AS value_sq,
    1.1::DOUBLE AS const_col FROM events)"""


def events_wide(spark, folder):
    return table(spark, folder, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        (F.col("value") * F.col("value")).alias("value_sq"),
        F.lit(1.1).alias("const_col"),
    )


@query("distribution_events", distribution_sql(EVENTS_WIDE, EVENTS_WIDE_SQL))
def distribution_events(spark, folder):
    return rounded(distribution.distributions(events_wide(spark, folder)))


@query("distribution_lineitem", distribution_sql(list(LINEITEM), "lineitem"))
def distribution_lineitem(spark, folder):
    return rounded(distribution.distributions(table(spark, folder, "lineitem")))


def pairs_sql(columns: list[str], source: str) -> str:
    return union_sql(
        f"""SELECT {i} AS i, {j} AS j, '{columns[i]}' AS col1, '{columns[j]}' AS col2,
            count(CASE WHEN {columns[j]} IS NOT NULL THEN {columns[i]} END) AS n,
            nullif(corr({columns[i]}::DOUBLE, {columns[j]}::DOUBLE), 'NaN'::DOUBLE) AS r FROM {source}"""
        for i, j in combinations(range(len(columns)), 2)
    )


STRONG_SQL = f"""SELECT i, j, col1, col2, n, r,
    CASE WHEN r > 0 THEN 'strong_positive' ELSE 'strong_negative' END AS strength
    FROM ({pairs_sql(list(LINEITEM_TYPES), LINEITEM_SQL)}) WHERE abs(r) > 0.7"""


@query("correlations_lineitem", f"SELECT * REPLACE (round(r, 6) AS r) FROM ({STRONG_SQL})")
def correlations_lineitem(spark, folder):
    return rounded(correlate.strong_correlations(lineitem_derived(spark, folder)))


@query(
    "correlation_pairs_injected",
    f"""SELECT i, j, col1, col2, n, round(r, 6) AS r
        FROM ({pairs_sql(INJECTED[:3], INJECTED_SQL)})""",
)
def correlation_pairs_injected(spark, folder):
    """Pairwise-complete: each pair uses the rows where both values are present."""
    return rounded(correlate.correlations(lineitem_injected(spark, folder)))


@query(
    "correlation_pairs_events",
    f"SELECT i, j, col1, col2, n, round(r, 6) AS r FROM ({pairs_sql(EVENTS_WIDE, EVENTS_WIDE_SQL)})",
)
def correlation_pairs_events(spark, folder):
    """A constant column has no correlation: NULL."""
    return rounded(correlate.correlations(events_wide(spark, folder)))


INFINITE_SQL = """SELECT l_quantity AS a, l_extendedprice AS b,
    CASE WHEN l_orderkey % 100 = 1 THEN CAST('Infinity' AS DOUBLE) ELSE l_discount END AS c,
    CASE WHEN l_orderkey % 100 = 1 THEN NULL ELSE l_tax END AS d FROM lineitem"""


@query(
    "correlation_pairs_infinite",
    f"""SELECT 0 AS i, 1 AS j, 'a' AS col1, 'b' AS col2, count(*) AS n, round(corr(a, b), 6) AS r FROM ({INFINITE_SQL})
        UNION ALL SELECT 0, 2, 'a', 'c', count(*), NULL FROM ({INFINITE_SQL})
        UNION ALL SELECT 0, 3, 'a', 'd', count(d), round(corr(a, d), 6) FROM ({INFINITE_SQL})
        UNION ALL SELECT 1, 2, 'b', 'c', count(*), NULL FROM ({INFINITE_SQL})
        UNION ALL SELECT 1, 3, 'b', 'd', count(d), round(corr(b, d), 6) FROM ({INFINITE_SQL})
        UNION ALL SELECT 2, 3, 'c', 'd', count(d), round(corr(c, d), 6) FROM ({INFINITE_SQL}) WHERE d IS NOT NULL""",
)
def correlation_pairs_infinite(spark, folder):
    """An infinity makes the pairs that use its row NULL, and no others."""
    return rounded(correlate.correlations(selected(spark, folder, INFINITE_SQL, "lineitem")))


@query(
    "multicollinearity_lineitem",
    f"SELECT count(*) AS strong_pairs, count(*) > 3 AS warning FROM ({STRONG_SQL})",
)
def multicollinearity_lineitem(spark, folder):
    strong = correlate.strong_correlations(lineitem_derived(spark, folder))
    return correlate.multicollinearity_warning(strong)


RANKS = ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}"
    for c in ("p_partkey", "p_size", "p_retailprice")
)


@query(
    "spearman_part",
    "SELECT i, j, col1, col2, round(r, 6) AS r FROM ("
    + pairs_sql(["p_partkey", "p_size", "p_retailprice"], f"(SELECT {RANKS} FROM part)")
    + ")",
)
def spearman_part(spark, folder):
    return rounded(correlate.spearman(table(spark, folder, "part")))


def bounds_sql(columns: list[str], source: str, method: str) -> str:
    limits = (
        "avg(x) - 3 * stddev_samp(x) AS lower, avg(x) + 3 * stddev_samp(x) AS upper, true AS usable"
        if method == "zscore"
        else """quantile_cont(x, 0.25) - 1.5 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS lower,
            quantile_cont(x, 0.75) + 1.5 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS upper,
            quantile_cont(x, 0.75) <> quantile_cont(x, 0.25) AS usable"""
    )
    cells = union_sql(
        f"SELECT {i} AS col_pos, '{c}' AS col_name, {c}::DOUBLE AS x FROM {source}"
        for i, c in enumerate(columns)
    )
    out = (
        "abs(x - m) > 3 * s AND s > 0" if method == "zscore" else "(x < lower OR x > upper)"
    )
    return f"""WITH cells AS ({cells}),
        bounds AS (SELECT col_name, avg(x) AS m, stddev_samp(x) AS s, {limits} FROM cells
                   GROUP BY col_name HAVING count(x) >= 10),
        flagged AS (SELECT col_pos, col_name, x, lower, upper, {out} AS is_out
                    FROM cells JOIN bounds USING (col_name) WHERE usable),
        report AS (SELECT col_pos, col_name, count(*) FILTER (WHERE is_out) AS n_out, count(x) AS n,
                     any_value(lower) AS lower, any_value(upper) AS upper, avg(x) AS mean_with,
                     avg(x) FILTER (WHERE NOT is_out) AS mean_without
                   FROM flagged GROUP BY col_pos, col_name)
        SELECT col_pos, col_name, n_out AS count, n_out * 100.0::DOUBLE / n AS percent,
          lower, upper, mean_with, mean_without,
          CASE WHEN mean_with = 0 THEN 0 ELSE abs(mean_with - mean_without) / abs(mean_with) * 100 END
            AS impact_pct
        FROM report WHERE n_out > 0"""


OUTLIER_COLUMNS = ["event_id", "user_id", "value", "value_sq", "const_col"]
ROUND_OUTLIERS = "SELECT * REPLACE (" + ", ".join(
    f"round({c}, 6) AS {c}" for c in ("percent", "lower", "upper", "mean_with", "mean_without", "impact_pct")
)


@query("outliers_iqr", f"{ROUND_OUTLIERS}) FROM ({bounds_sql(EVENTS_WIDE, EVENTS_WIDE_SQL, 'iqr')})")
def outliers_iqr(spark, folder):
    return rounded(outliers.outliers(events_wide(spark, folder)))


@query(
    "outliers_zscore", f"{ROUND_OUTLIERS}) FROM ({bounds_sql(EVENTS_WIDE, EVENTS_WIDE_SQL, 'zscore')})"
)
def outliers_zscore(spark, folder):
    return rounded(outliers.outliers(events_wide(spark, folder), method="zscore"))


@query(
    "outliers_iqr_orders",
    f"{ROUND_OUTLIERS}) FROM ({bounds_sql(['o_orderkey', 'o_custkey', 'o_totalprice'], 'orders', 'iqr')})",
)
def outliers_iqr_orders(spark, folder):
    return rounded(outliers.outliers(table(spark, folder, "orders")))


@query(
    "outlier_rows",
    """WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
       SELECT event_id, value,
         value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS value_outlier
       FROM events, b""",
)
def outlier_rows(spark, folder):
    return outliers.flag_outliers(table(spark, folder, "events").select("event_id", "value"), "value")


@query(
    "outlier_rows_zscore",
    """WITH b AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)
       SELECT event_id, value, abs(value - m) > 3 * s AS value_outlier FROM events, b""",
)
def outlier_rows_zscore(spark, folder):
    df = table(spark, folder, "events").select("event_id", "value")
    return outliers.flag_outliers(df, "value", "zscore")


def cardinality_sql(columns: list[str], source: str) -> str:
    return union_sql(
        f"""SELECT {i} AS col_pos, '{c}' AS col_name, n AS n_distinct, ratio AS ratio_pct,
            CASE WHEN ratio > 95 THEN 'id_like' WHEN ratio < 1 THEN 'low_cardinality' ELSE 'mixed' END AS label
        FROM (SELECT count(DISTINCT {c}) AS n,
                printf('%.1f', count(DISTINCT {c}) * 100.0::DOUBLE / count(*))::DOUBLE AS ratio FROM {source})"""
        for i, c in enumerate(columns)
    )


@query(
    "cardinality_orders",
    cardinality_sql(
        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
        "orders",
    ),
)
def cardinality_orders(spark, folder):
    return distribution.cardinality(table(spark, folder, "orders"))


@query(
    "cardinality_documents",
    cardinality_sql(["doc_id", "text", "lang", "source", "n_chars"], "documents"),
)
def cardinality_documents(spark, folder):
    return distribution.cardinality(table(spark, folder, "documents"))


# The explain report on events: every section as (section, subject, metric, value, label).
_EV = EVENTS_WIDE
_N = len(_EV)
_STRONG_EVENTS = f"SELECT * FROM ({pairs_sql(_EV, EVENTS_WIDE_SQL)}) WHERE abs(r) > 0.7"


def _melt_sql(section: str, source: str, subject: str, metrics: list[str], label: str) -> str:
    return union_sql(
        f"""SELECT '{section}' AS section, {subject} AS subject, '{m}' AS metric,
            {m}::DOUBLE AS value, {label} AS label FROM ({source})"""
        for m in metrics
    )


EXPLAIN_SQL = union_sql(
    [
        _melt_sql(
            "shape",
            f"SELECT count(*) AS n_rows, 6 AS n_cols, {_N} AS n_numeric FROM events",
            "'table'",
            ["n_rows", "n_cols", "n_numeric"],
            "NULL",
        ),
        _melt_sql(
            "correlations",
            _STRONG_EVENTS,
            "col1 || '~' || col2",
            ["r"],
            "CASE WHEN r > 0 THEN 'strong_positive' ELSE 'strong_negative' END",
        ),
        _melt_sql(
            "multicollinearity",
            f"SELECT count(*) AS strong_pairs FROM ({_STRONG_EVENTS}) HAVING count(*) > 3",
            "'table'",
            ["strong_pairs"],
            "'warning'",
        ),
        _melt_sql(
            "outliers",
            bounds_sql(_EV, EVENTS_WIDE_SQL, "iqr"),
            "col_name",
            ["count", "percent", "lower", "upper", "impact_pct"],
            "NULL",
        ),
        _melt_sql(
            "distributions",
            distribution_sql(_EV, EVENTS_WIDE_SQL),
            "col_name",
            ["mean", "std", "skewness", "kurtosis", "min", "max"],
            "shape",
        ),
    ]
)


@query(
    "explain_events",
    f"SELECT section, subject, metric, round(value, 5) AS value, label FROM ({EXPLAIN_SQL})",
)
def explain_events(spark, folder):
    return rounded(explain.explain(events_wide(spark, folder)).table(), 5)


_OUT_EVENTS = bounds_sql(_EV, EVENTS_WIDE_SQL, "iqr")
_DIST_EVENTS = distribution_sql(_EV, EVENTS_WIDE_SQL)


@query(
    "summary_events",
    f"""WITH outs AS ({_OUT_EVENTS}), dist AS ({_DIST_EVENTS}), strong AS ({_STRONG_EVENTS}),
      sk AS (SELECT col_pos, col_name FROM dist WHERE abs(printf('%.3f', skewness)::DOUBLE) > 1
             ORDER BY col_pos LIMIT 3),
      top AS (SELECT * FROM strong ORDER BY -abs(printf('%.3f', r)::DOUBLE), i, j LIMIT 3),
      firsts AS (SELECT col_pos, col_name FROM outs ORDER BY col_pos LIMIT 3)
    SELECT (SELECT count(*) FROM events) AS n_rows,
      (SELECT count(*) FROM outs) AS n_outlier_columns,
      (SELECT sum(count)::BIGINT FROM outs) AS n_outliers,
      coalesce((SELECT string_agg(col_name, ', ' ORDER BY col_pos) FROM firsts), '') AS outlier_columns,
      coalesce((SELECT string_agg(col_name, ', ' ORDER BY col_pos) FROM sk), '') AS skewed_columns,
      coalesce((SELECT string_agg(col1 || '~' || col2 || ' (r=' || printf('%.3f', r) || ')', ', '
         ORDER BY -abs(printf('%.3f', r)::DOUBLE), i, j) FROM top), '') AS top_correlations,
      (SELECT count(*) FROM outs) + (SELECT count(*) FROM strong) AS alerts""",
)
def summary_events(spark, folder):
    found = explain.explain(events_wide(spark, folder))
    alerts = found.alerts().first()["alerts"]
    return found.summary().select(
        "n_rows",
        F.lit(found.outliers.count()).cast("bigint").alias("n_outlier_columns"),
        "n_outliers",
        "outlier_columns",
        "skewed_columns",
        "top_correlations",
        F.lit(alerts).cast("bigint").alias("alerts"),
    )


@query(
    "insights_events",
    f"""WITH outs AS ({_OUT_EVENTS}), strong AS ({_STRONG_EVENTS}),
      a AS (SELECT 1 AS part, row_number() OVER (ORDER BY -abs(printf('%.3f', r)::DOUBLE), i, j) AS o,
              col1 || ' and ' || col2 || ': '
              || CASE WHEN r > 0 THEN 'strong_positive' ELSE 'strong_negative' END
              || ' (r=' || printf('%.3f', r) || ')' AS insight FROM strong),
      b AS (SELECT 2 AS part, row_number() OVER (ORDER BY col_pos) AS o,
              col_name || ': ' || count || ' outliers (' || printf('%.1f', percent)
              || '%) shift the mean by ' || printf('%.1f', impact_pct) || '%' AS insight FROM outs)
    SELECT row_number() OVER (ORDER BY part, o)::INTEGER AS rank, insight
    FROM (SELECT * FROM a WHERE o <= 2 UNION ALL SELECT * FROM b WHERE o <= 2)""",
)
def insights_events(spark, folder):
    return explain.explain(events_wide(spark, folder)).insights()


# The profile of a table with missing cells: shape, distributions, missing cells and cardinality.
_INJECTED_NUMBERS = INJECTED[:3]
PROFILE_SQL = union_sql(
    [
        _melt_sql(
            "shape",
            f"SELECT count(*) AS n_rows, {len(INJECTED)} AS n_cols, {len(_INJECTED_NUMBERS)} AS n_numeric FROM lineitem",
            "'table'",
            ["n_rows", "n_cols", "n_numeric"],
            "NULL",
        ),
        _melt_sql(
            "distributions",
            distribution_sql(_INJECTED_NUMBERS, INJECTED_SQL),
            "col_name",
            ["mean", "std", "skewness", "kurtosis", "min", "max"],
            "shape",
        ),
        _melt_sql("missing", SQL["missing_injected"], "col_name", ["null_count", "percent"], "NULL"),
        _melt_sql("missing_pattern", SQL["missing_pattern_injected"], "'table'", ["spread"], "pattern"),
        _melt_sql("cardinality", cardinality_sql(INJECTED, INJECTED_SQL), "col_name", ["n_distinct", "ratio_pct"], "label"),
    ]
)


@query(
    "profile_injected",
    f"SELECT section, subject, metric, round(value, 5) AS value, label FROM ({PROFILE_SQL})",
)
def profile_injected(spark, folder):
    return rounded(explain.explain(lineitem_injected(spark, folder), action="profile").table(), 5)


@query(
    "explain_missing",
    f"""SELECT section, subject, metric, round(value, 5) AS value, label FROM ({PROFILE_SQL})
        WHERE section LIKE 'missing%' OR section = 'shape'""",
)
def explain_missing(spark, folder):
    """The sections on missing cells of the whole report."""
    found = explain.explain(lineitem_injected(spark, folder)).table()
    return rounded(found.where("section LIKE 'missing%' OR section = 'shape'"), 5)
