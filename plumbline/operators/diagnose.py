"""Feature diagnosis: data issues, rule-based recommendations, severity."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import (
    half_even,
    identity,
    number_text,
    numeric_columns,
    plain_columns,
    present,
    quoted,
)
from ..functions.shared_pass import SharedPass
from .correlate import correlations, named_pairs
from .profile import column_facts, facts_table, fixed

# Decision limits and name patterns of the diagnosis.
PAIR_THRESHOLD = 0.7
REDUNDANT_ABOVE = 0.95
LOW_VARIANCE_BELOW = 1e-6
SKEWED_ABOVE = 2
CATEGORY_VALUES = 10
BALANCED_FROM = 0.5
WEIGHTS_ABOVE = 0.2
UNUSED_WORTH_ADDING = 5
ROLLING_WINDOWS = (5, 10, 50)
VELOCITY_NAMES = ("velocity", "speed")
ACCELERATION_NAMES = ("accel",)
SCALE_RATIO = 100
SCALE_GUARD = 1e-10
CRITICAL_PAIRS = 3
CRITICAL_RATIO = 0.3
WARNING_SKEWED = 3


@dataclass(frozen=True)
class Lengths:
    """How many entries the lists of a diagnosis hold and look at; None is all."""

    used: int | None = None  # numeric columns taken as used if none are named
    unused: int | None = None
    pairs: int | None = None
    skewed: int | None = None
    dropped: int | None = None
    candidates: int | None = None
    rolling: int | None = None
    scaled: int | None = None


ALL = Lengths()
# The lengths of a short report.
SHORT = Lengths(used=20, unused=15, pairs=20, skewed=10, dropped=5, candidates=10, rolling=6, scaled=20)


def unused_columns(
    df: DataFrame, used: str | Sequence[str] | None = None, lengths: Lengths = ALL
) -> DataFrame:
    """One row: columns available, numeric, used, and the unused numeric ones."""
    numeric = numeric_columns(df)
    taken = _used(df, used, lengths)
    idle = [c for c in numeric if c not in taken][: lengths.unused]
    return df.sparkSession.createDataFrame(
        [(len(df.columns), len(numeric), len(taken), idle)],
        "available int, numeric_available int, used int, unused_numeric array<string>",
    )


def _used(df: DataFrame, used: str | Sequence[str] | None, lengths: Lengths) -> list[str]:
    if not used:
        return numeric_columns(df)[: lengths.used]
    names = used.split(",") if isinstance(used, str) else used
    return [c.strip() for c in names if c.strip()]


def _first(report: DataFrame, n: int | None) -> DataFrame:
    return report if n is None else report.limit(n)


def multicollinear_pairs(
    df: DataFrame,
    threshold: float = PAIR_THRESHOLD,
    pairs: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Pairs with ``abs(r) >= threshold``, strongest first, and what to do about each."""
    pairs = pairs if pairs is not None else correlations(df)
    size = F.abs("r")
    found = (
        pairs.where(size >= threshold)
        .select(
            "i",
            "j",
            "col1",
            "col2",
            half_even(size, 4).alias("r"),
            F.when(size > REDUNDANT_ABOVE, "drop_one").otherwise("monitor").alias("action"),
        )
        .orderBy(-F.col("r"), "i", "j")
    )
    return _first(found, limit)


def low_variance(df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    facts = facts if facts is not None else column_facts(df)
    return facts.where(F.col("std") < LOW_VARIANCE_BELOW).select("col_pos", "col_name", "std")


def skewed_features(df: DataFrame, facts: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """The strongly skewed columns, in column order."""
    facts = facts if facts is not None else column_facts(df, shape=True)
    skew = F.col("skewness")
    found = (
        facts.where((F.col("std") > 0) & (F.abs(skew) > SKEWED_ABOVE))
        .select(
            "col_pos",
            "col_name",
            half_even(skew, 2).alias("skewness"),
            F.when(skew > SKEWED_ABOVE, "log_transform").otherwise("reflect_log").alias("action"),
        )
        .orderBy("col_pos")
    )
    return _first(found, limit)


def value_counts(
    df: DataFrame, columns: Sequence[str], cell: Callable[[DataFrame, str], Column] = present
) -> DataFrame:
    """``(col_name, value, n)`` of present values, as text. Combined in the map tasks."""
    cells = df.select(*[cell(df, c).cast("string").alias(c) for c in columns]).unpivot(
        [], [F.col(quoted(c)) for c in columns], "col_name", "value"
    )
    return (
        cells.where(F.col("value").isNotNull())
        .groupBy("col_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def class_sizes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of distinct values and the rarest and commonest count, per column."""
    return (
        value_counts(df, columns, identity)
        .groupBy("col_name")
        .agg(
            F.count(F.lit(1)).alias("n_classes"),
            F.min("n").alias("smallest"),
            F.max("n").alias("largest"),
        )
    )


def hashed_columns(df: DataFrame) -> list[str]:
    """Columns whose few distinct values a pass can tell from many: all plain ones but text."""
    return [c for c in plain_columns(df) if not isinstance(df.schema[c].dataType, T.StringType)]


def category_candidates(df: DataFrame, state: SharedPass | None = None) -> list[str]:
    """Text columns, and columns that a pass over the whole table doesn't rule out.

    ``state`` is a pass with the distinct values of ``hashed_columns``.
    """
    others = hashed_columns(df)
    state = state or SharedPass(df, [], distinct=others)
    few = state.few_values(CATEGORY_VALUES)
    return [c for c in plain_columns(df) if c in few or c not in others]


def categorical_columns(df: DataFrame) -> DataFrame:
    """``(col_pos, col_name, n_classes)``: text columns, or at most ten distinct values."""
    found = category_candidates(df)
    position = F.array(*[F.lit(c) for c in df.columns])
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    listed = df.sparkSession.createDataFrame(
        [(c, c in texts) for c in found], "col_name string, is_text boolean"
    )
    if found:
        # One row per column.
        table = listed.join(F.broadcast(class_sizes(df, found)), "col_name", "left")
    else:
        table = listed.withColumn("n_classes", F.lit(0).cast("bigint"))
    return (
        table.withColumn("n_classes", F.coalesce("n_classes", F.lit(0)))
        .where(F.col("is_text") | (F.col("n_classes") <= CATEGORY_VALUES))
        .select(
            (F.array_position(position, F.col("col_name")) - 1).cast("int").alias("col_pos"),
            "col_name",
            "n_classes",
        )
        .orderBy("col_pos")
    )


_IMBALANCE = (
    "target_column string, n_classes bigint, smallest bigint, largest bigint,"
    " ratio double, action string"
)


def class_imbalance(df: DataFrame, target: str | None = None, state: SharedPass | None = None) -> DataFrame:
    """One row for the last imbalanced class column (or for ``target``), or none."""
    order = {c: i for i, c in enumerate(df.columns)}
    names = [target] if target is not None else category_candidates(df, state)
    if not names:
        return df.sparkSession.createDataFrame([], _IMBALANCE)
    text = [c for c in names if c == target or isinstance(df.schema[c].dataType, T.StringType)]
    ratio = F.col("smallest") / F.col("largest")
    hits = (
        class_sizes(df, names)
        .where(F.col("col_name").isin(text) | (F.col("n_classes") <= CATEGORY_VALUES))
        .where((F.col("n_classes") >= 2) & (ratio < BALANCED_FROM))
        .withColumn("exact", ratio)
        .collect()
    )
    winner = max(hits, key=lambda h: order[h.col_name], default=None)
    if winner is None:
        return df.sparkSession.createDataFrame([], _IMBALANCE)
    row = df.sparkSession.createDataFrame(
        [(winner.col_name, winner.n_classes, winner.smallest, winner.largest, winner.exact)],
        _IMBALANCE.rsplit(",", 1)[0],
    )
    return row.select(
        "target_column",
        "n_classes",
        "smallest",
        "largest",
        half_even(F.col("ratio"), 3).alias("ratio"),
        F.when(F.col("ratio") > WEIGHTS_ABOVE, "class_weight").otherwise("oversampling").alias("action"),
    )


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """``(value, n)`` of a class column, in long form however many classes there are."""
    return value_counts(df, [target]).select("value", "n")


@dataclass(frozen=True)
class Diagnosis:
    """Reports of one table, each at most as long as its number of columns."""

    unused: DataFrame
    multicollinearity: DataFrame
    low_variance: DataFrame
    skewed: DataFrame
    imbalance: DataFrame
    recommendations: DataFrame
    verdict: DataFrame


def diagnose(
    df: DataFrame,
    used: str | Sequence[str] | None = None,
    threshold: float = PAIR_THRESHOLD,
    target: str | None = None,
    lengths: Lengths = ALL,
) -> Diagnosis:
    """All data issues of a table and the recommendations that follow from them.

    Every column is looked at and listed; ``lengths=SHORT`` gives a short report.
    """
    numeric = numeric_columns(df)
    state = SharedPass(df, numeric, pairs=True, distinct=hashed_columns(df) if target is None else [])
    facts = facts_table(state)
    strong = multicollinear_pairs(df, threshold, named_pairs(state.pairs(), numeric), lengths.pairs)
    pairs = fixed(strong)
    skewed = fixed(skewed_features(df, facts, lengths.skewed))
    imbalance = class_imbalance(df, target, state)
    signals = _signals(df, used, facts, pairs, skewed, imbalance, lengths)
    return Diagnosis(
        unused=unused_columns(df, used, lengths),
        multicollinearity=pairs,
        low_variance=low_variance(df, facts),
        skewed=skewed,
        imbalance=imbalance,
        recommendations=_recommendations(signals),
        verdict=_verdict(signals),
    )


def _signals(df, used, facts, pairs, skewed, imbalance, lengths: Lengths) -> DataFrame:
    """One row with everything the rules look at."""

    def items(kind: str, report: DataFrame, order: Column, text: Column, value: Column):
        return report.select(
            F.lit(kind).alias("kind"),
            order.cast("double").alias("o"),
            text.cast("string").alias("text"),
            value.cast("double").alias("value"),
        )

    nothing = F.lit(None)
    rank = F.struct(-F.col("r"), F.col("i"), F.col("j"))
    redundant = pairs.where(F.col("r") > REDUNDANT_ABOVE)
    ranked = redundant.agg(F.array_sort(F.collect_list(F.struct(rank.alias("k"), "col2"))).alias("a"))
    ranked = ranked.select(F.posexplode("a").alias("pos", "e")).select("pos", "e.col2")
    numeric = numeric_columns(df)
    moving = [c for names in (VELOCITY_NAMES, ACCELERATION_NAMES) for c in numeric if any(n in c.lower() for n in names)]
    spread = facts.where(F.col("max") > F.col("min"))
    if lengths.scaled is not None:
        spread = spread.where(F.col("col_pos") < lengths.scaled)
    rows = reduce(
        DataFrame.union,
        [
            items("redundant", ranked, F.col("pos"), F.col("col2"), nothing),
            items("skewed", skewed, F.col("col_pos"), F.col("col_name"), nothing),
            items("range", spread, F.col("col_pos"), nothing, F.col("max") - F.col("min")),
            items("target", imbalance, F.lit(0), F.col("target_column"), F.col("ratio")),
            items("action", imbalance, F.lit(0), F.col("action"), nothing),
        ],
    )

    def listed(kind: str, limit: int | None) -> Column:
        mine = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("o", "text"))))
        return F.transform(mine if limit is None else F.slice(mine, 1, limit), lambda s: s["text"])

    def one(kind: str, name: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(name)))

    taken = _used(df, used, lengths)
    idle = [c for c in numeric if c not in taken][: lengths.candidates]
    reach = F.when(F.col("kind") == "range", F.col("value"))

    def texts(values: Sequence[str]) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    return rows.agg(
        F.count_if(F.col("kind") == "redundant").alias("n_redundant"),
        listed("redundant", lengths.dropped).alias("redundant"),
        F.count_if(F.col("kind") == "skewed").alias("n_skewed"),
        listed("skewed", None).alias("skewed"),
        one("target", "text").alias("target"),
        one("target", "value").alias("ratio"),
        one("action", "text").alias("balance_action"),
        F.coalesce(F.max(reach) / (F.min(reach) + SCALE_GUARD), F.lit(0.0)).alias("scale"),
    ).select(
        "*",
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(len(taken)).alias("n_used"),
        F.lit(len(numeric) - len(taken)).alias("n_unused"),
        texts(idle).alias("unused"),
        texts(moving[: lengths.rolling]).alias("moving"),
    )


def _recommendations(signals: DataFrame) -> DataFrame:
    """The rules that fire, numbered in rule order."""
    ratio = number_text(F.col("ratio"), 3)
    no_columns = F.array().cast("array<string>")

    def rule(fires, category, action, text, columns, impact, windows=()):
        return F.struct(
            fires.alias("fires"),
            F.lit(category).alias("category"),
            (F.lit(action) if isinstance(action, str) else action).alias("action"),
            text.alias("description"),
            columns.alias("columns"),
            F.array(*[F.lit(w) for w in windows]).cast("array<int>").alias("window_sizes"),
            F.lit(impact).alias("expected_impact"),
        )

    def counted(name: str, tail: str) -> Column:
        return F.concat(F.col(name).cast("string"), F.lit(tail))

    rules = F.array(
        rule(
            F.col("n_redundant") > 0, "multicollinearity", "drop_redundant",
            counted("n_redundant", " nearly identical column pairs; drop one of each"),
            F.col("redundant"), "steadier model",
        ),
        rule(
            F.col("n_unused") > UNUSED_WORTH_ADDING, "feature_selection", "add_features",
            counted("n_unused", " numeric columns are not used"),
            F.col("unused"), "more signal for the model",
        ),
        rule(
            F.col("n_skewed") > 0, "distribution", "transform_skewed",
            counted("n_skewed", " strongly skewed columns; take logs or roots"),
            F.col("skewed"), "closer to normal, more stable training",
        ),
        rule(
            F.col("target").isNotNull(), "class_imbalance", F.col("balance_action"),
            F.concat(F.lit("class ratio "), ratio), F.array("target"),
            "fewer missed cases of the rare class",
        ),
        rule(
            F.size("moving") > 0, "feature_engineering", "add_rolling_stats",
            F.lit("sensor columns; add rolling mean and deviation"),
            F.col("moving"), "captures patterns over time", ROLLING_WINDOWS,
        ),
        rule(
            F.col("scale") > SCALE_RATIO, "preprocessing", "standardize",
            F.lit("column ranges differ widely"), no_columns, "faster, steadier training",
        ),
    )
    fired = signals.select(F.filter(rules, lambda r: r["fires"]).alias("fired"))
    return fired.select(F.posexplode("fired").alias("pos", "r")).select(
        (F.col("pos") + 1).alias("priority"),
        *[
            f"r.{c}"
            for c in ("category", "action", "description", "columns", "window_sizes", "expected_impact")
        ],
    )


def _verdict(signals: DataFrame) -> DataFrame:
    redundant, skewed = F.col("n_redundant"), F.col("n_skewed")
    severity = (
        F.when((redundant >= CRITICAL_PAIRS) | (F.col("ratio") < CRITICAL_RATIO), "critical")
        .when((redundant >= 1) | (skewed >= WARNING_SKEWED), "warning")
        .otherwise("info")
    )
    sentence = F.concat_ws(
        ". ",
        F.concat(F.col("n_used").cast("string"), F.lit(" of "), F.col("n_columns").cast("string"), F.lit(" columns used")),
        F.when(redundant > 0, F.concat(redundant.cast("string"), F.lit(" redundant pairs"))),
        F.when(F.col("ratio").isNotNull(), F.concat(F.lit("class imbalance (ratio "), number_text(F.col("ratio"), 3), F.lit(")"))),
        F.when(skewed > 0, F.concat(skewed.cast("string"), F.lit(" strongly skewed columns"))),
    )
    rules_fired = (
        (redundant > 0).cast("int")
        + (F.col("n_unused") > UNUSED_WORTH_ADDING).cast("int")
        + (skewed > 0).cast("int")
        + F.col("target").isNotNull().cast("int")
        + (F.size("moving") > 0).cast("int")
        + (F.col("scale") > SCALE_RATIO).cast("int")
    )
    return signals.select(
        severity.alias("severity"),
        F.concat(sentence, F.lit(".")).alias("summary"),
        rules_fired.alias("n_recommendations"),
    )


def diagnosis_report(diagnosis: Diagnosis, traced: DataFrame, job_id: str) -> DataFrame:
    """One row: the verdict on the data beside the results of the run trained on it."""
    run = traced.where(F.col("job_id") == job_id).select(
        "job_id",
        F.col("accuracy_last").alias("accuracy"),
        "convergence",
        "loss_trend",
        "tp",
        "fp",
        "fn",
        "tn",
        "features_used",
    )
    return (
        diagnosis.verdict.withColumn("job_id", F.lit(job_id))
        .join(F.broadcast(run), "job_id", "left")
        .withColumn("convergence", F.coalesce("convergence", F.lit("unknown")))
    )


def compact_diagnosis(report: DataFrame) -> DataFrame:
    return report.select(
        "severity", "summary", "n_recommendations", "accuracy", "convergence"
    )
