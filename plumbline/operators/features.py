"""Feature transforms that the recommendations name.

Transforms that need statistics have a ``fit`` that computes them once (one row
per column or class) and an ``apply`` that is a projection, so that a test split
can be transformed with the statistics of the training split.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.columns import as_double, numeric_columns, present, quoted
from ..functions.numbering import numbered
from ..session import cut_lineage
from .diagnose import ROLLING_WINDOWS
from .distribution import cardinality
from .profile import column_facts

MAX_CLASSES = 100_000
HOT_ROWS = 5_000_000
HOT_KEYS_BROADCAST = 100_000
ROLLING_BLOCK = 1_000_000


def drop_redundant(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*dict.fromkeys(columns))


def drop_id_columns(
    df: DataFrame, columns: Sequence[str] | None = None, leaky: Sequence[str] = ()
) -> DataFrame:
    """Drop the named columns, by default those whose values look like row ids, and the ``leaky`` ones.

    Whether a measure looks like ids depends on the number of rows: its values are all different in
    a small table and repeat in a large one. Name it to have it dropped from both.
    """
    if columns is None:
        table = cardinality(df).where(F.col("label") == "id_like")
        columns = [r.col_name for r in table.collect()]
    return df.drop(*columns, *leaky)


def fit_numeric(df: DataFrame, columns: str | Sequence[str] | None = None) -> dict[str, dict]:
    """Count, mean, deviation and extremes of each numeric column."""
    return {r.col_name: r.asDict() for r in column_facts(df, columns).collect()}


def _extreme(fit: Mapping[str, dict], c: str, name: str) -> Column:
    return F.lit(fit[c][name]).cast("double")


def log_transform(df: DataFrame, columns: Sequence[str], fit: Mapping[str, dict] | None = None) -> DataFrame:
    """``log1p(x - min)``; NULL for values 1 or more below the fitted minimum."""
    if not columns:
        return df
    fit = fit or fit_numeric(df, columns)
    return df.withColumns({c: F.log1p(as_double(df, c) - _extreme(fit, c, "min")) for c in columns})


def reflect_log(df: DataFrame, columns: Sequence[str], fit: Mapping[str, dict] | None = None) -> DataFrame:
    """``log1p(max - x)`` for columns with a long left tail."""
    if not columns:
        return df
    fit = fit or fit_numeric(df, columns)
    return df.withColumns({c: F.log1p(_extreme(fit, c, "max") - as_double(df, c)) for c in columns})


def sqrt_transform(df: DataFrame, columns: Sequence[str], fit: Mapping[str, dict] | None = None) -> DataFrame:
    """``sqrt(x - min)``; NULL below the fitted minimum."""
    fit = fit or fit_numeric(df, columns)
    moved = {c: as_double(df, c) - _extreme(fit, c, "min") for c in columns}
    return df.withColumns({c: F.when(x >= 0, F.sqrt(x)) for c, x in moved.items()})


def standardize(
    df: DataFrame, columns: Sequence[str] | None = None, fit: Mapping[str, dict] | None = None
) -> DataFrame:
    """``(x - mean) / std`` with the population deviation; a constant column gives 0."""
    names = numeric_columns(df, columns)
    fit = fit or fit_numeric(df, names)
    scaled = {}
    for c in names:
        f, x = fit[c], as_double(df, c)
        flat = f["n"] == 0 or f["min"] == f["max"]
        std = None if flat else f["std"] * math.sqrt((f["n"] - 1) / f["n"])
        scaled[c] = F.when(x.isNotNull(), 0.0) if flat else (x - F.lit(f["mean"])) / F.lit(std)
    return df.withColumns(scaled)


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """``(class, n, weight, pos_weight)`` with weight ``rows / (classes * n)``.

    ``pos_weight`` is the number of other rows per row of the class.
    """
    return _class_weights(df, target)[0]


def _class_weights(df: DataFrame, target: str) -> tuple[DataFrame, int]:
    classes = (
        df.where(present(df, target).isNotNull())
        .groupBy(F.col(quoted(target)).alias("class"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rows, k = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    weights = classes.select(
        "class",
        "n",
        (F.lit(float(rows)) / (F.lit(k) * F.col("n"))).alias("weight"),
        ((F.lit(rows) - F.col("n")) / F.col("n")).alias("pos_weight"),
    )
    return weights, k


def add_class_weight(df: DataFrame, target: str, name: str = "class_weight") -> DataFrame:
    """The table with the weight of each row's class.

    The weights are broadcast if the classes are few; otherwise Spark picks the join.
    """
    weights, k = _class_weights(df, target)
    weights = weights.select(F.col("class").alias(target), F.col("weight").alias(name))
    joined = df.join(F.broadcast(weights) if k <= MAX_CLASSES else weights, target, "left")
    return joined.select(*[F.col(quoted(c)) for c in df.columns], name)


def oversample(df: DataFrame, target: str, key: str) -> DataFrame:
    """Repeat rows until every class is as large as the largest one.

    Each row of a class of n gets ``max div n`` copies; the ``max mod n`` rows
    with the smallest ``key`` (unique) get one more. Rows are numbered in ranges
    of (class, key), so no class is ranked in one task, and the plan of the
    classes is joined, broadcast only if they are few. Rows without a class stay.
    """
    label = present(df, target)
    classes = df.where(label.isNotNull()).select(F.col(quoted(target)).alias("_class"), F.col(quoted(key)).alias("_key"))
    sizes = cut_lineage(classes.groupBy("_class").agg(F.count(F.lit(1)).alias("_n")))
    k, largest = sizes.agg(F.count(F.lit(1)), F.max("_n")).first()
    last = F.lit(largest) % F.col("_n")
    places = numbered(classes, "_class", ["_key"], "_nth")
    cut = places.join(sizes, "_class").where(F.col("_nth") == last).select("_class", F.col("_key").alias("_upto"))
    plan = cut_lineage(
        sizes.join(cut, "_class", "left").select("_class", F.floor(F.lit(largest) / F.col("_n")).alias("_copies"), "_upto")
    )
    planned = df.join(F.broadcast(plan) if k <= MAX_CLASSES else plan, F.col(quoted(target)) == F.col("_class"), "left")
    more = F.when(F.col(quoted(key)) <= F.col("_upto"), 1).otherwise(0)
    copies = F.coalesce(F.col("_copies") + more, F.lit(1))
    return planned.select(
        *[F.col(quoted(c)) for c in df.columns],
        F.explode(F.sequence(F.lit(1).cast("bigint"), copies)).alias("copy_no"),
    )


def rolling_stats(
    df: DataFrame,
    columns: Sequence[str],
    partition_by: str,
    order_by: Sequence[str],
    windows: Sequence[int] = ROLLING_WINDOWS,
    hot_rows: int = HOT_ROWS,
    block: int = ROLLING_BLOCK,
) -> DataFrame:
    """Rolling mean and deviation per key over the last w rows, NULL until w values.

    Adds ``<column>_mean_<w>`` and ``<column>_std_<w>``. ``order_by`` must order
    the rows of a key without ties. A key of more than ``hot_rows`` rows would be
    sorted in one task, so its rows are numbered in ranges of the order columns,
    then windowed in blocks of ``block`` rows, each block carrying the rows just
    before it.
    """
    sizes = df.groupBy(F.col(quoted(partition_by)).alias("_roll_key")).agg(F.count(F.lit(1)).alias("_roll_n"))
    hot = cut_lineage(sizes.where(F.col("_roll_n") > hot_rows).select("_roll_key"))
    n_hot = hot.count()
    plain = W.partitionBy(quoted(partition_by)).orderBy(*order_by)
    if n_hot == 0:
        return df.withColumns(_rolling(df, columns, windows, plain))
    if n_hot <= HOT_KEYS_BROADCAST:
        hot = F.broadcast(hot)
    same = F.col(quoted(partition_by)).eqNullSafe(F.col("_roll_key"))
    cold = df.join(hot, same, "left_anti")
    slow = cold.withColumns(_rolling(df, columns, windows, plain))
    fast = _rolling_in_blocks(df, df.join(hot, same), columns, order_by, windows, block)
    return slow.unionByName(fast.select(*slow.columns))


def _rolling(df: DataFrame, columns, windows, spec) -> dict[str, Column]:
    added = {}
    for c in columns:
        x = as_double(df, c)
        for w in windows:
            frame = spec.rowsBetween(-(w - 1), 0)
            full = F.count(x).over(frame) >= w
            added[f"{c}_mean_{w}"] = F.when(full, F.avg(x).over(frame))
            added[f"{c}_std_{w}"] = F.when(full, F.stddev_samp(x).over(frame))
    return added


def _rolling_in_blocks(df, rows, columns, order_by, windows, block):
    halo = max(windows) - 1
    block = max(block, halo + 1)
    placed = numbered(rows, "_roll_key", order_by, "_roll_place")
    placed = placed.withColumn("_roll_place", F.col("_roll_place") - 1)
    own = F.floor(F.col("_roll_place") / block)
    near_end = F.col("_roll_place") % block >= block - halo
    targets = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    spread = placed.select("*", F.explode(targets).alias("_roll_block"))
    spec = W.partitionBy("_roll_key", "_roll_block").orderBy("_roll_place")
    return spread.withColumns(_rolling(df, columns, windows, spec)).where(F.col("_roll_block") == own)


def fit_one_hot(df: DataFrame, column: str, max_values: int = 100) -> list:
    """Distinct present values in order; more than ``max_values`` is an error."""
    values = (
        df.where(F.col(quoted(column)).isNotNull())
        .select(F.col(quoted(column)).alias("v"))
        .distinct()
        .limit(max_values + 1)
        .collect()
    )
    if len(values) > max_values:
        raise ValueError(f"{column} has over {max_values} values; one_hot_index numbers any number of them")
    return sorted(r.v for r in values)


def one_hot_index(df: DataFrame, column: str) -> DataFrame:
    """The sparse form for any number of values: ``<column>_index`` is the place of the row's 1, from 0.

    Values are numbered in order; a missing value has no place.
    """
    values = df.where(present(df, column).isNotNull()).select(F.col(quoted(column)).alias("_value")).distinct()
    places = numbered(values.withColumn("_all", F.lit(0)), "_all", ["_value"], "_place")
    places = places.select("_value", (F.col("_place") - 1).alias(f"{column}_index"))
    joined = df.join(places, F.col(quoted(column)) == F.col("_value"), "left")
    return joined.select(*[F.col(quoted(c)) for c in df.columns], quoted(f"{column}_index"))


def one_hot(df: DataFrame, column: str, values: Sequence | None = None, max_values: int = 100) -> DataFrame:
    """Replace ``column`` by one 0/1 column per value, ``<column>_<value>``."""
    values = values if values is not None else fit_one_hot(df, column, max_values)
    col = F.col(quoted(column))
    flags = {
        f"{column}_{v}": F.when(col.eqNullSafe(F.lit(v)), 1).otherwise(0) for v in values
    }
    return df.withColumns(flags).drop(column)


def apply_recommendations(
    df: DataFrame,
    recommendations: DataFrame,
    *,
    target: str | None = None,
    key: str | None = None,
    partition_by: str | None = None,
    order_by: Sequence[str] | None = None,
    skew_actions: Mapping[str, str] | None = None,
) -> DataFrame:
    """Apply the recommended transforms in priority order (six at most).

    Rolling statistics need ``partition_by`` and ``order_by``, oversampling needs
    ``key``; without them that step is an error rather than silently left out.
    ``skew_actions`` maps a column to ``reflect_log``; the default is the log.
    """
    protected = {target, key, partition_by, *(order_by or [])}
    for step in recommendations.orderBy("priority").collect():
        have = [c for c in dict.fromkeys(step["columns"]) if c in df.columns]
        action = step["action"]
        if action == "drop_redundant":
            df = drop_redundant(df, [c for c in have if c not in protected])
        elif action == "add_features":
            pass  # the columns are in the table already; the model has to read them
        elif action == "transform_skewed":
            chosen = skew_actions or {}
            have = [c for c in have if c not in protected]
            reflected = [c for c in have if chosen.get(c) == "reflect_log"]
            df = log_transform(df, [c for c in have if c not in reflected])
            df = reflect_log(df, reflected)
        elif action == "class_weight":
            df = add_class_weight(df, target or have[0])
            protected |= {"class_weight", target or have[0]}
        elif action == "oversampling":
            if key is None:
                raise ValueError("oversampling needs a unique key column")
            df = oversample(df, target or have[0], key).drop("copy_no")
            protected.add(target or have[0])
        elif action == "add_rolling_stats":
            if partition_by is None or not order_by:
                raise ValueError("rolling statistics need partition_by and order_by")
            df = rolling_stats(df, have, partition_by, order_by, step["window_sizes"])
        elif action == "standardize":
            df = standardize(df, [c for c in numeric_columns(df) if c not in protected])
        else:
            raise ValueError(f"unknown action {action}")
    return df
