"""Column selection and the treatment of missing values.

NULL and NaN both mean "missing" everywhere in this package. Spark's own
aggregates let one NaN poison an average, so floating columns are normalised
once, at the point where they enter an analysis.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)


def wanted_columns(df: DataFrame, columns: str | Sequence[str] | None) -> list[str]:
    """Requested columns in the order asked for; names the table lacks are dropped.

    ``columns`` is a comma list, a sequence, or nothing (= every column).
    """
    if not columns:
        return list(df.columns)
    names = columns.split(",") if isinstance(columns, str) else columns
    have = set(df.columns)
    return [n for n in (name.strip() for name in names) if n in have]


def project(df: DataFrame, columns: str | Sequence[str] | None) -> DataFrame:
    return df.select(*[F.col(quoted(c)) for c in wanted_columns(df, columns)])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def is_numeric(dtype: T.DataType, include_decimal: bool = False) -> bool:
    """Signed integers and floats; booleans never, decimals only on request."""
    if isinstance(dtype, INTEGRAL + FLOATING):
        return True
    return include_decimal and isinstance(dtype, T.DecimalType)


def numeric_columns(
    df: DataFrame,
    columns: str | Sequence[str] | None = None,
    include_decimal: bool = False,
) -> list[str]:
    types = {f.name: f.dataType for f in df.schema}
    return [c for c in wanted_columns(df, columns) if is_numeric(types[c], include_decimal)]


def plain_columns(df: DataFrame, columns: str | Sequence[str] | None = None) -> list[str]:
    """Columns whose values can be compared and counted (no nested types)."""
    types = {f.name: f.dataType for f in df.schema}
    return [c for c in wanted_columns(df, columns) if not isinstance(types[c], NESTED)]


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL, in its own type."""
    col = F.col(quoted(name))
    if isinstance(df.schema[name].dataType, FLOATING):
        return F.when(~F.isnan(col), col)
    return col


LONG_TEXT = 64


def identity(df: DataFrame, name: str) -> Column:
    """The present value, long text replaced by its SHA-256, for counting equal values.

    Whole documents would otherwise travel through the shuffle to be counted. A
    digest has 64 characters and only longer text is replaced, so the two kinds
    differ as surely as SHA-256 has no collisions.
    """
    col = present(df, name)
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.when(F.length(col) > LONG_TEXT, F.sha2(col, 256)).otherwise(col)
    return col


def as_double(df: DataFrame, name: str) -> Column:
    return present(df, name).cast("double")


def column_index(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column of the analysis: position, name, Spark type."""
    types = dict(df.dtypes)
    return df.sparkSession.createDataFrame(
        [(i, c, types[c]) for i, c in enumerate(columns)],
        "col_pos int, col_name string, dtype string",
    )


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(col_name, x)``, one row per cell of the numeric ``columns``.

    This is the shape most statistics use: the group key is the column name, a
    handful of values, so partial aggregation shrinks each task's output to one
    row per column before anything is shuffled, whatever the table size, and the
    generated code stays small however wide the table is.
    """
    cells = df.select(*[as_double(df, c).alias(c) for c in columns])
    return cells.unpivot([], [F.col(quoted(c)) for c in columns], "col_name", "x")


def with_position(stats: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Complete per-column statistics to one row per column, in column order.

    ``stats`` holds at most one row per column, so the broadcast is bounded by
    the width of the table.
    """
    return column_index(df, columns).join(F.broadcast(stats), "col_name", "left")


def clock_seconds(df: DataFrame, name: str) -> Column:
    """A time as seconds, in the order of the clock that wrote it.

    Zone-free times and ISO text are counted as written: going through the
    session's zone would bend the scale where clocks change.
    """
    col, dtype = F.col(quoted(name)), df.schema[name].dataType
    if isinstance(dtype, T.TimestampType) or is_numeric(dtype, True):
        return col.cast("double")
    at = col.cast("timestamp_ntz")
    seconds = F.hour(at) * 3600 + F.minute(at) * 60 + F.extract(F.lit("SECOND"), at).cast("double")
    return F.unix_date(at.cast("date")) * 86400.0 + seconds


SPLIT = float(2**27 + 1)
WHOLE_FROM = float(2**53)


def _halves(size):
    """Two numbers of few bits each that add up to ``size``."""
    high = size * SPLIT - (size * SPLIT - size)
    return high, size - high


def _steps(size: Column, digits: int) -> Column:
    """``size`` in whole steps of ``10**-digits``, rounded from its exact binary value.

    The product with the scale is rounded, and what that rounding lost is found
    exactly from the halves of both factors. So the distance to the midpoint
    between two steps is known exactly, and only true midpoints go to the even
    step. (2.675 is stored a little below the midpoint and goes down; rounding
    its decimal text would not.)
    """
    scale = float(10**digits)
    (high, low), (scale_high, scale_low) = _halves(size), _halves(scale)
    product = size * scale
    lost = ((high * scale_high - product) + high * scale_low + low * scale_high) + low * scale_low
    over = product % 1.0
    whole = product - over
    odd = whole % 2.0 == 1.0
    up = (over - 0.5 > -lost) | ((over - 0.5 == -lost) & odd)
    # From 2**52 on a product is whole, and what was lost may be half a step.
    down = (over == 0.0) & (lost == -0.5) & odd
    return whole + F.when(up, 1.0).when(down, -1.0).otherwise(0.0)


def half_even(value: Column, digits: int) -> Column:
    """Rounding as Python's ``round`` does it, used wherever a rounded number decides something.

    Numbers of 2**53 steps and more lie further apart than a step: the nearest one
    to the rounded number is the number itself.
    """

    def rounded(v: Column) -> Column:
        size = F.abs(v)
        steps = _steps(size, digits) / float(10**digits)
        return F.when(size * float(10**digits) < WHOLE_FROM, F.when(v < 0, -steps).otherwise(steps)).otherwise(v)

    # Bound to a name, because the formula looks at the value many times and roundings nest.
    return F.get(F.transform(F.array(value.cast("double")), rounded), F.lit(0))


def number_text(value: Column, digits: int, signed: bool = False) -> Column:
    """A number as text with fixed digits, rounded like ``half_even``; NULL stays NULL."""
    size = F.format_string(f"%.{digits}f", F.abs(half_even(value, digits)))
    sign = F.when(value < 0, "-").otherwise("+" if signed else "")
    return F.when(value.isNotNull(), F.concat(sign, size))
