"""Plain Spark SQL with a result page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed value: the page size.
PAGE = 100


def query(spark: SparkSession, sql: str, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run SQL over catalog tables, files (``parquet.`path```) and the given views.

    The views exist while the text is analysed and no longer: a caller's view of
    the same name comes back.
    """
    views = views or {}
    if not views:
        return spark.sql(sql)
    wanted = {name.lower() for name in views}
    listed = [t.name for t in spark.catalog.listTables() if t.isTemporary and t.name.lower() in wanted]
    before = {name: spark.table(name) for name in listed}
    try:
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return spark.sql(sql)
    finally:
        for name in views:
            spark.catalog.dropTempView(name)
        for name, df in before.items():
            df.createOrReplaceTempView(name)


def page(df: DataFrame, limit: int = PAGE) -> DataFrame:
    """The first rows of a result; Spark pushes the limit down."""
    return df.limit(limit)


def total_rows(df: DataFrame) -> DataFrame:
    """One row: the full size of a result. A separate job, so ask only when it is needed."""
    return df.agg(F.count(F.lit(1)).alias("total_rows"))
