"""Registered queries and the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import sqlpage

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def selected(spark: SparkSession, folder: str, sql: str, *names: str) -> DataFrame:
    """SQL over the named tables."""
    return sqlpage.query(spark, sql, {name: table(spark, folder, name) for name in names})


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison: sums differ in the last bits by partitioning."""
    return df.select(
        *[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in df.schema]
    )


def union_sql(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)
