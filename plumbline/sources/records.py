"""Run, task and version records, and run logs, as DataFrames with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .files import numbered_lines

# The shape of the stored records.
RUNS = """
    id string, name string, type string, status string,
    submitted_at string, started_at string, finished_at string, timeout int,
    code string, command string,
    result struct<exit_code:int,stdout:string,stderr:string>
"""
TASKS = """
    id string, task string, dataset string, status string,
    submitted_at string, started_at string, finished_at string,
    final_report string, error string, pid int, current_iteration int,
    total_iterations int, best_accuracy double,
    config struct<max_iterations:int>,
    iterations array<struct<
        iteration:int, accuracy:double, actions:array<string>, job_id:string,
        features:int, should_stop:boolean, reason:string, timestamp:string,
        raw_output_length:int>>
"""
VERSION = "struct<created:string,source:string,description:string,protected:boolean>"


def read_runs(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Run records: one JSON document per file, or one per line where they were compacted."""
    return _documents(spark, path, RUNS, one_per_line)


def read_tasks(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Task records, stored like runs."""
    return _documents(spark, path, TASKS, one_per_line)


def _documents(spark: SparkSession, path: str, schema: str, one_per_line: bool) -> DataFrame:
    reader = spark.read.schema(schema).option("pathGlobFilter", "*.json")
    return reader.json(path, multiLine=not one_per_line)


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """``(name, created, source, description, protected)`` from an index keyed by name."""
    index = spark.read.schema(f"created string, versions map<string,{VERSION}>").json(
        path, multiLine=True
    )
    return index.select(F.explode("versions").alias("name", "v")).select(
        "name",
        "v.created",
        "v.source",
        "v.description",
        F.coalesce("v.protected", F.lit(False)).alias("protected"),
    )


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """``(job_id, line_no, line)`` from one log file per run, named after the run."""
    return numbered_lines(spark, path).select(
        F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("job_id"), "line_no", "line"
    )
