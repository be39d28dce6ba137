"""Readers, listings, SQL pages, dataset versions."""

import json
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from plumbline.functions.columns import project
from plumbline.operators import profile, sqlpage, versions
from plumbline.session import shared_folder
from plumbline.sources import files, records, tables, quoted


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_delimited_types_and_missing_texts(spark, tmp_path):
    text = '''i,f,mixed,b,s,gone,ids,when
1,1.5,3,True,a,NA,007,2024-01-01
2,NaN,x,false,N/A,,008,2024-01-02
,-2e3,4,,"c, ""d""",null,009,
'''
    df = tables.read_table(spark, put(tmp_path / "t.csv", text))
    assert dict(df.dtypes) == {
        "i": "bigint", "f": "double", "mixed": "string", "b": "boolean", "s": "string",
        "gone": "double", "ids": "bigint", "when": "string",
    }
    rows = df.collect()
    assert [r.i for r in rows] == [1, 2, None] and [r.f for r in rows] == [1.5, None, -2000]
    assert rows[2].s == 'c, "d"' and rows[1].s is None
    tsv = tables.read_table(spark, put(tmp_path / "t.tsv", "a\tb\n1\tx\n"))
    assert tsv.dtypes == [("a", "bigint"), ("b", "string")]
    none = tables.read_delimited(spark, put(tmp_path / "u.csv", "a\nNA\n-\n"), missing_text=["-"])
    assert [r.a for r in none.collect()] == ["NA", None]


def test_json_both_ways_and_unsupported(spark, tmp_path):
    array = put(tmp_path / "array.json", '\n [{"a": 1},\n {"a": 2}]')
    lines = put(tmp_path / "lines.json", '{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    assert tables.read_table(spark, array).count() == 2
    assert tables.read_table(spark, lines).count() == 3
    with pytest.raises(ValueError, match="unsupported format"):
        tables.read_table(spark, "table.xlsx")


def test_parquet_extensions(spark, tmp_path):
    for name in ("t.parquet", "t.pq"):
        spark.range(3).write.parquet(str(tmp_path / name))
        assert tables.read_table(spark, str(tmp_path / name)).count() == 3


def test_ingest_modes(spark, tmp_path):
    source = put(tmp_path / "t.csv", "a,b\n1,x\n2,y\n")
    swapped = put(tmp_path / "s.csv", "c,d\n3,z\n")
    first = tables.ingest(spark, source, "ingested").first()
    assert tuple(first) == ("ingested", 2, "a,b", "create")
    with pytest.raises(AnalysisException):
        tables.ingest(spark, source, "ingested")
    assert tables.ingest(spark, swapped, "ingested", "append").first().rows == 3
    assert spark.table("ingested").where("b = 'z'").first().a == 3
    assert tables.ingest(spark, source, "ingested", "replace").first().rows == 2
    with pytest.raises(ValueError):
        tables.ingest(spark, source, "ingested", "merge")


def test_listing_and_row_counts(spark, tmp_path):
    put(tmp_path / "v1" / "a.csv", 'h,i\n1,"two\nlines"\n3,4\n')
    put(tmp_path / "v1" / "sub" / "b.txt", "hello")
    put(tmp_path / "v1" / ".hidden", "x")
    put(tmp_path / "v2" / "empty.csv", "h\n")
    listed = {(r.version, r.name): r.size for r in files.list_files(spark, str(tmp_path)).collect()}
    put(tmp_path / "v2" / "_marked.csv", "")
    put(tmp_path / "v3" / "nothing.bin", "")
    listed = {(r.version, r.name): r.size for r in files.list_files(spark, str(tmp_path)).collect()}
    assert listed == {
        ("v1", "a.csv"): 22, ("v1", "sub/b.txt"): 5, ("v2", "empty.csv"): 2, ("v2", "_marked.csv"): 0, ("v3", "nothing.bin"): 0
    }
    assert files.list_files(spark, str(tmp_path), "*.txt").first().name == "sub/b.txt"


def test_lines_are_numbered_across_splits(spark, tmp_path):
    put(tmp_path / "in" / "big.log", "".join(f"line {i}\n" for i in range(2000)))
    put(tmp_path / "in" / "small.log", "only\r\ntwo")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = files.numbered_lines(spark, str(tmp_path / "in"))
        raw = spark.read.text(str(tmp_path / "in")).select("_metadata.file_block_start").distinct()
        assert raw.count() > 5
        lines = {(os.path.basename(r.path), r.line_no): r.line for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(lines) == 2002
    assert all(lines["big.log", i + 1] == f"line {i}" for i in range(2000))
    assert lines["small.log", 2] == "two"
    logs = records.read_logs(spark, str(tmp_path / "in"))
    assert {r.job_id: r["count"] for r in logs.groupBy("job_id").count().collect()} == {"big": 2000, "small": 2}


def test_text_summary(spark, tmp_path):
    put(tmp_path / "a.txt", "\n".join(f"l{i}" for i in range(25)))
    put(tmp_path / "big.log", "x" * 1_000_001)
    put(tmp_path / "m.pkl", "binary\nstuff")
    put(tmp_path / "none.txt", "")
    got = {os.path.basename(r.path): r for r in files.text_summary(spark, str(tmp_path)).collect()}
    assert (got["a.txt"].lines, got["a.txt"].preview) == (25, "\n".join(f"l{i}" for i in range(10)))
    assert got["big.log"].truncated and not got["a.txt"].truncated
    assert got["m.pkl"].is_binary and got["m.pkl"].lines is None
    assert "none.txt" not in got  # Spark's file sources leave out files of zero bytes


def test_records(spark, tmp_path):
    run = {"id": "a", "status": "completed", "result": {"exit_code": 0, "stdout": "acc: 5", "stderr": ""}, "note": "x"}
    put(tmp_path / "jobs" / "a.json", json.dumps(run, indent=2))
    put(tmp_path / "jobs" / "a.log", "acc: 1\n")
    assert records.read_runs(spark, str(tmp_path / "jobs")).first().result.stdout == "acc: 5"
    task = {"id": "t", "iterations": [{"iteration": 0, "accuracy": 9.5, "actions": ["a"]}], "config": {"max_iterations": 5}}
    put(tmp_path / "tasks" / "t.json", json.dumps(task, indent=2))
    assert records.read_tasks(spark, str(tmp_path / "tasks")).first().iterations[0].accuracy == 9.5
    index = {"created": "x", "versions": {"raw": {"created": "c", "source": None, "description": "d", "protected": True}, "v1": {"created": "c", "source": "raw", "description": "e"}}}
    path = put(tmp_path / "index.json", json.dumps(index, indent=2))
    got = {r.name: (r.source, r.protected) for r in records.read_versions(spark, path).collect()}
    assert got == {"raw": (None, True), "v1": ("raw", False)}


def test_head_projection_and_pages(spark):
    df = spark.range(30_000).selectExpr("id", "-id AS down")
    assert profile.head(df, 99, "down").collect()[0].id == 29_999
    assert profile.head(df, 99).count() == 99 and profile.head(df).count() == 5
    assert project(df, " down, nope ,id").columns == ["down", "id"]
    result = sqlpage.query(spark, "SELECT * FROM numbers WHERE id >= 100", {"numbers": df})
    assert sqlpage.page(result).count() == 100
    assert sqlpage.page(result, 20_000).count() == 20_000
    assert sqlpage.total_rows(result).first().total_rows == 29_900
    assert profile.schema_table(df).collect()[1].col_name == "down"


def test_as_of_join_rewrite(spark):
    """The last quote at or before each trade, by union and a window."""
    quotes = spark.createDataFrame([("a", 1, 10.0), ("a", 5, 11.0), ("b", 2, 20.0)], "k string, t int, p double")
    trades = spark.createDataFrame([("a", 4), ("a", 5), ("b", 1)], "k string, t int")
    got = sqlpage.query(
        spark,
        """SELECT k, t, p FROM (
             SELECT k, t, is_trade, last_value(p) IGNORE NULLS OVER (
               PARTITION BY k ORDER BY t, is_trade ROWS UNBOUNDED PRECEDING) AS p
             FROM (SELECT k, t, p, 0 AS is_trade FROM quotes UNION ALL SELECT k, t, NULL, 1 FROM trades))
           WHERE is_trade = 1""",
        {"quotes": quotes, "trades": trades},
    )
    assert {(r.k, r.t): r.p for r in got.collect()} == {("a", 4): 10.0, ("a", 5): 11.0, ("b", 1): None}


VERSIONS = [("raw", None), ("v1", "raw"), ("v2", "v1"), ("orphan", "missing"), ("a", "b"), ("b", "a"), ("tail", "a"), ("self", "self")]
PATHS = {
    "raw": "raw", "v1": "raw -> v1", "v2": "raw -> v1 -> v2", "orphan": "orphan",
    "a": "b -> a", "b": "a -> b", "tail": "b -> a -> tail", "self": "self",
}


def test_lineage_with_cycles_and_missing_parents(spark):
    table = spark.createDataFrame(VERSIONS, "name string, source string")
    assert {r.name: r.path for r in versions.lineage(table).collect()} == PATHS
    for name, path in PATHS.items():
        assert versions.lineage(table, name).first().path == path
    assert versions.lineage(table, "nowhere").count() == 0


def test_deep_lineage(spark):
    table = spark.range(300).selectExpr("concat('v', id) AS name", "IF(id = 0, NULL, concat('v', id - 1)) AS source")
    depth = {r.name: r.depth for r in versions.lineage(table).collect()}
    assert depth == {f"v{i}": i + 1 for i in range(300)}


def test_version_differences(spark):
    source = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "name string, size bigint")
    target = spark.createDataFrame([("b", 2), ("c", 4), ("d", 5)], "name string, size bigint")
    found = versions.diff_files(source, target)
    assert {r.name: r.state for r in found.collect()} == {
        "a": "only_in_source", "b": "unchanged", "c": "changed", "d": "only_in_target",
    }
    assert tuple(versions.diff_summary(found).first()) == (1, 1, 1, 1)
    edited = source.withColumn("size", F.when(F.col("name") == "a", 9).otherwise(F.col("size")))
    rows = versions.diff_rows(source.union(source), edited.union(source))
    assert sorted((r.name, r.size, r.state) for r in rows.collect()) == [("a", 1, "only_in_source"), ("a", 9, "only_in_target")]


def test_fork(spark):
    spark.range(5).write.saveAsTable("raw_v")
    row = versions.fork(spark, "version_index", "raw_v", "v1", "v1_table", "first try").first()
    assert (row["name"], row["source"], row["description"]) == ("v1", "raw_v", "first try")
    assert spark.table("v1_table").count() == 5
    with pytest.raises(ValueError):
        versions.fork(spark, "version_index", "raw_v", "v1", "v1_table")
    with pytest.raises(ValueError):
        versions.fork(spark, "version_index", "nowhere", "v2", "v2_table")
    versions.fork(spark, "version_index", "v1_table", "v2", "v2_table")
    assert spark.table("version_index").count() == 2


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_row_counts_of_every_csv(spark, tmp_path):
    put(tmp_path / "v 1" / "two rows.csv", "h\n1\n2\n")
    put(tmp_path / "v 1" / "header.csv", "h\n")
    put(tmp_path / "v 1" / "empty.csv", "")
    put(tmp_path / "v 1" / "_left.csv", "h\n1\n")
    got = {os.path.basename(r.path): r.rows for r in files.csv_row_counts(spark, str(tmp_path)).collect()}
    assert got == {"two rows.csv": 2, "header.csv": 0, "empty.csv": 0, "_left.csv": None}


def test_json_layout_is_each_files_own(spark, tmp_path):
    put(tmp_path / "m" / "array.json", "[" + ",\n".join('{"a": %d}' % i for i in range(50)) + "]")
    put(tmp_path / "m" / "lines.json", '{"a": 1}\n{"a": 2, "b": "x"}\n{"a": 3}\n')
    put(tmp_path / "m" / "pretty.json", '{\n  "a": 9\n}\n')
    assert tables.read_json(spark, str(tmp_path / "m")).count() == 54
    assert tables.read_json(spark, str(tmp_path / "m" / "pretty.json")).first().a == 9


def test_ids_of_nineteen_digits_and_quoted_line_ends(spark, tmp_path):
    text = 'id,t\n1234567890123456789,"a\nb"\n1234567890123456788,c\n'
    df = tables.read_delimited(spark, put(tmp_path / "i.csv", text), multi_line=True)
    assert [(r.id, r.t) for r in df.collect()] == [(1234567890123456789, "a\nb"), (1234567890123456788, "c")]
    big = tables.read_delimited(spark, put(tmp_path / "j.csv", "id\n12345678901234567890\n"))
    assert big.dtypes == [("id", "double")]


def test_lineage_by_name_past_a_hundred_levels(spark):
    index = spark.createDataFrame([(f"v{i}", f"v{i - 1}") for i in range(1, 151)] + [("v0", None)], "name string, source string")
    row = versions.lineage(index, "v150").first()
    assert row.depth == 151 and row.path.startswith("v0 -> v1 -> ")


QUOTED = [
    ["1", "plain", "x"], ["2", "two\nlines", "y"], ["3", 'she said ""no""\n\n,\n', "z"], ["4", "", "a,b"],
    ["5", 'five" pipe', "q"], ["6", "ünï\n" * 40, "long"], ["7", '""""', "w"], ["8", "\n", "\n\n"],
]


def quoted_text(rows, end="\n"):
    lines = ["id,text,more"]
    for i, a, b in rows:
        cells = [x if not any(c in x for c in ',\n') and not x.startswith('"') else f'"{x}"' for x in (a, b)]
        lines.append(",".join([i, *cells]))
    return end.join(lines) + end


@pytest.mark.parametrize("size", [16, 33, 97, 100_000])
def test_quoted_line_ends_wherever_a_file_is_cut(spark, tmp_path, size):
    for n, rows in enumerate((QUOTED, QUOTED[::-1], QUOTED[:1])):
        put(tmp_path / "t" / f"{n}.csv", quoted_text(rows * (3 - n), "\r\n" if n == 1 else "\n"))
    put(tmp_path / "t" / "empty.csv", "id,text,more\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        df = quoted.read_quoted(spark, str(tmp_path / "t"))
        tasks = quoted.split_lines(spark, str(tmp_path / "t")).rdd.getNumPartitions()
        found = sorted(tuple(r) for r in df.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    plain = [tuple((x.replace('""', '"') if "," in x or "\n" in x or x.startswith('"') else x) or None for x in r) for r in QUOTED]
    assert found == sorted(plain * 3 + plain[::-1] * 2 + plain[:1])
    assert tasks > 20 or size > 16


def test_one_quoted_field_over_many_splits(spark, tmp_path):
    field = "\n".join(f"line {i}" for i in range(500))
    path = put(tmp_path / "o.csv", f'a,b\n1,"{field}"\n2,x\n3,"{field}"\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", 200)
    try:
        assert sorted(tuple(r) for r in quoted.read_quoted(spark, path).collect()) == [("1", field), ("2", "x"), ("3", field)]
        assert tables.read_delimited(spark, path, multi_line=True).dtypes == [("a", "bigint"), ("b", "string")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_one_name_of_a_long_chain(spark):
    n = 3000
    table = spark.range(n).selectExpr("concat('v', id) AS name", "CASE WHEN id = 0 THEN 'outside' ELSE concat('v', id - 1) END AS source")
    row = versions.lineage(table, f"v{n - 1}").first()
    assert row.depth == n and row.path == " -> ".join(f"v{i}" for i in range(n))
    assert versions.lineage(table, "v0").first().path == "v0"
    ring = spark.range(50).selectExpr("concat('r', id) AS name", "concat('r', (id + 1) % 50) AS source")
    every = {r.name: (r.path, r.depth) for r in versions.lineage(ring).collect()}
    one = versions.lineage(ring, "r7").first()
    assert (one.path, one.depth) == every["r7"] and one.depth == 50


def test_a_long_listing_is_written_in_parts(spark, tmp_path, monkeypatch):
    for i in range(25):
        put(tmp_path / f"v{i % 3}" / f"{i}.txt", "x" * i)
    want = {(f"v{i % 3}", f"{i}.txt", i) for i in range(25)}
    for size in (4, 5, 25, 26):
        monkeypatch.setattr(files, "LISTED_AT_ONCE", size)
        assert {(r.version, r.name, r.size) for r in files.list_files(spark, str(tmp_path)).collect()} == want
