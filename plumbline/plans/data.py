"""SQL, source and dataset-version queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W, functions as F

from ..functions.columns import project
from ..operators import features, sqlpage, versions
from ..session import work_path
from ..sources import files, records, tables
from .registry import query, selected, table
from .runs import LINES_SQL, log_lines

# Queries whose text is the same in both engines.
SAME_SQL = {
    "sql_join": """
        SELECT n_name, r_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
        FROM orders JOIN customer ON o_custkey = c_custkey
          JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        GROUP BY n_name, r_name""",
    "sql_left_join": """
        SELECT c_mktsegment, count(*) AS n, count(o_orderkey) AS n_orders
        FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000
        GROUP BY c_mktsegment""",
    "sql_range_join": """
        SELECT o_orderpriority, count(*) AS n
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate
          AND l_extendedprice < o_totalprice
        GROUP BY o_orderpriority""",
    "sql_cube": """
        SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g1, grouping(l_linestatus) AS g2,
          count(*) AS n, round(sum(l_quantity), 2) AS qty
        FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
    "sql_rollup": """
        SELECT o_orderstatus, o_orderpriority, count(*) AS n
        FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""",
    "sql_grouping_sets": """
        SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers
        FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""",
    "sql_filter_aggregate": """
        SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS discounted,
          round(avg(l_tax) FILTER (WHERE l_quantity > 25), 6) AS tax_large
        FROM lineitem GROUP BY l_returnflag""",
    "sql_window_topk": """
        SELECT o_orderpriority, o_orderkey, o_totalprice, rk FROM (
          SELECT o_orderpriority, o_orderkey, o_totalprice,
            row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rk
          FROM orders) t WHERE rk <= 3""",
    "sql_window_running": """
        SELECT o_orderkey, o_custkey,
          round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running,
          lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before
        FROM orders""",
    "sql_top_n": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
        ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100""",
    "sql_setops": """
        SELECT 'union' AS op, count(*) AS n FROM (
          SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) a
        UNION ALL SELECT 'union_all', count(*) FROM (
          SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) b
        UNION ALL SELECT 'intersect', count(*) FROM (
          SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) c
        UNION ALL SELECT 'intersect_all', count(*) FROM (
          SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier) d
        UNION ALL SELECT 'except', count(*) FROM (
          SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0) e
        UNION ALL SELECT 'except_all', count(*) FROM (
          SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer) f""",
    "sql_subquery": """
        SELECT p_brand, count(*) AS n FROM part
        WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)
          AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)
        GROUP BY p_brand""",
    "sql_recursive_dates": """
        WITH RECURSIVE months (m) AS (SELECT 1 UNION ALL SELECT m + 1 FROM months WHERE m < 12)
        SELECT m, count(o_orderkey) AS n FROM months LEFT JOIN orders ON month(o_orderdate) = m GROUP BY m""",
    "sql_scalar": """
        SELECT c_custkey, upper(substring(c_name, 1, 8)) AS head, length(c_name) AS len,
          round(abs(c_acctbal), 1) AS balance, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment,
          CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS side
        FROM customer""",
}


def _same(name: str, sql: str) -> None:
    used = [t for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem") if t in sql]

    def run(spark, folder):
        return sqlpage.query(spark, sql, {t: table(spark, folder, t) for t in used})

    query(name, sql)(run)


for _name, _sql in SAME_SQL.items():
    _same(_name, _sql)


@query(
    "sql_semi_anti",
    """SELECT 'semi' AS kind, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer
       WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)
       UNION ALL SELECT 'anti', count(*), round(sum(c_acctbal), 2) FROM customer
       WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)""",
)
def sql_semi_anti(spark, folder):
    big = "(SELECT * FROM orders WHERE o_totalprice > 300000)"
    return selected(
        spark,
        folder,
        f"""SELECT 'semi' AS kind, count(*) AS n, round(sum(c_acctbal), 2) AS balance
            FROM customer LEFT SEMI JOIN {big} o ON c_custkey = o_custkey
            UNION ALL SELECT 'anti', count(*), round(sum(c_acctbal), 2)
            FROM customer LEFT ANTI JOIN {big} o ON c_custkey = o_custkey""",
        "customer",
        "orders",
    )


@query(
    "sql_pivot",
    """SELECT l_returnflag, sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS F,
         sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS O FROM lineitem GROUP BY l_returnflag""",
)
def sql_pivot(spark, folder):
    return selected(
        spark,
        folder,
        """SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem)
           PIVOT (sum(l_quantity) FOR l_linestatus IN ('F' AS F, 'O' AS O))""",
        "lineitem",
    )


@query(
    "sql_file_scan",
    """SELECT o_orderstatus, count(*) AS n, quantile_cont(o_totalprice, 0.5) AS median,
         arg_max(o_orderkey, o_totalprice) AS top FROM orders GROUP BY o_orderstatus""",
)
def sql_file_scan(spark, folder):
    """SQL straight over a file. Spark's spelling of median and arg_max."""
    return sqlpage.query(
        spark,
        f"""SELECT o_orderstatus, count(*) AS n, percentile(o_totalprice, 0.5) AS median,
              max_by(o_orderkey, o_totalprice) AS top
            FROM parquet.`{folder}/orders.parquet` GROUP BY o_orderstatus""",
    )


@query("sql_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def sql_page(spark, folder):
    ordered = table(spark, folder, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey")
    return sqlpage.page(ordered)


@query("sql_page_large", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity LIMIT 20000")
def sql_page_large(spark, folder):
    """A page is as long as was asked."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return sqlpage.page(table(spark, folder, "lineitem").orderBy(*keys), 20_000).select("l_orderkey", "l_linenumber", "l_quantity")


@query("sql_total_rows", "SELECT count(*) AS total_rows FROM orders WHERE o_totalprice > 100000")
def sql_total_rows(spark, folder):
    """The full size beside a page."""
    return sqlpage.total_rows(table(spark, folder, "orders").where("o_totalprice > 100000"))


@query(
    "sql_asof",
    """SELECT e.event_id, s.event_id AS seen FROM events e ASOF LEFT JOIN
         (SELECT * FROM events WHERE event_id % 5 = 0) s ON e.user_id = s.user_id AND e.event_id >= s.event_id""",
)
def sql_asof(spark, folder):
    """For each event the user's newest marked event up to it, by a window instead of a join."""
    return sqlpage.query(
        spark,
        """SELECT event_id, last_value(CASE WHEN event_id % 5 = 0 THEN event_id END) IGNORE NULLS OVER
             (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen
           FROM events""",
        {"events": table(spark, folder, "events")},
    )


@query("project_columns", "SELECT o_totalprice, o_orderkey FROM orders")
def project_columns(spark, folder):
    return project(table(spark, folder, "orders"), "o_totalprice, nowhere, o_orderkey")


def exported(spark, df, label: str, kind: str, *partition: str, **options) -> str:
    path = f"{work_path(spark, label)}.{kind}"
    df.write.options(**options).format("csv" if kind == "tsv" else kind).partitionBy(*partition).save(path)
    return path


# A round trip through each file format, summed up per status.
ROUND_TRIP_SQL = """SELECT o_orderstatus, count(*) AS n, count(price) AS n_price,
    sum(o_orderkey)::BIGINT AS keys, round(sum(price), 2) AS price
    FROM (SELECT *, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders)
    GROUP BY o_orderstatus"""


def round_trip(spark, folder, kind: str, mark_missing: bool = False, **options):
    orders = table(spark, folder, "orders")
    price = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice"))
    if mark_missing:
        price = F.coalesce(price.cast("string"), F.lit("NA"))
    df = orders.select("o_orderkey", "o_orderstatus", price.alias("price"))
    back = tables.read_table(spark, exported(spark, df, "orders", kind, **options))
    return back.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("price").alias("n_price"),
        F.sum("o_orderkey").alias("keys"),
        F.round(F.sum("price"), 2).alias("price"),
    )


@query("read_csv", ROUND_TRIP_SQL)
def read_csv(spark, folder):
    """Missing prices are written as NA; the column must still be numeric."""
    return round_trip(spark, folder, "csv", True, header="true")


@query("read_tsv", ROUND_TRIP_SQL)
def read_tsv(spark, folder):
    return round_trip(spark, folder, "tsv", True, header="true", sep="\t")


@query("read_json", ROUND_TRIP_SQL)
def read_json(spark, folder):
    return round_trip(spark, folder, "json")


ARRAY_KEYS = 6000


@query("read_json_mixed", ROUND_TRIP_SQL)
def read_json_mixed(spark, folder):
    """A folder of files with a record per line and files that hold one array each."""
    price = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("price")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", price)
    path = exported(spark, orders.where("o_orderkey % 3 > 0"), "mixed", "json")
    whole = F.concat(F.lit("[\n"), F.array_join(F.collect_list(F.to_json(F.struct("*"))), ",\n"), F.lit("\n]"))
    # Arrays of a bounded number of orders, each in a file of its own.
    arrays = orders.where("o_orderkey % 3 = 0").groupBy(F.floor(F.col("o_orderkey") / ARRAY_KEYS)).agg(whole.alias("value"))
    arrays.select("value").write.mode("append").option("maxRecordsPerFile", 1).text(path)
    back = tables.read_json(spark, path)
    return back.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("price").alias("n_price"),
        F.sum("o_orderkey").alias("keys"),
        F.round(F.sum("price"), 2).alias("price"),
    )


@query(
    "read_csv_ids",
    "SELECT 1234567890120000000 + o_orderkey AS id, o_orderstatus FROM orders",
)
def read_csv_ids(spark, folder):
    """Integers of 19 digits stay what they are."""
    ids = (F.lit(1234567890120000000) + F.col("o_orderkey")).alias("id")
    rows = table(spark, folder, "orders").select(ids, "o_orderstatus")
    return tables.read_table(spark, exported(spark, rows, "ids", "csv", header="true"))


@query("read_csv_multiline", "SELECT doc_id, length(text) AS n, text FROM documents")
def read_csv_multiline(spark, folder):
    """Quoted texts with line ends."""
    rows = table(spark, folder, "documents").select("doc_id", F.length("text").alias("n"), "text")
    path = exported(spark, rows, "texts", "csv", header="true", quoteAll="true", escape='"')
    return tables.read_table(spark, path, multi_line=True)


@query("read_parquet", ROUND_TRIP_SQL)
def read_parquet(spark, folder):
    return round_trip(spark, folder, "parquet")


@query(
    "csv_row_counts",
    "SELECT o_orderpriority, count(*) AS rows FROM orders GROUP BY o_orderpriority",
)
def csv_row_counts(spark, folder):
    """Rows of every CSV file of a version, summed per folder."""
    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    path = exported(spark, df, "orders-csv", "csv", "o_orderpriority", header="true")
    folder_name = F.regexp_extract("path", "o_orderpriority=([^/]+)/", 1)
    counted = files.csv_row_counts(spark, path)
    named = counted.withColumn("o_orderpriority", F.url_decode(F.url_decode(folder_name)))
    return named.groupBy("o_orderpriority").agg(F.sum("rows").alias("rows"))


def log_files(spark, folder) -> str:
    """The derived log lines as text files, one folder per run.

    Range partitioning keeps the line order and splits a long log into several
    files, whose names sort in line order.
    """
    lines = log_lines(spark, folder)
    order = ["job_id", "line_no"]
    ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    return exported(spark, ordered.select("line", "job_id"), "logs", "text", "job_id")


def job_of_path():
    return F.regexp_extract("path", "job_id=([^/]+)/", 1)


@query(
    "numbered_log_lines",
    f"""SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY line_no) AS line_no, line
        FROM ({LINES_SQL})""",
)
def numbered_log_lines(spark, folder):
    """Log files read back: lines numbered in file order, and on over the files of a run."""
    lines = files.numbered_lines(spark, log_files(spark, folder)).withColumn("job_id", job_of_path())
    before = W.partitionBy("job_id").orderBy("path").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        lines.groupBy("job_id", "path")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    return lines.join(starts, "path").select(
        "job_id", (F.col("line_no") + F.col("start")).alias("line_no"), "line"
    )


@query(
    "text_summary_logs",
    f"""SELECT job_id, count(*) AS lines, arg_min(line, line_no) AS first_line,
          sum(length(line) + 1)::BIGINT AS size, false AS is_binary
        FROM ({LINES_SQL}) GROUP BY job_id""",
)
def text_summary_logs(spark, folder):
    """Size, lines and preview of every log file, summed up per run."""
    summary = files.text_summary(spark, log_files(spark, folder))
    logs = summary.where(F.col("extension") == "txt").withColumn("job_id", job_of_path())
    return logs.groupBy("job_id").agg(
        F.sum("lines").alias("lines"),
        F.min_by(F.split("preview", "\n")[0], "path").alias("first_line"),
        F.sum("size").alias("size"),
        F.bool_or("is_binary").alias("is_binary"),
    )


RUN_RECORDS_SQL = """SELECT 'order_' || o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'completed'
    ELSE 'running' END AS status, 600 AS timeout, o_orderkey::INTEGER % 3 AS exit_code FROM orders"""


@query("read_run_records", RUN_RECORDS_SQL)
def read_run_records(spark, folder):
    """Run documents written as JSON and read with the fixed schema."""
    orders = table(spark, folder, "orders")
    documents = orders.select(
        F.concat(F.lit("order_"), "o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"),
        F.lit(600).alias("timeout"),
        F.struct((F.col("o_orderkey") % 3).cast("int").alias("exit_code")).alias("result"),
        F.lit("ignored").alias("note"),
    )
    path = exported(spark, documents, "runs", "json")
    read = records.read_runs(spark, path, one_per_line=True)
    return read.select("id", "status", "timeout", "result.exit_code")


@query(
    "ingest_orders",
    """SELECT count(*) AS rows, 'o_orderkey,o_orderstatus,o_totalprice' AS columns, 'create' AS mode
       FROM orders""",
)
def ingest_orders(spark, folder):
    """A CSV file made a catalog table, under a name no earlier run has used."""
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = exported(spark, df, "ingest", "csv", header="true")
    return tables.ingest(spark, path, f"plumbline_{uuid.uuid4().hex}").drop("table")


@query(
    "ingest_append",
    """SELECT 2 * count(*) AS rows, 'o_orderkey,o_orderstatus,o_totalprice' AS columns, 'append' AS mode FROM orders""",
)
def ingest_append(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path, name = exported(spark, df, "ingest", "csv", header="true"), f"plumbline_{uuid.uuid4().hex}"
    tables.ingest(spark, path, name)
    return tables.ingest(spark, path, name, "append").drop("table")


@query(
    "ingest_replace",
    """SELECT count(*) AS rows, 'o_orderkey,o_totalprice' AS columns, 'replace' AS mode FROM orders WHERE o_orderstatus = 'F'""",
)
def ingest_replace(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    name = f"plumbline_{uuid.uuid4().hex}"
    tables.ingest(spark, exported(spark, df, "ingest", "csv", header="true"), name)
    fewer = df.where("o_orderstatus = 'F'").drop("o_orderstatus")
    return tables.ingest(spark, exported(spark, fewer, "ingest", "csv", header="true"), name, "replace").drop("table")


# Dataset versions: documents as files, one version per language or per crawl.
SOURCE_FILES = "SELECT concat(lang, '/', doc_id, '.txt') AS name, n_chars AS size FROM documents WHERE doc_id % 7 <> 3"
TARGET_FILES = """SELECT concat(lang, '/', doc_id, '.txt') AS name,
    CASE WHEN doc_id % 10 = 0 THEN n_chars + 1 ELSE n_chars END AS size FROM documents WHERE doc_id % 11 <> 5"""
DIFF_SQL = f"""SELECT name, CASE WHEN t.size IS NULL THEN 'only_in_source' WHEN s.size IS NULL THEN 'only_in_target'
    WHEN s.size <> t.size THEN 'changed' ELSE 'unchanged' END AS state, s.size AS source_size, t.size AS target_size
    FROM ({SOURCE_FILES}) s FULL JOIN ({TARGET_FILES}) t USING (name)"""


def file_diff(spark, folder):
    return versions.diff_files(selected(spark, folder, SOURCE_FILES, "documents"), selected(spark, folder, TARGET_FILES, "documents"))


@query("version_diff", DIFF_SQL)
def version_diff(spark, folder):
    return file_diff(spark, folder)


@query(
    "version_diff_summary",
    "SELECT "
    + ", ".join(
        f"count(*) FILTER (WHERE state = '{s}') AS {s}"
        for s in ("only_in_source", "only_in_target", "changed", "unchanged")
    )
    + f" FROM ({DIFF_SQL})",
)
def version_diff_summary(spark, folder):
    return versions.diff_summary(file_diff(spark, folder))


ROWS_OLD = "SELECT doc_id, quality, toxic FROM labels"
ROWS_NEW = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS quality, toxic FROM labels"


@query(
    "version_diff_rows",
    f"""SELECT *, 'only_in_source' AS state FROM ({ROWS_OLD} EXCEPT ALL {ROWS_NEW})
        UNION ALL SELECT *, 'only_in_target' FROM ({ROWS_NEW} EXCEPT ALL {ROWS_OLD})""",
)
def version_diff_rows(spark, folder):
    """Edits that keep the file size show up when rows are compared."""
    return versions.diff_rows(selected(spark, folder, ROWS_OLD, "labels"), selected(spark, folder, ROWS_NEW, "labels"))


@query(
    "version_status",
    """SELECT lang AS name, count(*) AS files, sum(n_chars)::BIGINT AS bytes,
         CASE WHEN lang <> 'fr' THEN 'raw' END AS source,
         CASE WHEN lang <> 'fr' THEN 'pages in ' || lang END AS description,
         CASE WHEN lang <> 'fr' THEN false END AS protected, lang <> 'fr' AS registered
       FROM documents GROUP BY lang""",
)
def version_status(spark, folder):
    documents = table(spark, folder, "documents")
    listing = documents.select(
        F.col("lang").alias("version"), F.col("doc_id").alias("name"), F.col("n_chars").alias("size")
    )
    index = documents.where(F.col("lang") != "fr").select("lang").distinct().select(
        F.col("lang").alias("name"),
        F.lit("raw").alias("source"),
        F.concat(F.lit("pages in "), "lang").alias("description"),
        F.lit(False).alias("protected"),
    )
    return versions.status(listing, index)


@query(
    "version_listing",
    f"""SELECT 'job_id=' || job_id AS version, sum(length(line) + 1)::BIGINT AS bytes
        FROM ({LINES_SQL}) GROUP BY job_id""",
)
def version_listing(spark, folder):
    """Files on disk, their sizes read from the listing, content untouched."""
    listing = files.list_files(spark, log_files(spark, folder), "*.txt")
    return listing.groupBy("version").agg(F.sum("size").alias("bytes"))


@query(
    "version_fork",
    """SELECT o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, 'copy of orders' AS description
       FROM orders GROUP BY o_orderstatus""",
)
def version_fork(spark, folder):
    """A version stored as a table, forked, and read back with its index entry."""
    run = uuid.uuid4().hex
    source, target, index = f"orders_{run}", f"orders_fork_{run}", f"versions_{run}"
    table(spark, folder, "orders").select("o_orderkey", "o_orderstatus").write.saveAsTable(source)
    entry = versions.fork(spark, index, source, "fork", target, "copy of orders").first()
    return (
        spark.table(target)
        .groupBy("o_orderstatus")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))
        .withColumn("description", F.lit(entry["description"]))
    )


# Customers as versions, each forked from the one of half its number; 2 and 5 form a cycle.
VERSIONS_SQL = """SELECT concat('v', c_custkey) AS name,
    CASE WHEN c_custkey = 2 THEN 'v5' WHEN c_custkey = 0 THEN NULL
      WHEN c_custkey % 97 = 0 THEN concat('gone_', c_custkey)
      ELSE concat('v', cast(floor(c_custkey / 2) AS int)) END AS source FROM customer"""


@query(
    "lineage",
    f"""WITH RECURSIVE v AS ({VERSIONS_SQL}),
        up (name, chain, next) AS (
          SELECT name, [name], source FROM v
          UNION ALL
          SELECT up.name, list_prepend(v.name, up.chain), v.source
          FROM up JOIN v ON v.name = up.next WHERE NOT list_contains(up.chain, v.name))
        SELECT name, arg_max(array_to_string(chain, ' -> '), len(chain)) AS path,
          max(len(chain))::INTEGER AS depth FROM up GROUP BY name""",
)
def lineage(spark, folder):
    return versions.lineage(selected(spark, folder, VERSIONS_SQL, "customer"))


LISTING_SQL = "SELECT concat(source, '.txt') AS name, sum(length(text) - length(replace(text, 'e', '')))::BIGINT AS size FROM documents WHERE {0} GROUP BY source"


def written_version(spark, root: str, version: str, rows) -> None:
    """Files per source, together of as many bytes as its texts have letters e: a line per text."""
    letters = F.length("text") - F.length(F.replace("text", F.lit("e"), F.lit("")))
    lines = rows.select("source", F.repeat(F.lit("e"), letters - 1).alias("value"), letters.alias("n")).where("n > 0")
    lines.drop("n").write.partitionBy("source").text(f"{root}/{version}")


def source_sizes(listed):
    """A listing of such files, added up per source."""
    name = F.concat(F.regexp_extract("name", "source=([^/]+)/", 1), F.lit(".txt")).alias("name")
    return listed.groupBy("version", name).agg(F.sum("size").alias("size"))


@query(
    "version_diff_listing",
    f"""SELECT name, CASE WHEN t.size IS NULL THEN 'only_in_source' WHEN s.size IS NULL THEN 'only_in_target'
          WHEN s.size <> t.size THEN 'changed' ELSE 'unchanged' END AS state, s.size AS source_size, t.size AS target_size
        FROM ({LISTING_SQL.format("source <> 'src1'")}) s FULL JOIN ({LISTING_SQL.format("source <> 'src2' AND (source <> 'src3' OR doc_id % 2 = 0)")}) t USING (name)""",
)
def version_diff_listing(spark, folder):
    """Two versions written as folders, compared by their listings."""
    root, documents = work_path(spark, "versions"), table(spark, folder, "documents")
    written_version(spark, root, "raw", documents.where("source <> 'src1'"))
    written_version(spark, root, "clean", documents.where("source <> 'src2' AND (source <> 'src3' OR doc_id % 2 = 0)"))
    listed = source_sizes(files.list_files(spark, root, "*.txt"))
    raw, clean = (listed.where(F.col("version") == v).select("name", "size") for v in ("raw", "clean"))
    return versions.diff_files(raw, clean)


@query(
    "oversample_hashed_keys",
    """WITH n AS (SELECT o_orderpriority AS c, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT max(n) AS most FROM n),
         r AS (SELECT o_orderkey, o_orderpriority,
             row_number() OVER (PARTITION BY o_orderpriority ORDER BY (o_orderkey % 2 * 2 - 1) * (9000000000000000000 + o_orderkey)) AS k FROM orders)
       SELECT o_orderkey, most // n + CASE WHEN k <= most % n THEN 1 ELSE 0 END AS copies
       FROM r JOIN n ON c = o_orderpriority, m""",
)
def oversample_hashed_keys(spark, folder):
    """Keys spread over the whole range of 64 bits."""
    key = ((F.col("o_orderkey") % 2 * 2 - 1) * (F.lit(9000000000000000000) + F.col("o_orderkey"))).alias("key")
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", key)
    return features.oversample(rows, "o_orderpriority", "key").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("copies"))


@query(
    "read_task_records",
    """SELECT 'task_' || l_orderkey AS id, count(*)::INTEGER AS n_iterations, max(l_quantity) AS best
       FROM lineitem GROUP BY l_orderkey""",
)
def read_task_records(spark, folder):
    """Task documents with their nested iterations, read with the fixed schema."""
    lines = table(spark, folder, "lineitem")
    step = F.struct(F.col("l_linenumber").alias("iteration"), F.col("l_quantity").alias("accuracy"), F.lit(1).alias("extra"))
    documents = lines.groupBy(F.concat(F.lit("task_"), "l_orderkey").alias("id")).agg(F.collect_list(step).alias("iterations"))
    read = records.read_tasks(spark, exported(spark, documents, "tasks", "json"), one_per_line=True)
    steps = F.transform("iterations", lambda s: s["accuracy"])
    return read.select("id", F.size("iterations").alias("n_iterations"), F.array_max(steps).alias("best"))


@query(
    "read_version_index",
    """SELECT source AS name, 'crawl ' || count(*) AS description, CASE WHEN source = 'src1' THEN NULL ELSE 'src1' END AS source,
         source = 'src2' AS protected FROM documents GROUP BY source""",
)
def read_version_index(spark, folder):
    """An index document keyed by version name, and the status joined to it."""
    documents = table(spark, folder, "documents").groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct(
        F.when(F.col("name") != "src1", "src1").alias("source"),
        F.concat(F.lit("crawl "), "n").alias("description"),
        F.when(F.col("name") == "src2", True).alias("protected"),
    )
    # The index is one document by definition: a row per version.
    index = documents.agg(F.map_from_entries(F.collect_list(F.struct("name", entry))).alias("versions"))
    path = exported(spark, index, "index", "json")
    return records.read_versions(spark, path).drop("created")


@query(
    "version_status",
    f"""SELECT name, count(*) AS files, sum(size)::BIGINT AS bytes, CASE WHEN name = 'raw' THEN 'sensors' END AS source,
          CASE WHEN name = 'raw' THEN true END AS protected, name = 'raw' AS registered
        FROM (SELECT 'raw' AS name, size FROM ({LISTING_SQL.format("source <> 'src1'")})
              UNION ALL SELECT 'clean', size FROM ({LISTING_SQL.format("source <> 'src2'")})) GROUP BY name""",
)
def version_status(spark, folder):
    """Two versions written as folders, one of them registered, and a version without a folder."""
    root, documents = work_path(spark, "versions"), table(spark, folder, "documents")
    written_version(spark, root, "raw", documents.where("source <> 'src1'"))
    written_version(spark, root, "clean", documents.where("source <> 'src2'"))
    known = spark.createDataFrame(
        [("raw", None, "sensors", "first", True), ("lost", None, "raw", "", False)], versions.VERSION_COLUMNS
    )
    return versions.status(source_sizes(files.list_files(spark, root, "*.txt")), known).drop("description")
