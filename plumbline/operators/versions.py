"""Dataset versions: listing differences, status, lineage, fork."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage

VERSION_COLUMNS = "name string, created timestamp, source string, description string, protected boolean"


def diff_files(source: DataFrame, target: DataFrame) -> DataFrame:
    """Files of two listings ``(name, size)``: where each is, and whether its size changed."""
    left = source.select("name", F.col("size").alias("source_size"))
    right = target.select("name", F.col("size").alias("target_size"))
    return left.join(right, "name", "full_outer").select(
        "name",
        F.when(F.col("target_size").isNull(), "only_in_source")
        .when(F.col("source_size").isNull(), "only_in_target")
        .when(F.col("source_size") != F.col("target_size"), "changed")
        .otherwise("unchanged")
        .alias("state"),
        "source_size",
        "target_size",
    )


def diff_summary(files: DataFrame) -> DataFrame:
    states = ("only_in_source", "only_in_target", "changed", "unchanged")
    return files.agg(*[F.count_if(F.col("state") == s).alias(s) for s in states])


def diff_rows(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows of one version that the other lacks, repeated rows counted; finds equal-size edits."""
    gone = source.exceptAll(target).withColumn("state", F.lit("only_in_source"))
    new = target.exceptAll(source).withColumn("state", F.lit("only_in_target"))
    return gone.unionByName(new)


def status(files: DataFrame, versions: DataFrame) -> DataFrame:
    """File count and bytes per version folder; folders that are not registered as well.

    ``files`` is ``(version, name, size)``. A registered version without a folder
    has nothing to report and is left out.
    """
    sizes = files.groupBy(F.col("version").alias("name")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")
    )
    known = versions.select("name", "source", "description", "protected", F.lit(True).alias("registered"))
    return sizes.join(known, "name", "left").withColumn(
        "registered", F.coalesce("registered", F.lit(False))
    )


def lineage(versions: DataFrame, name: str | None = None) -> DataFrame:
    """``(name, path, depth)``: the ancestors of each version, root first, joined by arrows.

    A chain ends at a parent that is not registered, or where a version would
    repeat. All chains grow at once by doubling: each round appends to a chain
    the chain of its oldest member, so depth d takes about log2(d) joins. With
    ``name``, only that version's chain is built, see ``ancestors``.
    """
    known = versions.select("name", "source").distinct()
    if name is not None and known.groupBy("name").count().where("count > 1").isEmpty():
        chain = ancestors(known, name)
        return chain.groupBy().agg(
            F.lit(name).alias("name"),
            F.array_join(F.array_sort(F.collect_list(F.struct(-F.col("depth"), "name")))["name"], " -> ").alias("path"),
            F.count(F.lit(1)).cast("int").alias("depth"),
        ).where("depth > 0")
    parents = known.select(F.col("name").alias("source"))
    # A version, its chain upwards from itself, and the parent the chain stops before.
    chains = known.join(parents, "source", "left_semi").select(
        "name", F.array("name").alias("up"), F.col("source").alias("next")
    ).unionByName(
        known.join(parents, "source", "left_anti").select(
            "name", F.array("name").alias("up"), F.lit(None).cast("string").alias("next")
        )
    )
    chains = cut_lineage(chains)
    while not chains.where(F.col("next").isNotNull()).isEmpty():
        ahead = chains.select(
            F.col("name").alias("next"), F.col("up").alias("more"), F.col("next").alias("after")
        )
        # Finished chains stay out of the join: they would all meet at key NULL.
        finished = chains.where(F.col("next").isNull())
        joined = chains.join(ahead, "next")
        # The first repeated version ends a chain: a cycle was closed.
        unique = F.array_distinct("grown")
        fresh = F.filter(
            F.transform("grown", lambda v, i: F.when(F.array_position(F.col("grown"), v) != i + 1, i)),
            lambda i: i.isNotNull(),
        )
        closed = F.size(unique) < F.size("grown")
        chains = cut_lineage(
            joined.withColumn("grown", F.concat("up", "more")).select(
                "name",
                F.when(closed, F.slice("grown", 1, F.try_element_at(fresh, F.lit(1))))
                .otherwise(F.col("grown"))
                .alias("up"),
                F.when(~closed, F.col("after")).alias("next"),
            ).unionByName(finished)
        )
    if name is not None:
        chains = chains.where(F.col("name") == name)
    return chains.select(
        "name",
        F.array_join(F.reverse("up"), " -> ").alias("path"),
        F.size("up").alias("depth"),
    )


def ancestors(known: DataFrame, name: str) -> DataFrame:
    """``(name, depth)``: a version (depth 0), its source and so on, each once, for unique names.

    Every version has a pointer, to its source at first, and each round lets it
    skip twice as far; the wanted chain doubles by following the pointers of what
    it has. Rows keep their size, and a chain of depth d takes log2(d) rounds. A
    cycle ends where it would repeat: the smaller depth stays.
    """
    parents = known.select(F.col("name").alias("source"))
    skips = cut_lineage(known.join(parents, "source", "left_semi").select("name", F.col("source").alias("ahead")))
    chain = cut_lineage(known.where(F.col("name") == name).select("name", F.lit(0).cast("long").alias("depth")))
    size, span = chain.count(), 1
    while size:
        further = chain.join(skips, "name").select(F.col("ahead").alias("name"), (F.col("depth") + span).alias("depth"))
        chain = cut_lineage(chain.unionByName(further).groupBy("name").agg(F.min("depth").alias("depth")))
        before, size = size, chain.count()
        if size == before:
            break
        onward = skips.select(F.col("name").alias("ahead"), F.col("ahead").alias("beyond"))
        skips = cut_lineage(skips.join(onward, "ahead").select("name", F.col("beyond").alias("ahead")))
        span *= 2
    return chain


def fork(
    spark: SparkSession,
    versions_table: str,
    source_table: str,
    name: str,
    target_table: str,
    description: str = "",
) -> DataFrame:
    """Copy a version's table under a new name and register the new version.

    The source must exist; an existing target is an error. Returns the new row.
    """
    if not spark.catalog.tableExists(source_table):
        raise ValueError(f"source {source_table} does not exist")
    if spark.catalog.tableExists(target_table):
        raise ValueError(f"target {target_table} exists already")
    spark.table(source_table).write.mode("errorifexists").saveAsTable(target_table)
    row = spark.range(1).select(
        F.lit(name).alias("name"),
        F.current_timestamp().alias("created"),
        F.lit(source_table).alias("source"),
        F.lit(description or f"Forked from {source_table}").alias("description"),
        F.lit(False).alias("protected"),
    )
    if spark.catalog.tableExists(versions_table):
        row.write.insertInto(versions_table)
    else:
        row.write.saveAsTable(versions_table)
    return spark.table(versions_table).where(F.col("name") == name)
