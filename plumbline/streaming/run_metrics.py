"""Live run metrics: the batch results of ``operators.runlog``, kept up to date by a stream.

``line_no`` comes with each line, so late or reordered lines change nothing. The
state is one row per run, however many lines a run writes. For endless feeds
``windowed_metrics`` keys by day and run, and the watermark evicts closed days.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import clock_seconds
from ..operators import runlog
from ..session import exists, remove, work_path
from ..sources.files import list_files


def live_metrics(lines: DataFrame) -> DataFrame:
    """Streaming or batch ``(job_id, line_no, line)`` to whole-log results per run."""
    aggregates = runlog.extract_metrics(lines).groupBy("job_id").agg(*runlog.run_aggregates())
    return aggregates.withColumn("loss_trend", runlog.loss_trend())


def windowed_metrics(lines: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """As ``live_metrics`` per time window, for lines that carry a ``ts``.

    A watermark needs a zoned timestamp; zone-free ones are taken as UTC,
    whatever the session's zone, so days begin at midnight of the log's clock.
    """
    if isinstance(lines.schema["ts"].dataType, T.TimestampNTZType):
        lines = lines.withColumn("ts", F.timestamp_seconds(clock_seconds(lines, "ts")))
    metrics = runlog.extract_metrics(lines.withWatermark("ts", delay))
    return (
        metrics.groupBy(F.window("ts", width).alias("during"), "job_id")
        .agg(*runlog.run_aggregates())
        .withColumn("loss_trend", runlog.loss_trend())
    )


# Folders of one size that become one of the next.
MERGED = 3
MANIFEST = "first long, last long, tier int"


class RunBoard:
    """Latest metrics and convergence per run, stored as Parquet below ``folder``.

    Each micro-batch writes its own folder. Neighbouring folders of one size are
    merged into the next size, the newest row of each run alone, so n batches
    leave about log n folders and a row is rewritten log n times. What a batch
    leaves is named in a manifest that is written last. A batch that is replayed
    after a failure starts from the manifest before it and replaces what it wrote; folders
    go only when no batch that may still be replayed can name them.
    """

    def __init__(self, spark, folder: str | None = None):
        self.spark = spark
        self.folder = folder or work_path(spark, "run-board")

    def _at(self, *parts: str) -> str:
        return os.path.join(self.folder, *parts)

    def _manifest(self, batch_id: int) -> list[dict]:
        """The live folders after a batch, in order: their first and last batch and size class."""
        if batch_id < 0:
            return []
        rows = self.spark.read.schema(MANIFEST).json(self._at("manifest", f"batch={batch_id}")).collect()
        return sorted(({"first": r["first"], "last": r["last"], "tier": r["tier"]} for r in rows), key=lambda f: f["first"])

    def _path(self, part: dict) -> str:
        return self._at("metrics", f"tier={part['tier']}", f"{part['first']}-{part['last']}")

    def store(self, batch: DataFrame, batch_id: int) -> None:
        """Add a micro-batch, merge what is due, and write the manifest."""
        before = self._manifest(batch_id - 1)
        live = [*before, {"first": batch_id, "last": batch_id, "tier": 0}]
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(self._path(live[-1]))
        while len(live) >= MERGED and len({part["tier"] for part in live[-MERGED:]}) == 1:
            due = live[-MERGED:]
            whole = {"first": due[0]["first"], "last": due[-1]["last"], "tier": due[0]["tier"] + 1}
            self._newest(due).write.mode("overwrite").parquet(self._path(whole))
            live[-MERGED:] = [whole]
        manifest = self.spark.createDataFrame([(p["first"], p["last"], p["tier"]) for p in live], MANIFEST)
        manifest.coalesce(1).write.mode("overwrite").json(self._at("manifest", f"batch={batch_id}"))
        # This batch may be replayed, from the manifest before it; earlier ones may not.
        older = self._at("manifest", f"batch={batch_id - 2}")
        for part in self._manifest(batch_id - 2) if exists(self.spark, older) else []:
            if part not in before and part not in live:
                remove(self.spark, self._path(part))
        remove(self.spark, older)
        # What this batch wrote and merged at once is named by no manifest.
        for part in self._passing(before, live, batch_id):
            remove(self.spark, self._path(part))

    def _passing(self, before: list[dict], live: list[dict], batch_id: int) -> list[dict]:
        made, tier = [{"first": batch_id, "last": batch_id, "tier": 0}], 0
        while made[-1] not in live:
            ends = [p for p in before if p["tier"] == tier]
            made.append({"first": ends[-MERGED + 1]["first"], "last": batch_id, "tier": tier + 1})
            tier += 1
        return made[:-1]

    def _newest(self, parts: list[dict]) -> DataFrame:
        stored = self.spark.read.parquet(*map(self._path, parts))
        names = [c for c in stored.columns if c != "job_id"]
        newest = stored.groupBy("job_id").agg(F.max_by(F.struct(*names), "batch").alias("m"))
        return newest.select("job_id", "m.*")

    def start_metrics(self, lines: DataFrame, **trigger) -> StreamingQuery:
        """Stream the aggregates of changed runs to the board (update mode).

        ``trigger`` is as for ``DataStreamWriter.trigger``: ``processingTime="10 seconds"``
        keeps the stream running; the default takes what is there and ends.
        """
        return (
            live_metrics(lines)
            .writeStream.outputMode("update")
            .option("checkpointLocation", self._at("checkpoint-metrics"))
            .trigger(**(trigger or {"availableNow": True}))
            .foreachBatch(self.store)
            .start()
        )

    def metrics(self) -> DataFrame:
        """The newest row of each run, by the newest whole manifest."""
        done = F.max(F.regexp_extract("path", r"batch=(\d+)/_SUCCESS$", 1).cast("long"))
        marks = list_files(self.spark, self._at("manifest"), "_SUCCESS").select(F.concat("version", F.lit("/"), "name").alias("path"))
        return self._newest(self._manifest(marks.agg(done).first()[0])).drop("batch")

    def start_recent(self, lines: DataFrame, **trigger) -> StreamingQuery:
        """Keep the last three accuracy lines of each run, from which convergence follows.

        A batch can only be replayed from the state before it, so older states are deleted.
        """

        def merge(batch: DataFrame, batch_id: int) -> None:
            new = runlog.recent_accuracies(runlog.extract_metrics(batch))
            new = new.select("job_id", "line_no", "accuracy")
            if batch_id > 0:
                old = self.spark.read.parquet(self._at("recent", f"batch={batch_id - 1}"))
                new = new.unionByName(old.select("job_id", "line_no", "accuracy"))
            kept = runlog.recent_accuracies(new)
            kept.write.mode("overwrite").parquet(self._at("recent", f"batch={batch_id}"))
            if batch_id > 1:
                remove(self.spark, self._at("recent", f"batch={batch_id - 2}"))

        return (
            lines.writeStream.option("checkpointLocation", self._at("checkpoint-recent"))
            .trigger(**(trigger or {"availableNow": True}))
            .foreachBatch(merge)
            .start()
        )

    def convergence(self) -> DataFrame:
        """Convergence per run from the newest stored state."""
        stored = self.spark.read.option("basePath", self._at("recent")).parquet(self._at("recent"))
        newest = stored.agg(F.max("batch")).first()[0]
        return runlog.convergence(stored.where(F.col("batch") == newest))
