"""Ingest in cycles: what changed on disk is parsed, what failed is tried again, what went is gone, and readers see whole cycles only.

State is a folder of numbered cycles. A cycle's chunks and failures are written first, its manifest last; a manifest entry names the cycle in
which its file was last parsed (``made``), and a chunk counts as long as its file's entry names its own cycle. So a changed or deleted file loses its
chunks in the moment in which the new manifest is there, nothing is rewritten, and a cycle that was lost halfway and runs again leaves the same.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import ingest
from paperloom.session import cut
from paperloom.sources.files import newest_version

ENTRY = "path string, sha256 string, size long, mtime double, chunk_count int, made int, tries int"
#: Files that one task parses, after which its memory is given back.
BATCH = 200
#: (path, size, mtime, sha256) of pending files to (path, id, ... , error): chunks, or one row with an error.
Work = Callable[[DataFrame], DataFrame]


def manifest(spark: SparkSession, state: str) -> DataFrame:
    n = newest_version(spark, f"{state}/manifest")
    return spark.read.parquet(f"{state}/manifest/version={n}") if n is not None else spark.createDataFrame([], ENTRY)


def chunks(spark: SparkSession, state: str) -> DataFrame:
    """The chunks of the files as they were last parsed."""
    live = manifest(spark, state).where("chunk_count > 0").select("path", F.col("made").alias("cycle"))
    rows = spark.read.option("basePath", f"{state}/chunks").parquet(f"{state}/chunks/cycle=*")
    return rows.join(live, ["path", "cycle"], "left_semi").drop("cycle")


def failures(spark: SparkSession, state: str) -> DataFrame:
    """(path, tries, error) of the files that failed when they were last tried."""
    bad = manifest(spark, state).where("chunk_count = 0").select("path", F.col("made").alias("cycle"), "tries")
    rows = spark.read.schema("path string, error string, cycle int").option("basePath", f"{state}/failures").parquet(f"{state}/failures/cycle=*")
    return bad.join(rows, ["path", "cycle"]).select("path", "tries", "error")


def cycle(spark: SparkSession, state: str, disk: DataFrame, work: Work, number: int | None = None) -> int:
    """One cycle over ``disk`` (path, size, mtime, sha256); gives its number. Pending files are dealt to tasks ``BATCH`` at a time in working order."""
    last = newest_version(spark, f"{state}/manifest")
    no = number if number is not None else (last or 0) + 1
    if last is not None and last >= no:
        return no  # it ran before
    old = manifest(spark, state)
    disk = cut(disk.select("path", "size", "mtime", "sha256"))
    changes = cut(ingest.detect_changes(disk, old))
    order = ingest.work_order(changes)
    tasks = max(1, -(-changes.where(F.col("status").isin(*ingest.PENDING)).count() // BATCH))
    pending = disk.join(order, "path").withColumn("batch", F.expr(f"(place - 1) div {BATCH}")).repartition(tasks, "batch")
    done = cut(work(pending.select("path", "size", "mtime", "sha256")))
    done.where("error IS NULL").drop("error").write.mode("overwrite").parquet(f"{state}/chunks/cycle={no}")
    done.where("error IS NOT NULL").select("path", "error").distinct().write.mode("overwrite").parquet(f"{state}/failures/cycle={no}")
    n = done.groupBy("path").agg(F.count_if(F.col("error").isNull()).cast("int").alias("n"))
    tried = old.select("path", F.col("chunk_count").alias("old_n"), F.col("made").alias("old_made"), F.col("tries").alias("old_tries"))
    new = disk.join(changes.select("path", "status"), "path").where(F.col("status").isin(*ingest.PENDING, "touched")).join(n, "path", "left").join(tried, "path", "left")
    touched = F.col("status") == "touched"
    new = new.select("path", "sha256", "size", "mtime", F.when(touched, F.col("old_n")).otherwise(F.coalesce("n", F.lit(0))).alias("chunk_count"),
                     F.when(touched, F.col("old_made")).otherwise(F.lit(no)).alias("made"),
                     F.when(touched, F.col("old_tries")).otherwise(F.when(F.col("status") == "retried", F.col("old_tries")).otherwise(0) + 1).alias("tries"))
    kept = old.join(changes.where(F.col("status").isin("deleted", *ingest.PENDING, "touched")), "path", "left_anti")
    kept.unionByName(new).write.mode("overwrite").parquet(f"{state}/manifest/version={no}")
    return no


def run(spark: SparkSession, state: str, scan: Callable[[], DataFrame], work: Work, once: bool = False, interval: str = "60 seconds", duration: float | None = None) -> None:
    """Cycles until ``duration`` seconds have passed (never, if None), one every ``interval``, or one cycle alone. A cycle that fails is tried again with the next."""
    if once:
        cycle(spark, state, scan(), work)
        return
    over = False
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def step(_: DataFrame, no: int) -> None:
        if not over:
            cycle(spark, state, scan(), work)

    q = clock.writeStream.foreachBatch(step).trigger(processingTime=interval).start()
    try:
        q.awaitTermination(duration) if duration is not None else q.awaitTermination()
    finally:
        over = True
        while q.isActive and q.status["isTriggerActive"]:  # a cycle that has begun ends
            time.sleep(0.1)
        q.stop()
