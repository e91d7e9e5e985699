"""Incremental ingest: what changed, in which order to work, and the tables after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import config as C

#: States of a path that call for parsing it.
PENDING = ("added", "modified", "retried")


def detect_changes(disk: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, status, size): every path of either side once.

    ``disk`` holds path, size, mtime, sha256 (null if unreadable), ``manifest`` path, size, mtime, sha256, chunk_count. In this order: only
    on disk added, only in the manifest deleted; failed before and over the size limit skipped; same size and time unchanged;
    unreadable; same content touched; failed before retried; else modified.
    """
    a = disk.select("path", F.col("size").alias("d_size"), F.col("mtime").alias("d_mtime"), F.col("sha256").alias("d_sha"), F.lit(True).alias("on_disk"))
    b = manifest.select("path", "size", "mtime", F.col("sha256").alias("sha"), (F.coalesce("chunk_count", F.lit(0)) == 0).alias("failed"), F.lit(True).alias("known"))
    same = (F.col("d_size") == F.col("size")) & (F.abs(F.col("d_mtime") - F.col("mtime")) < C.MTIME_SLACK) & ~F.col("failed")
    status = (
        F.when(F.col("known").isNull(), "added").when(F.col("on_disk").isNull(), "deleted")
        .when(F.col("failed") & (F.col("d_size") > C.MAX_FILE_BYTES), "skipped").when(same, "unchanged").when(F.col("d_sha").isNull(), "unreadable")
        .when((F.col("d_sha") == F.col("sha")) & ~F.col("failed"), "touched").when(F.col("failed"), "retried").otherwise("modified"))
    return a.join(b, "path", "full").select("path", status.alias("status"), F.coalesce("d_size", "size").alias("size"))


def work_order(changes: DataFrame) -> DataFrame:
    """(path, place): what to parse, new paths first, then by size, then by path."""
    # Ranked within classes of like size, to which the number of files in the classes before is added: no task sorts all.
    p = changes.where(F.col("status").isin(*PENDING)).withColumn("__b", F.when(F.col("status") == "added", 0).otherwise(1)).withColumn("__s", F.log2(F.col("size") + 1).cast("int"))
    per = p.groupBy("__b", "__s").agg(F.count(F.lit(1)).alias("n"))
    before = per.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("__b", "__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # some 120 rows
    local = Window.partitionBy("__b", "__s").orderBy("size", "path")
    return p.withColumn("k", F.row_number().over(local)).join(F.broadcast(before), ["__b", "__s"]).select("path", (F.col("k") + F.col("before")).alias("place"))


def first_files(changes: DataFrame, n: int) -> DataFrame:
    """(path, size) of the first ``n`` pending files in working order, by a heap per task."""
    p = changes.where(F.col("status").isin(*PENDING))
    return p.orderBy(F.when(F.col("status") == "added", 0).otherwise(1), "size", "path").limit(n).select("path", "size")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key; ``new`` must hold a key once."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def replace(rows: DataFrame, new: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` without those of the keys in ``gone``, and the new ones, in one step: nothing is lost between a deletion and an insertion."""
    return delete(rows, gone, [key]).unionByName(new)


def apply_changes(manifest: DataFrame, disk: DataFrame, changes: DataFrame) -> DataFrame:
    """The manifest after a cycle: deleted paths gone, pending ones as on disk, touched ones with their new time."""
    st = changes.select("path", "status")
    kept = manifest.join(st.where(F.col("status").isin("deleted", *PENDING, "touched")), "path", "left_anti")
    new = disk.join(st.where(F.col("status").isin(*PENDING, "touched")), "path").drop("status")
    return kept.unionByName(new.select(*manifest.columns))


def documents_per_collection(manifest: DataFrame) -> DataFrame:
    """(collection, documents): current files that gave chunks; entries without collection are left out."""
    ok = F.coalesce("chunk_count", F.lit(0)) > 0
    return manifest.where(F.col("collection").isNotNull() & ok).groupBy("collection").agg(F.count(F.lit(1)).alias("documents"))


def status_report(entries: DataFrame) -> DataFrame:
    """(category, total, ok, failed, chunks) with a TOTAL row."""
    n = F.coalesce("chunk_count", F.lit(0))
    return entries.where(F.col("category").isNotNull()).rollup("category").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(n > 0).alias("ok"), F.count_if(n == 0).alias("failed"), F.sum(n).alias("chunks")).withColumn(
        "category", F.coalesce("category", F.lit("TOTAL")))


def failure_class(error: Column, size: Column) -> Column:
    """Why a file failed, from its error and size."""
    return (F.when(size.isNull(), "missing").when(size > C.MAX_FILE_BYTES, "oversize").when(error.startswith("stat:"), "unreadable")
            .when(F.lower(error).contains("timeout"), "timeout").otherwise("parse"))


def join_vectors(vectors: DataFrame, meta: DataFrame) -> DataFrame:
    """Vectors with the text and metadata of their chunk; a vector without chunk is left out (see :func:`missing_meta`)."""
    return vectors.join(meta, "id")


def missing_meta(vectors: DataFrame, meta: DataFrame) -> DataFrame:
    return vectors.join(meta.select("id"), "id", "left_anti")
