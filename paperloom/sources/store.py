"""Chunks and vectors kept as tables partitioned by collection: pruned by collection, replaced by collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rebuild(df: DataFrame, path: str) -> None:
    """Drop the table and write it anew."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("collection").parquet(path)


def replace_collections(df: DataFrame, path: str) -> None:
    """Replace the collections that ``df`` has rows of, leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(path)


def read(spark: SparkSession, path: str, collections: list[str] | None = None) -> DataFrame:
    """The table, of the named collections alone if any are named: other partitions aren't touched."""
    df = spark.read.parquet(path)
    return df.where(F.col("collection").isin(collections)) if collections else df


class Catalog:
    """Where the tables lie: below a folder (``files``) or in the session's catalog by name (``named``).

    Any other mode is refused, and so is a folder that isn't there.
    """

    def __init__(self, spark: SparkSession, mode: str | None, root: str = "") -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.mode = (mode or "files").strip().lower()
        if self.mode not in ("files", "named"):
            raise ValueError(f"mode must be 'files' or 'named', not {mode!r}")
        if self.mode == "files":
            at = spark._jvm.org.apache.hadoop.fs.Path(self.root)
            if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
                raise FileNotFoundError(f"no folder {self.root}; write the tables first or choose mode 'named'")

    def table(self, name: str, collections: list[str] | None = None) -> DataFrame:
        if self.mode == "files":
            return read(self.spark, f"{self.root}/{name}", collections)
        df = self.spark.table(name)
        return df.where(F.col("collection").isin(collections)) if collections else df


def save_vectors(vectors: DataFrame, path: str, model: str) -> DataFrame:
    """Write (id, embedding, ...) by collection, and beside it what was written: model, rows, dimension. The description comes last: without it a load is not whole."""
    rebuild(vectors, f"{path}/vectors")
    n = vectors.sparkSession.read.parquet(f"{path}/vectors").agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("embedding")).alias("dim"))
    n.select(F.lit(model).alias("model"), "rows", "dim").coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    return vectors.sparkSession.read.schema("model string, rows long, dim int").json(f"{path}/meta")


def check_aligned(vectors: int, ids: int) -> None:
    """Vectors and ids that go together row by row must be as many."""
    if vectors != ids:
        raise ValueError(f"{vectors} vectors, {ids} ids")
