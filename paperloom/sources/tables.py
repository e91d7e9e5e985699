"""Readers for the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.session import cut

#: Superseded rows up to this many are sent to every task; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table with its metadata as plain columns; the file key is the id up to its first dash."""
    return table(spark, sf_dir, "chunks").select(
        "line_no", "id", "text",
        F.col("metadata.source").alias("source"), F.col("metadata.page").alias("page"),
        F.col("metadata.article").alias("article"), F.col("metadata.category").alias("category"),
        F.col("metadata.collection").alias("collection"),
        F.substring_index("id", "-", 1).alias("file"), "extracted_at",
    )


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows of each ``key`` those with the highest ``order``, without shuffling the wide columns.

    Only ``(key, order)`` is shuffled, once, to find the keys with superseded rows. They are normally few: up to
    ``BROADCAST_ROWS`` (counted first) go to every task as a hash set, beyond that the rows are joined.
    Rows whose key or order is null are no current row of anything and left out. Rows that repeat the
    highest order of their key are all kept.
    """
    newest = cut(df.select(key, order).where(F.col(key).isNotNull()).groupBy(key).agg(
        F.max(order).alias("__newest"), F.min(order).alias("__oldest")).where("__oldest < __newest").drop("__oldest"))
    n = newest.count()
    df = df.where(F.col(key).isNotNull() & F.col(order).isNotNull())
    if n == 0:
        return df
    newest = newest.withColumnRenamed(key, "__key")
    side = F.broadcast(newest) if n <= BROADCAST_ROWS else newest
    return df.join(side, (F.col(key) == F.col("__key")) & (F.col(order) < F.col("__newest")), "left_anti")
