"""Per-key results when a few keys hold most rows.

Nothing here gathers the rows of a key. Every result is algebraic: each task reduces its rows to one
small state per key, and only those states are shuffled. Where the state is of fixed width that is Spark's hash aggregate, which
falls back to sorting and spilling when its table is full; a state that holds text (``max_by`` of an entry) takes its sort aggregate, which sorts a
task's rows by key, spills, and combines them in one pass. For the k highest rows per key the state is the k rows:
each task cuts its part of a key to k before the shuffle, so that a key with a third of all rows sends
k rows per task, not a third of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_totals(df: DataFrame, key: str, **aggregates: Column) -> DataFrame:
    """Algebraic aggregates per non-null key by map-side combining; an empty input gives no rows."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*[c.alias(n) for n, c in aggregates.items()])


def top_rows(df: DataFrame, key: str, order: Sequence[Column], k: int, salts: int = 16, rank: str = "rank_no") -> DataFrame:
    """The ``k`` first rows of every non-null key in the given order, with their rank from 1.

    Two levels: the rows of a key are spread over ``salts`` parts, each cut to k on the map side
    (Spark's partial window group limit) and again after the shuffle, then k * salts rows at most
    are left per key for the last cut. Ties in ``order`` are broken by whatever else it holds; give
    a total order for a defined result.
    """
    names = [c for c in df.columns]
    salted = df.where(F.col(key).isNotNull()).withColumn("__salt", F.pmod(F.xxhash64(*names), F.lit(salts)))
    part = Window.partitionBy(key, "__salt").orderBy(*order)
    whole = Window.partitionBy(key).orderBy(*order)
    return (
        salted.withColumn("__rn", F.row_number().over(part)).where(F.col("__rn") <= k).drop("__rn", "__salt")
        .withColumn(rank, F.row_number().over(whole)).where(F.col(rank) <= k)
    )


def instant(text: Column) -> Column:
    """An ISO 8601 text in UTC, with or without fraction or zone, as a timestamp; anything else as null."""
    return F.try_to_timestamp(text)


def current_entries(manifest: DataFrame) -> DataFrame:
    """One row per non-null path: the entry indexed last.

    Exact repeats collapse. An unreadable ``indexed_at`` counts as the oldest. Entries indexed at the
    same instant are ordered by sha256, then chunk_count, then collection, and the highest is taken.
    ``max_by`` over a struct keeps one state per path on the map side.
    """
    rank = F.struct(instant(F.col("indexed_at")), F.col("sha256"), F.col("chunk_count"), F.col("collection"))
    entry = F.struct("category", "collection", "sha256", "size", "mtime", "chunk_count", "indexed_at")
    return (
        manifest.where(F.col("path").isNotNull()).groupBy("path")
        .agg(F.max_by(entry, rank).alias("e")).select("path", "e.*")
    )


def largest_files(manifest: DataFrame, k: int = 20) -> DataFrame:
    """Per collection the ``k`` current files with most chunks, ties by path in code point order."""
    files = (
        current_entries(manifest.select("path", "category", "collection", "sha256", "size", "mtime", "chunk_count", "indexed_at"))
        .where("chunk_count <> 0").select("collection", "path", "chunk_count")
    )
    return top_rows(files, "collection", [F.desc("chunk_count"), F.asc("path")], k)
