"""Queries over crowded keys (problem 1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import keyed
from paperloom.plans.registry import core
from paperloom.sources.tables import table

CURRENT = """
WITH cur AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY path ORDER BY try_cast(indexed_at AS TIMESTAMP) DESC NULLS LAST,
      sha256 DESC NULLS LAST, chunk_count DESC NULLS LAST, collection DESC NULLS LAST) AS rn
    FROM manifest WHERE path IS NOT NULL) WHERE rn = 1)
"""


@core.query("p1_found", CURRENT + """
SELECT collection, path FROM (
  SELECT collection, path, row_number() OVER (PARTITION BY collection ORDER BY chunk_count DESC, path) AS k
  FROM cur WHERE collection IS NOT NULL AND chunk_count <> 0) WHERE k <= 20""")
def p1_found(spark, d):
    return keyed.largest_files(table(spark, d, "manifest"), 20).select("collection", "path")


@core.query("p1_collection_totals", CURRENT + """
SELECT collection, count(*) AS files, count(*) FILTER (WHERE chunk_count > 0) AS files_with_chunks,
  CAST(coalesce(sum(chunk_count), 0) AS BIGINT) AS chunks, max(chunk_count) AS largest,
  CAST(sum(size) AS BIGINT) AS bytes
FROM cur WHERE collection IS NOT NULL GROUP BY collection""")
def p1_collection_totals(spark, d):
    return keyed.key_totals(
        keyed.current_entries(table(spark, d, "manifest")), "collection",
        files=F.count(F.lit(1)), files_with_chunks=F.count_if(F.col("chunk_count") > 0),
        chunks=F.coalesce(F.sum("chunk_count"), F.lit(0).cast("bigint")), largest=F.max("chunk_count"), bytes=F.sum("size"),
    )
