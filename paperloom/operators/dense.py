"""Exact nearest rows of a set of query vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that are held by a task at once; more are searched in blocks.
QUERY_BLOCK = 4_096


def valid(embedding: Column, dim: int) -> Column:
    """``dim`` finite numbers, not all zero."""
    return F.coalesce(
        (F.size(embedding) == dim) & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(embedding, lambda x: x != 0), F.lit(False))


def nearest(queries: DataFrame, rows: DataFrame, n: int, group: str | None = None, dim: int = 64) -> DataFrame:
    """(query_id, id, group, dist, rank): per query and group the ``n`` rows at least cosine distance, ranked from 0.

    ``queries`` holds (query_id, embedding), ``rows`` (id, embedding and the group column); both valid vectors. The rows stay
    where they are: every task keeps the n best of its own rows for each query and group over all its batches, and only those are
    shuffled. Distances are rounded to six places before ranking, ties go by id. Every query is compared with every row, so this is for
    the few questions of a session; a row's neighbours for all rows are another matter.
    """
    few = queries.select("query_id", "embedding").limit(QUERY_BLOCK + 1).toArrow()
    blocks = 1 if few.num_rows <= QUERY_BLOCK else -(-queries.count() // QUERY_BLOCK)
    g = F.col(group) if group else F.lit("").alias("grp")
    src = rows.select("id", g.alias("grp"), "embedding")
    kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), "id": rows.schema["id"].dataType.simpleString(),
             "grp": src.schema["grp"].dataType.simpleString()}
    schema = f"query_id {kinds['query_id']}, id {kinds['id']}, grp {kinds['grp']}, dist double"
    parts = None
    for k in range(blocks):
        got = few if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).select("query_id", "embedding").toArrow()
        if not got.num_rows:
            continue
        q = np.stack([np.array(x, dtype=np.float64) for x in got.column("embedding").to_pylist()])
        side = rows.sparkSession.sparkContext.broadcast((got.column("query_id").to_pylist(), q / np.linalg.norm(q, axis=1, keepdims=True)))
        part = src.mapInPandas(_scan(side, n), schema)
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        parts = rows.sparkSession.createDataFrame([], schema)
    w = Window.partitionBy("query_id", "grp").orderBy("dist", "id")
    best = parts.withColumn("rank", (F.row_number().over(w) - 1).cast("long")).where(F.col("rank") < n)
    return best.withColumnRenamed("grp", group) if group else best.drop("grp")


def _scan(side, n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = side.value
        ids, best = np.array(ids), {}  # per group the n best so far of every query: (query, distance, key)
        for b in batches:
            for grp, part in b.groupby("grp", sort=False, dropna=False):
                x = np.stack(part["embedding"].to_numpy()).astype(np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                key = part["id"].to_numpy()
                held = best.get(grp, (np.empty(0, dtype=np.int64), np.empty(0), np.empty(0, dtype=object)))
                parts = [held]
                for lo in range(0, len(q), 256):
                    d = np.round(1 - q[lo : lo + 256] @ x.T, 6) + 0.0
                    last = np.partition(d, n - 1, axis=1)[:, n - 1 : n] if d.shape[1] > n else np.inf  # ties with the n-th stay
                    row, col = np.nonzero(d <= last)
                    parts.append((lo + row, d[row, col], key[col]))
                row, dist, key = (np.concatenate(c) for c in zip(*parts))
                order = np.lexsort((key, dist, row))
                row, dist, key = row[order], dist[order], key[order]
                top = np.arange(len(row)) - np.searchsorted(row, row) < n
                best[grp] = row[top], dist[top], key[top]
        for grp, (row, dist, key) in best.items():
            yield pd.DataFrame({"query_id": ids[row], "id": key, "grp": grp, "dist": dist})

    return run
