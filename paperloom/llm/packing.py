"""Filling containers of fixed capacity (problem 7).

Harmonic packing: a length over capacity/(j+1) and up to capacity/j belongs to class j, and any j items
of a class fit together. The containers of a class are therefore numbered, not searched: every worker
fills its own share of the rows and needs nothing from the others. In a container of class j there is
room left, up to capacity/(j+1) and more; the plain method wastes it. Here each worker tops up its
containers from its smaller items by best fit, largest items first, before the rest are numbered by
class; see ``pack``.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PACKED = "container string, position int, size long, start long"


def byte_tokens(text: Column) -> Column:
    """Size in tokens of a byte-level tokenizer without merges: one per UTF-8 byte and one end token."""
    return F.octet_length(text).cast("long") + F.lit(1)


def spans(df: DataFrame, size: Column, capacity: int, keep: tuple[str, ...]) -> DataFrame:
    """Items of at most ``capacity``: a row each, and for larger ones a row per part, with its start offset."""
    return df.where(size.isNotNull() & (size > 0)).select(*keep, size.alias("__size")).select(
        *keep, (F.col("__size") > capacity).alias("is_split"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__size - 1) div {capacity}"))).alias("__part"), "__size",
    ).select(*keep, "is_split", (F.col("__part") * capacity).alias("start"),
             F.least(F.lit(capacity), F.col("__size") - F.col("__part") * capacity).cast("long").alias("size"))


def fill(sizes: np.ndarray, capacity: int, top_up: bool = True) -> np.ndarray:
    """A container number for every size. Classes are taken from the largest items down.

    Each container of class j starts with j items of its class; then, if ``top_up``, the largest unplaced
    item that fits its remaining room is added, again and again. Every class's containers are filled this way
    before the next class is begun, so that small items serve as filling first. Items wait by size; the largest size
    with items left up to a given one is found by links that skip the emptied sizes, in nearly constant time.
    """
    kinds, of = np.unique(sizes, return_inverse=True)
    waiting = np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of, minlength=len(kinds)))[:-1])
    waiting = [w[::-1].tolist() for w in waiting] if len(kinds) else []
    kinds = kinds.tolist()
    link = list(range(len(kinds) + 1))  # of the sizes by rank from 1; 0 stands for none

    def largest(rank: int) -> int:
        while link[rank] != rank:
            link[rank] = rank = link[link[rank]]
        return rank

    out = np.full(len(sizes), -1, dtype=np.int64)
    no = 0

    def place(rank: int) -> int:
        out[waiting[rank - 1].pop()] = no
        if not waiting[rank - 1]:
            link[rank] = rank - 1
        return kinds[rank - 1]

    while rank := largest(len(kinds)):
        room, j = capacity, capacity // kinds[rank - 1]
        for _ in range(j):  # j items of class j fit in any case
            rank = largest(len(kinds))
            if not rank or kinds[rank - 1] <= capacity // (j + 1):
                break
            room -= place(rank)
        while top_up and (rank := largest(bisect_right(kinds, room))):
            room -= place(rank)
        no += 1
    return out


def pack(df: DataFrame, size: Column, capacity: int = 4096, keep: tuple[str, ...] = ("doc_id",), share: int = 50_000,
         top_up: bool = True) -> DataFrame:
    """Every item (or part of a larger one) with its container, its place there, size and start offset.

    Rows with null or non-positive size take no room and are left out. Items are dealt to
    ``ceil(rows / share)`` shares by a hash of the kept columns: shares are of like size whatever the data, one
    task holds only (key, size) of its share, and no share depends on another. Each share leaves less than one
    container of each class unfilled, which for 50,000 items is under 0.1 per cent of the room. A container is named
    ``<share>-<number>``; the result is the same for the same input rows and partitioning of nothing else.
    """
    items = spans(df, size, capacity, keep)
    n = max(1, -(-df.count() // share))
    dealt = items.withColumn("__share", F.pmod(F.xxhash64(*keep), F.lit(n)).cast("int"))
    fields = [f for f in items.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", is_split boolean, " + PACKED

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*keep, "start"], kind="stable").reset_index(drop=True)
        no = fill(pdf["size"].to_numpy(), capacity, top_up)
        pdf["container"] = [f"{pdf['__share'][0]}-{k}" for k in no]
        pdf["position"] = pd.Series(no).groupby(no).cumcount().astype("int32")
        return pdf[[*[f.name for f in fields], "is_split", "container", "position", "size", "start"]]

    return dealt.groupBy("__share").applyInPandas(one, schema=schema)


def split_items(packed: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keys of the items that the packing had to split, each once."""
    return packed.where("is_split").select(*keep).distinct()


def checked(packed: DataFrame, capacity: int = 4096, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row on a packing, none for an empty one: items, parts and their sizes in all; whether no container is over its capacity, every item that was not split is in
    one container, and at least 98 per cent of the room is filled, but for one container of each share, which may be the rest."""
    rooms = packed.groupBy("container").agg(F.sum("size").alias("used")).agg(
        F.max("used").alias("most"), F.count(F.lit(1)).alias("containers"), F.countDistinct(F.substring_index("container", "-", 1)).alias("shares"))
    items = packed.groupBy(*keep).agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("size"), F.max("is_split").alias("split"))
    items = items.agg(F.count(F.lit(1)).alias("items"), F.sum("parts").alias("parts"), F.sum("size").alias("total"), F.bool_and(F.col("split") | (F.col("parts") == 1)).alias("whole"))
    return items.where("items > 0").crossJoin(rooms).select(  # one row each
        "items", "parts", "total", (F.col("most") <= capacity).alias("within"), "whole", (F.col("total") >= (F.col("containers") - F.col("shares")) * capacity * 0.98).alias("filled"))
