"""Fusing ranked lists, weighting collections, filtering by source, diversifying, reranking."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import config as C
from paperloom.functions.text import folder_collection


def page_penalty(page: Column, factor: float = C.EARLY_PENALTY) -> Column:
    """Early pages count less; a missing page, or page 0, is no early page."""
    return F.when(F.coalesce(F.nullif(page, F.lit(0)), F.lit(C.NO_PAGE)) <= C.EARLY_PAGE, factor).otherwise(1.0)


def plain_collection(name: Column) -> Column:
    """The collection's name without its version."""
    return F.regexp_replace(name, f"^{C.VERSION_PREFIX}", "")


def wanted_collections(names: Column) -> Column:
    """What a caller's collection names stand for: one with version and prefix in any case as it is, any other as a folder's name. Null stays null."""
    prefix = C.VERSION_PREFIX + C.COLLECTION_PREFIX

    def one(c: Column) -> Column:
        plain = F.lower(F.trim(c))
        return F.when(plain.startswith(prefix), plain).otherwise(F.concat(F.lit(C.VERSION_PREFIX), folder_collection(F.trim(c))))

    return F.transform(names, one)


def within(hits: DataFrame, wanted: str = "wanted") -> DataFrame:
    """The hits in a collection that their question asks for, all where it names none. Ranks stay as they were."""
    return hits.where(F.col(wanted).isNull() | F.array_contains(F.col(wanted), F.col("collection")))


def weighted(hits: DataFrame, weights: DataFrame, auto: Column | None = None) -> DataFrame:
    """Hits with the weight of their collection, 1 where it has none, less for collections the analysis suggests."""
    w = weights.select(F.col("collection").alias("__c"), F.col("weight").alias("__w"))
    out = hits.join(w, plain_collection(F.col("collection")) == F.col("__c"), "left")
    weight = F.coalesce("__w", F.lit(1.0))
    if auto is not None:
        weight = F.when(F.coalesce(F.array_contains(auto, plain_collection(F.col("collection"))), F.lit(False)), weight * C.AUTO_BOOST).otherwise(weight)
    return out.withColumn("weight", weight).drop("__c", "__w")


def fuse(dense: DataFrame, lexical: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """(query_id, id, rrf, eff, dist and kept columns): reciprocal rank fusion over all lists.

    Both hold query_id, id, list_no, rank, weight, page and the kept columns, ``dense`` also dist. A dense hit's least effective
    distance is kept, the first list's among equals; lexical hits never replace it, and have none but weight and page.
    """
    pen = page_penalty(F.col("page"))
    d = dense.select("query_id", "id", "list_no", "rank", "weight", *keep, F.lit(0).alias("lexical"), "dist",
                     (F.coalesce("dist", F.lit(1.0)) * F.col("weight") * pen).alias("eff"))
    x = lexical.select("query_id", "id", "list_no", "rank", "weight", *keep, F.lit(1).alias("lexical"), F.lit(None).cast("double").alias("dist"),
                       (F.col("weight") * pen).alias("eff"))
    first = F.struct("lexical", "eff", "list_no", "rank")
    best = d.unionByName(x).groupBy("query_id", "id").agg(
        F.round(F.sum(1 / (C.RRF_K + 1 + F.col("rank")) / F.col("weight")), 9).alias("rrf"),
        F.min_by(F.struct("dist", "eff", *keep), first).alias("b"))
    return best.select("query_id", "id", "rrf", F.round("b.eff", 12).alias("eff"), "b.dist", *[f"b.{c}" for c in keep])


def source_filter(cands: DataFrame) -> DataFrame:
    """For intents that compare: the rows of the sources with the highest summed rrf, unless too few would be left.

    ``cands`` holds query_id, id, intent, source, rrf. Ties among sources go by name.
    """
    by = F.create_map(*[F.lit(x) for kv in C.TOP_SOURCES.items() for x in kv])
    named = F.trim("source") != ""
    sums = cands.where(named).groupBy("query_id", "intent", F.trim("source").alias("__s")).agg(F.round(F.sum("rrf"), 9).alias("total"))
    w = Window.partitionBy("query_id").orderBy(F.desc("total"), "__s")
    top = sums.withColumn("k", F.row_number().over(w)).where(F.col("k") <= F.try_element_at(by, F.col("intent"))).select(
        F.col("query_id").alias("__q"), "__s", F.lit(True).alias("in_top"))
    marked = cands.join(top, (F.col("query_id") == F.col("__q")) & (F.col("source") == F.col("__s")), "left").drop("__q", "__s")
    n = F.count("in_top").over(Window.partitionBy("query_id"))
    return marked.withColumn("__n", n).where((F.col("__n") < C.FEWEST_ROWS) | F.col("in_top")).drop("__n", "in_top")


def mmr(pool: pd.DataFrame, size: int, weight: float = C.MMR_LAMBDA) -> pd.DataFrame:
    """Greedy choice of ``size`` rows: relevance less likeness to the rows chosen so far; the pool is in rrf order.

    Likeness is 1 for the same source and article, a half for the same source. A pool that is no larger is taken as it is.
    """
    if len(pool) <= size:
        return pool.assign(pick=range(1, len(pool) + 1))
    top = pool["rrf"].max() or 1.0
    gain = (weight * pool["rrf"] / top).round(9).tolist()
    source, art = pool["source"].fillna("").tolist(), pool["article"].fillna("").tolist()
    like = [0.0] * len(pool)
    left, order = list(range(len(pool))), []
    while len(order) < size:
        k = max(left, key=lambda i: (round(gain[i] - (1 - weight) * like[i], 9), -i))
        order.append(k)
        left.remove(k)
        if source[k]:
            for i in left:
                if source[i] == source[k]:
                    like[i] = max(like[i], 1.0 if art[k] and art[i] == art[k] else 0.5)
    return pool.iloc[order].assign(pick=range(1, size + 1))


def diversify(cands: DataFrame) -> DataFrame:
    """Each query's pool cut by :func:`mmr` to the size its intent asks for, with the order of choice.

    A query's pool is at most its lists' lengths together, some hundred rows, and handled by one task.
    """
    size = {k: v[1] for k, v in C.STRATEGIES.items()}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rrf", "id"], ascending=[False, True], kind="stable")
        return mmr(pdf, size[pdf["intent"].iloc[0]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cands.schema.fields)
    return cands.groupBy("query_id").applyInPandas(run, schema + ", pick int")


def adjusted(cands: DataFrame) -> DataFrame:
    """Scores lowered for every further row of a source: k-th repeat times max(0.55, 1 - 0.15 k), by (score desc, eff, id)."""
    w = Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "eff", "id")
    factor = F.greatest(F.lit(C.DIVERSITY_FLOOR), 1 - C.DIVERSITY_STEP * (F.row_number().over(w) - 1))
    factor = F.when(F.coalesce(F.trim("source"), F.lit("")) == "", 1.0).otherwise(factor)
    return cands.withColumn("factor", F.round(factor, 6)).withColumn("adjusted", F.round(F.col("score") * F.col("factor"), 6))


def cross_cut(cands: DataFrame, cross: Column | None = None) -> DataFrame:
    """``cands`` with ``top_k`` for their intent and their order ``k`` from 1, cut to 20 or ``top_k``: by ``cross`` if there are more, else as picked."""
    top_k = F.create_map(*[F.lit(x) for k, v in C.STRATEGIES.items() for x in (k, v[0])])
    q = Window.partitionBy("query_id")
    pool = cands.withColumn("top_k", F.try_element_at(top_k, F.col("intent"))).withColumn("cut", F.greatest(F.lit(C.RERANK_CUT), F.col("top_k")))
    pool = pool.withColumn("over", F.count(F.lit(1)).over(q) > F.col("cut"))
    order = [F.asc("pick")] if cross is None else [F.desc(F.when(F.col("over"), cross)), F.asc("pick")]
    return pool.withColumn("k", F.row_number().over(q.orderBy(*order))).where(F.col("k") <= F.col("cut")).drop("over", "cut")


def rerank(cands: DataFrame, scores: DataFrame, cross: Column | None = None) -> DataFrame:
    """The top rows of each query by adjusted score: (query_id, id, score, adjusted, place).

    ``cands`` holds query_id, id, pick, intent, source, eff; ``scores`` (query_id, id, score), 5 where missing. A pool over the
    cut is first cut by ``cross`` (a cross-encoder score), or in its order without one. A pool no larger than the answer stays in its order, and so
    does one that no score was given for, as when a reply can't be read.
    """
    q = Window.partitionBy("query_id")
    pool = cross_cut(cands, cross)
    pool = pool.join(scores.select("query_id", "id", F.col("score").alias("given")), ["query_id", "id"], "left").withColumn(
        "score", F.coalesce("given", F.lit(C.DEFAULT_SCORE)))
    small = (F.count(F.lit(1)).over(q) <= F.col("top_k")) | (F.count("given").over(q) == 0)
    pool = adjusted(pool.withColumn("small", small))
    pool = pool.withColumn("adjusted", F.when(F.col("small"), F.col("score")).otherwise(F.col("adjusted")))
    place = F.row_number().over(q.orderBy(F.when(F.col("small"), F.col("k")), F.desc("adjusted"), "eff", "id"))
    return pool.withColumn("place", place.cast("long")).where(F.col("place") <= F.col("top_k")).select("query_id", "id", "source", "score", "adjusted", "place")


def quota_pick(pool: pd.DataFrame, top_k: int, quotas: dict[str, int]) -> pd.DataFrame:
    """Rows chosen first by collection quotas, then by effective distance; one per (source, page, article).

    ``pool`` is in order of eff. The choice is cut to ``top_k`` in order of choice and then put in order of eff.
    """
    key = list(zip(pool["source"], pool["page"], pool["article"]))
    names = pool["plain"].tolist()
    seen, chosen = set(), []
    for name, quota in quotas.items():
        for i in range(len(pool)):
            if quota <= 0:
                break
            if names[i] == name and key[i] not in seen:
                seen.add(key[i])
                chosen.append(i)
                quota -= 1
    for i in range(len(pool)):
        if len(chosen) >= top_k:
            break
        if key[i] not in seen:
            seen.add(key[i])
            chosen.append(i)
    return pool.iloc[sorted(chosen[:top_k])]


def quota_search(hits: DataFrame, weights: DataFrame, top_k: int, filtered: bool = False) -> DataFrame:
    """The older search: per-collection dense hits (query_id, id, collection, source, page, article, dist) to ``top_k`` a query.

    Quotas hold unless the caller filters by collection. A query's pool is at most max(3 top_k, 20) rows per collection.
    """
    plain = F.regexp_replace(plain_collection(F.col("collection")), f"^{C.COLLECTION_PREFIX}", "")
    rows = weighted(hits, weights).withColumn("plain", plain).withColumn(
        "eff", F.round(F.col("dist") * F.col("weight") * page_penalty(F.col("page"), C.OLD_EARLY_PENALTY), 12))
    rows = rows.select("query_id", "id", "plain", "source", "page", "article", "dist", "eff")
    quotas = {} if filtered else dict(C.QUOTAS)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["eff", "id"], kind="stable")
        pdf = pdf.assign(source=pdf["source"].fillna(""), article=pdf["article"].fillna(""), page=pdf["page"].fillna(0).astype("int32"))
        out = quota_pick(pdf, top_k, quotas)
        return out.assign(place=range(1, len(out) + 1))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy("query_id").applyInPandas(run, schema + ", place int")
