"""What a model may call while it answers: searches and lookups, for many calls at once, with an error in place of a result where a call is wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom import config as C
from paperloom.functions import text as T
from paperloom.operators import dense, references

RESULT = ("call_id", "error", "place", "id", "source", "page", "article", "score", "text")
ARGS = "category string, query string, top_k int, source_file string, pasal string, reference string"


def list_categories(chunks: DataFrame) -> DataFrame:
    """(key, collection, chunks): the categories in their order with the number of their chunks, 0 for those without any."""
    spark = chunks.sparkSession
    keys = spark.createDataFrame([(k, f"{C.VERSION_PREFIX}{C.COLLECTION_PREFIX}{k}", i) for i, k in enumerate(C.COLLECTIONS)], "key string, collection string, place int")
    n = chunks.where(F.col("collection").isNotNull()).groupBy("collection").agg(F.count(F.lit(1)).alias("chunks"))
    return F.broadcast(keys).join(n, "collection", "left").select("key", "collection", F.coalesce("chunks", F.lit(0)).alias("chunks"))


def dispatch(calls: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row per result (RESULT), or one per failed call with its error.

    ``calls`` holds (call_id, name, args, embedding): the arguments as JSON, and the vector of the query for searches; ``chunks`` (id, source, page, idx, article,
    text, collection), ``vectors`` (id, embedding). Names: search_collection, fetch_article_chunks, fetch_cross_reference. Errors: unknown tool, arguments,
    unknown category, and those of a reference (empty, type, number, source).
    """
    a = F.from_json("args", ARGS)
    known = F.create_map(*[F.lit(x) for k, v in C.ALIASES.items() for x in (k, f"{C.VERSION_PREFIX}{C.COLLECTION_PREFIX}{v}")])
    names = ("search_collection", "fetch_article_chunks", "fetch_cross_reference")
    c = calls.withColumn("a", a).withColumn("target", F.try_element_at(known, F.lower(F.trim("a.category"))))
    bad_args = F.json_array_length(F.concat(F.lit("["), "args", F.lit("]"))).isNull() | F.col("args").isNull()
    error = (F.when(~F.coalesce(F.col("name").isin(*names), F.lit(False)), "unknown tool").when(bad_args, "arguments")
             .when((F.col("name") == names[0]) & F.col("target").isNull(), "unknown category").when((F.col("name") == names[0]) & F.col("embedding").isNull(), "arguments"))
    c = c.withColumn("error", error)
    ok = c.where("error IS NULL")
    meta = chunks.select(F.col("id").alias("__id"), "source", "page", "article", "text", F.col("collection").alias("__collection"))
    none = lambda kind: F.lit(None).cast(kind)

    # Searches: the nearest of every collection, of which a call takes those of its own.
    s = ok.where(F.col("name") == names[0])
    side = s.select(F.col("call_id").alias("__call"), "target", F.greatest(F.lit(1), F.least(F.coalesce("a.top_k", F.lit(5)), F.lit(C.TOOL_CHUNKS))).alias("top_k"))
    placed = vectors.select("id", "embedding").join(chunks.select("id", "collection").where(F.col("collection").isin([f"{C.VERSION_PREFIX}{C.COLLECTION_PREFIX}{x}" for x in C.COLLECTIONS])), "id")
    hits = dense.nearest(s.select(F.col("call_id").alias("query_id"), "embedding"), placed, C.TOOL_CHUNKS, "collection").join(side, (F.col("query_id") == F.col("__call")) & (F.col("collection") == F.col("target")))
    hits = hits.where(F.col("rank") < F.col("top_k")).join(meta, (F.col("id") == F.col("__id")) & (F.col("collection") == F.col("__collection")))
    searched = hits.select(F.col("query_id").alias("call_id"), none("string").alias("error"), (F.col("rank") + 1).alias("place"), "id", "source", F.coalesce("page", F.lit(0)).alias("page"), "article",
                           F.round(1 - F.col("dist"), 3).alias("score"), F.substring(T.clean_chunk(F.col("text")), 1, C.TOOL_CHARS).alias("text"))

    # Lookups: by file name, or by a reference that is resolved to one first.
    direct = ok.where(F.col("name") == names[1]).select(F.col("call_id").alias("request_id"), F.col("a.source_file").alias("source"), F.nullif("a.pasal", F.lit("")).alias("pasal"))
    refs = references.parse_reference(ok.where(F.col("name") == names[2]).select(F.col("call_id").alias("ref_id"), F.col("a.reference").alias("reference")))
    plain = F.replace(F.replace("collection", F.lit(C.VERSION_PREFIX), F.lit("")), F.lit(C.COLLECTION_PREFIX), F.lit(""))
    sources = chunks.where("source IS NOT NULL AND collection IS NOT NULL").select("source", plain.alias("collection")).distinct()
    found = refs.join(references.resolve(refs, sources), "ref_id", "left")
    named = found.where("matched_source IS NOT NULL").select(F.col("ref_id").alias("request_id"), F.col("matched_source").alias("source"), "pasal")
    looked = references.article_lookup(direct.unionByName(named), chunks).join(chunks.select(F.col("id").alias("__id"), "source").distinct(), F.col("id") == F.col("__id"))
    looked = looked.select(F.col("request_id").alias("call_id"), none("string").alias("error"), "place", "id", "source", "page", "article", none("double").alias("score"), "text")
    lost = found.where("matched_source IS NULL").select(F.col("ref_id").alias("call_id"), F.coalesce("error", F.lit("source")).alias("error"))
    failed = c.where("error IS NOT NULL").select("call_id", "error").unionByName(lost)
    kinds = {f.name: f.dataType for f in searched.schema.fields}
    failed = failed.select("call_id", "error", *[none(kinds[x]).alias(x) for x in RESULT[2:]])
    return searched.unionByName(looked).unionByName(failed)
