"""Term statistics and BM25 over all documents, for a set of queries at once, from an index that is stored and read back.

An index is three tables: occurrences (bucket, term, id, dl), partitioned by a hash of the term, so that a search reads the buckets of its
terms alone; terms (term, df, idf) in the same buckets; one row of statistics. Occurrences lie sorted, so that repeats take next to no room and nothing
is aggregated when the index is built; how often a document has a term is counted for the terms of a search. The index lies in a folder named by its fingerprint, which tells the
rows it was built from: an index with another fingerprint is never read, and goes once the new one is finished.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom import config as C
from paperloom.functions.text import tokens
from paperloom.session import cut

#: Query terms up to this many are sent to every task, and their buckets read alone; with more all buckets are read and joined by a shuffle.
BROADCAST_TERMS = 200_000
BUCKETS = 32


class Index(NamedTuple):
    occurrences: DataFrame  # bucket, term, id, dl: as often as the document has the term
    terms: DataFrame  # bucket, term, df, idf
    stats: DataFrame  # one row: n, avgdl


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def occurrences(docs: DataFrame) -> DataFrame:
    """(bucket, term, id, dl) of (id, text), a row per token; null texts have none."""
    toks = docs.select("id", tokens(F.col("text")).alias("t"))
    found = toks.select("id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return found.select(bucket(F.col("term")).alias("bucket"), "term", "id", "dl")


def postings(found: DataFrame) -> DataFrame:
    """(term, id, dl, tf) of occurrences."""
    return found.groupBy("term", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row (n, avgdl)."""
    return docs.select(F.size(tokens(F.col("text"))).alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def inverse_frequencies(docs: DataFrame, stats: DataFrame) -> DataFrame:
    """(bucket, term, df, idf); a negative idf (a term in more than half the documents) becomes a quarter of the mean over all terms.

    A document is reduced to its distinct terms in place, so that the shuffle carries one count per term and task.
    """
    own = docs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    df, n = own.groupBy("term").agg(F.count(F.lit(1)).alias("df")), F.broadcast(stats.select("n"))  # one row
    raw = df.crossJoin(n).select("term", "df", (F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw"))
    mean = F.broadcast(raw.agg((F.avg("raw") * C.BM25_EPSILON).alias("floor")))  # one row
    return raw.crossJoin(mean).select(bucket(F.col("term")).alias("bucket"), "term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))


def computed(docs: DataFrame) -> Index:
    """The index of (id, text), not stored."""
    stats = corpus_stats(docs)
    return Index(occurrences(docs), inverse_frequencies(docs, stats), stats)


def load(spark: SparkSession, path: str, fingerprint: str) -> Index | None:
    """The stored index of that fingerprint, None if there is none or it was not finished."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/{fingerprint}/stats/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return Index(*(spark.read.parquet(f"{path}/{fingerprint}/{part}") for part in Index._fields))


def stored(docs: DataFrame, path: str, fingerprint: str) -> Index:
    """The index at ``path`` if it has the fingerprint, else one built from (id, text) and written; the statistics come last and tell that it is whole."""
    spark = docs.sparkSession
    ready = load(spark, path, fingerprint)
    if ready is None:
        at = f"{path}/{fingerprint}"
        occurrences(docs).repartition("bucket").sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/occurrences")
        stats = cut(corpus_stats(docs))
        inverse_frequencies(docs, stats).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/terms")
        stats.write.mode("overwrite").parquet(f"{at}/stats")
        ready = load(spark, path, fingerprint)
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for old in fs.listStatus(root):
            if old.getPath().getName() != fingerprint:
                fs.delete(old.getPath(), True)
    return ready


def search(queries: DataFrame, index: Index, n: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): positive BM25 scores, ranked from 0 by score, then id.

    ``queries`` holds (query_id, text); a term counts as often as a query repeats it. Scores are rounded to six places before ranking.
    """
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    terms = asked.select("term").distinct().select(bucket(F.col("term")).alias("__bucket"), F.col("term").alias("__term"))
    found, known = index.occurrences, index.terms
    if terms.count() <= BROADCAST_TERMS:
        wanted = [r[0] for r in terms.select("__bucket").distinct().collect()]  # at most BUCKETS
        found, known = (t.where(F.col("bucket").isin(wanted)) for t in (found, known))
        terms = F.broadcast(terms)
    tf = postings(found.join(terms, F.col("term") == F.col("__term"), "left_semi"))
    weight = asked.join(known.join(terms, F.col("term") == F.col("__term"), "left_semi").select("term", "idf"), "term")
    k1, b = C.BM25_K1, C.BM25_B
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = tf.join(weight, "term").crossJoin(F.broadcast(index.stats)).groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")  # one row
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = scored.withColumn("rank", (F.row_number().over(w) - 1).cast("long"))
    return ranked.where(F.col("rank") < n) if n is not None else ranked
