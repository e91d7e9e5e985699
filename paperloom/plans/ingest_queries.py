"""Queries over the manifest, the chunk tables and what an ingest cycle does to them.

The earlier state is the manifest as it was halfway through its time span; the disk is its current state, without the files that
can't be read any more.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom import config as C
from paperloom.operators import ingest, keyed
from paperloom.plans.base import CUR, current
from paperloom.plans.registry import core
from paperloom.sources.tables import last_wins, table

query = core.query

ENTRY = """row_number() OVER (PARTITION BY path ORDER BY try_cast(indexed_at AS TIMESTAMP) DESC NULLS LAST, sha256 DESC NULLS LAST, chunk_count DESC NULLS LAST, collection DESC NULLS LAST)"""
NOW = f"""WITH now_ AS (SELECT path, category, collection, sha256, size, mtime, chunk_count, indexed_at FROM (SELECT *, {ENTRY} AS rn FROM manifest WHERE path IS NOT NULL) WHERE rn = 1)"""
STATES = NOW + f""", span AS (SELECT (min(epoch(t)) + max(epoch(t))) / 2 AS mid FROM (SELECT try_cast(indexed_at AS TIMESTAMP) AS t FROM manifest)),
 old AS (SELECT path, category, collection, sha256, size, mtime, chunk_count, indexed_at FROM (SELECT *, {ENTRY} AS rn FROM manifest, span WHERE path IS NOT NULL AND epoch(try_cast(indexed_at AS TIMESTAMP)) < mid) WHERE rn = 1),
 disk AS (SELECT * FROM now_ WHERE path NOT IN (SELECT path FROM failed_files WHERE path IS NOT NULL)),
 j AS (SELECT coalesce(d.path, o.path) AS path, coalesce(d.size, o.size) AS size, d.path IS NOT NULL AS on_disk, o.path IS NOT NULL AS known, coalesce(o.chunk_count, 0) = 0 AS failed,
   d.size AS ds, d.mtime AS dm, d.sha256 AS dh, o.size AS os, o.mtime AS om, o.sha256 AS oh FROM disk d FULL JOIN old o ON d.path = o.path),
 ch AS (SELECT path, size, CASE WHEN NOT known THEN 'added' WHEN NOT on_disk THEN 'deleted' WHEN failed AND ds > 62914560 THEN 'skipped' WHEN ds = os AND abs(dm - om) < 1 AND NOT failed THEN 'unchanged'
   WHEN dh IS NULL THEN 'unreadable' WHEN dh = oh AND NOT failed THEN 'touched' WHEN failed THEN 'retried' ELSE 'modified' END AS status FROM j)
"""


def manifest(spark, d):
    return table(spark, d, "manifest")


def now(spark, d):
    return keyed.current_entries(manifest(spark, d))


def old_and_disk(spark, d):
    m = manifest(spark, d)
    at = keyed.instant(F.col("indexed_at")).cast("double")
    mid = m.agg(((F.min(at) + F.max(at)) / 2).alias("mid"))  # one row
    old = keyed.current_entries(m.crossJoin(F.broadcast(mid)).where(at < F.col("mid")).drop("mid"))
    gone = table(spark, d, "failed_files").where("path IS NOT NULL").select("path").distinct()
    return old, now(spark, d).join(gone, "path", "left_anti")


def changes(spark, d):
    old, disk = old_and_disk(spark, d)
    return ingest.detect_changes(disk, old)


@query("manifest_rows", """SELECT path, category, collection, chunk_count, strftime(try_cast(indexed_at AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS at FROM manifest WHERE path IS NOT NULL AND sha256 IS NOT NULL AND chunk_count IS NOT NULL AND collection IS NOT NULL""")
def manifest_rows(spark, d):
    """Entries that have all their fields; others are dropped on reading."""
    return manifest(spark, d).where("path IS NOT NULL AND sha256 IS NOT NULL AND chunk_count IS NOT NULL AND collection IS NOT NULL").select(
        "path", "category", "collection", "chunk_count", F.date_format(keyed.instant(F.col("indexed_at")), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("detect_changes", STATES + "SELECT path, status, size FROM ch")
def detect_changes(spark, d):
    return changes(spark, d)


@query("change_counts", STATES + "SELECT status, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM ch GROUP BY status")
def change_counts(spark, d):
    return changes(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query("ingest_order", STATES + "SELECT path, row_number() OVER (ORDER BY CASE WHEN status = 'added' THEN 0 ELSE 1 END, size, path) AS place FROM ch WHERE status IN ('added', 'modified', 'retried')")
def ingest_order(spark, d):
    return ingest.work_order(changes(spark, d))


@query("first_pending", STATES + "SELECT path, size FROM ch WHERE status IN ('added', 'modified', 'retried') ORDER BY CASE WHEN status = 'added' THEN 0 ELSE 1 END, size, path LIMIT 25")
def first_pending(spark, d):
    """A sample of a set size: the first pending files in working order."""
    return ingest.first_files(changes(spark, d), 25)


@query("ingest_batches", STATES + ", o AS (SELECT path, row_number() OVER (ORDER BY CASE WHEN status = 'added' THEN 0 ELSE 1 END, size, path) AS place FROM ch WHERE status IN ('added', 'modified', 'retried')) SELECT CAST((place - 1) // 200 AS BIGINT) AS batch, count(*) AS files, min(path) AS first_path FROM o GROUP BY 1")
def ingest_batches(spark, d):
    """Pending files in batches of 200 in working order."""
    o = ingest.work_order(changes(spark, d))
    return o.groupBy(F.expr("(place - 1) div 200").alias("batch")).agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first_path"))


@query("manifest_upsert", STATES + """SELECT path, sha256, size, coalesce(chunk_count, 0) AS chunk_count FROM old WHERE path NOT IN (SELECT path FROM ch WHERE status IN ('deleted', 'added', 'modified', 'retried', 'touched'))
  UNION ALL SELECT d.path, d.sha256, d.size, coalesce(d.chunk_count, 0) FROM disk d JOIN ch ON d.path = ch.path WHERE status IN ('added', 'modified', 'retried', 'touched')""")
def manifest_upsert(spark, d):
    old, disk = old_and_disk(spark, d)
    return ingest.apply_changes(old, disk, ingest.detect_changes(disk, old)).select("path", "sha256", "size", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


GONE = STATES + ", gone AS (SELECT DISTINCT substr(sha1(path), 1, 10) AS file FROM ch WHERE status = 'deleted')"


@query("delete_propagation", GONE + """, cur AS (SELECT id FROM chunks WHERE id IS NOT NULL GROUP BY id) SELECT split_part(id, '-', 1) AS file, count(*) AS chunks FROM cur WHERE split_part(id, '-', 1) NOT IN (SELECT file FROM gone) GROUP BY 1""")
def delete_propagation(spark, d):
    """Chunks per file once those of deleted files are gone; the file key is the hash of its path."""
    gone = changes(spark, d).where("status = 'deleted'").select(F.substring(F.sha1("path"), 1, 10).alias("file"))
    return ingest.delete(current(spark, d, "id", "file").distinct(), gone, ["file"]).groupBy("file").agg(F.count(F.lit(1)).alias("chunks"))


@query("replace_chunks", STATES + """, before AS (SELECT DISTINCT o.path, unnest(m.chunk_ids) AS id FROM manifest m JOIN old o ON o.path = m.path AND o.sha256 = m.sha256),
 after_ AS (SELECT DISTINCT d.path, unnest(m.chunk_ids) AS id, d.sha256 AS made FROM manifest m JOIN disk d ON d.path = m.path AND d.sha256 = m.sha256 JOIN ch ON ch.path = d.path WHERE status IN ('added', 'modified', 'retried')),
 kept AS (SELECT path, id, 'old' AS made FROM before WHERE path NOT IN (SELECT path FROM ch WHERE status IN ('deleted', 'modified', 'retried', 'added')))
SELECT path, count(*) AS chunks, count(*) FILTER (WHERE made <> 'old') AS fresh, min(id) AS first_id, max(made) AS made FROM (SELECT * FROM kept UNION ALL SELECT path, id, made FROM after_) GROUP BY path""")
def replace_chunks(spark, d):
    """The chunks after a cycle: those of changed and deleted files are gone, those of the new versions there."""
    old, disk = old_and_disk(spark, d)
    ch = ingest.detect_changes(disk, old)
    ids = manifest(spark, d).select("path", "sha256", "chunk_ids")
    chunks = lambda entries: ids.join(entries.select("path", "sha256").distinct(), ["path", "sha256"]).select("path", F.explode("chunk_ids").alias("id"), "sha256").distinct()
    pending = ch.where(F.col("status").isin(*ingest.PENDING)).select("path")
    fresh = chunks(disk.join(pending, "path", "left_semi")).withColumnRenamed("sha256", "made")
    gone = ch.where(F.col("status").isin("deleted", *ingest.PENDING))
    after = ingest.replace(chunks(old).withColumn("made", F.lit("old")).drop("sha256").distinct(), fresh, gone, "path")
    return after.groupBy("path").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("made") != "old").alias("fresh"), F.min("id").alias("first_id"), F.max("made").alias("made"))


@query("doc_counts", NOW + "SELECT collection, count(*) AS documents FROM now_ WHERE collection IS NOT NULL AND coalesce(chunk_count, 0) > 0 GROUP BY collection")
def doc_counts(spark, d):
    return ingest.documents_per_collection(now(spark, d))


@query("versioned_counts", NOW + "SELECT 'v2_' || collection AS collection, count(*) AS documents FROM now_ WHERE collection IS NOT NULL AND coalesce(chunk_count, 0) > 0 GROUP BY collection")
def versioned_counts(spark, d):
    return ingest.documents_per_collection(now(spark, d)).withColumn("collection", F.concat(F.lit(C.VERSION_PREFIX), "collection"))


@query("chunk_counts", CUR + "SELECT coalesce(collection, 'TOTAL') AS collection, count(*) AS chunks, count(DISTINCT file) AS files FROM cur WHERE collection IS NOT NULL GROUP BY ROLLUP (collection)")
def chunk_counts(spark, d):
    """Distinct files are reduced to one row per (collection, file) before they are counted."""
    per = current(spark, d).where("collection IS NOT NULL").groupBy("collection", "file").agg(F.count(F.lit(1)).alias("n"))
    by = per.groupBy("collection").agg(F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("files"))
    total = per.groupBy("file").agg(F.sum("n").alias("n")).agg(F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("files"))
    return by.unionByName(total.select(F.lit("TOTAL").alias("collection"), "chunks", "files"))


@query("list_collections", CUR + "SELECT DISTINCT collection FROM cur WHERE starts_with(collection, 'v2_indonesia_')")
def list_collections(spark, d):
    return current(spark, d, "collection").where(F.col("collection").startswith("v2_indonesia_")).distinct()


@query("collection_sources", CUR + "SELECT collection, source, count(*) AS chunks FROM cur WHERE collection IS NOT NULL AND source IS NOT NULL AND source <> '' GROUP BY ALL")
def collection_sources(spark, d):
    return current(spark, d, "collection", "source").where("collection IS NOT NULL AND source IS NOT NULL AND source <> ''").groupBy("collection", "source").agg(F.count(F.lit(1)).alias("chunks"))


@query("collection_dump", CUR + "SELECT id, collection, source, coalesce(page, 0) AS page, coalesce(article, '') AS article, length(coalesce(text, '')) AS chars FROM cur WHERE collection IS NOT NULL")
def collection_dump(spark, d):
    z = F.lit("")
    return current(spark, d).where("collection IS NOT NULL").select("id", "collection", "source", F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("article", z).alias("article"), F.length(F.coalesce("text", z)).cast("long").alias("chars"))


@query("last_wins_dedup", CUR + "SELECT id, line_no, source, article FROM cur")
def last_wins_dedup(spark, d):
    return current(spark, d, "id", "line_no", "source", "article")


@query("jsonl_ids", "SELECT id, count(*) AS n, max(line_no) AS last_line FROM chunks WHERE id IS NOT NULL AND trim(coalesce(text, '')) <> '' GROUP BY id")
def jsonl_ids(spark, d):
    """The id list of a load, repeats kept, blank texts skipped."""
    return table(spark, d, "chunks").where("id IS NOT NULL AND trim(coalesce(text, '')) <> ''").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("line_no").alias("last_line"))


VEC0 = ", v AS (SELECT row_no, id FROM chunk_vectors WHERE id IS NOT NULL)"


@query("emb_meta_join", CUR + VEC0 + "SELECT row_no, id, coalesce(collection, '') AS collection, coalesce(source, '') AS source FROM v JOIN cur USING (id)")
def emb_meta_join(spark, d):
    meta = current(spark, d, "id", F.coalesce("collection", F.lit("")).alias("collection"), F.coalesce("source", F.lit("")).alias("source"))
    return ingest.join_vectors(table(spark, d, "chunk_vectors").select("row_no", "id"), meta).select("row_no", "id", "collection", "source")


@query("emb_missing_meta", CUR + VEC0 + "SELECT row_no, id FROM v WHERE id NOT IN (SELECT id FROM cur)")
def emb_missing_meta(spark, d):
    v = table(spark, d, "chunk_vectors").where("id IS NOT NULL").select("row_no", "id")
    return ingest.missing_meta(v, current(spark, d, "id")).select("row_no", "id")


@query("matrix_check", """SELECT count(*) AS rows_, count(id) AS ids, count(DISTINCT id) AS distinct_ids, count(*) FILTER (WHERE embedding IS NULL) AS no_vector, count(*) FILTER (WHERE len(embedding) <> 64) AS wrong_length,
  count(*) = count(id) AS aligned FROM chunk_vectors""")
def matrix_check(spark, d):
    """Whether ids and vectors go together row by row."""
    v = table(spark, d, "chunk_vectors").select("id", F.size("embedding").alias("n"), F.col("embedding").isNull().alias("none"))
    one = v.agg(F.count(F.lit(1)).alias("rows_"), F.count("id").alias("ids"), F.count_if("none").alias("no_vector"), F.count_if((F.col("n") != 64) & ~F.col("none")).alias("wrong_length"))
    n = v.where("id IS NOT NULL").groupBy("id").agg(F.lit(1).alias("x")).agg(F.count(F.lit(1)).alias("distinct_ids"))
    return one.crossJoin(n).select("*", (F.col("rows_") == F.col("ids")).alias("aligned"))  # one row each


@query("vector_upsert", CUR + """, half AS (SELECT max(row_no) // 2 AS h FROM chunk_vectors), v AS (SELECT id, row_no, row_no > h AS new FROM chunk_vectors, half WHERE id IS NOT NULL AND embedding IS NOT NULL),
 n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_no DESC) AS rn FROM v WHERE new) WHERE rn = 1), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_no DESC) AS rn FROM v WHERE NOT new) WHERE rn = 1),
 u AS (SELECT * FROM o WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n)
SELECT collection, count(*) AS n, max(row_no) AS last_row, count(*) FILTER (WHERE new) AS fresh, CAST(sum(CASE WHEN new AND id IN (SELECT id FROM o) THEN 1 ELSE 0 END) AS BIGINT) AS replaced, CAST(ceil(count(*) / 5000.0) AS BIGINT) AS calls
  FROM u JOIN cur USING (id) WHERE collection IS NOT NULL GROUP BY collection""")
def vector_upsert(spark, d):
    """The vector table per collection after the later half of the rows was put into the earlier half: one row per id; in calls of 5,000."""
    v = table(spark, d, "chunk_vectors").where("id IS NOT NULL AND embedding IS NOT NULL").select("id", "row_no")
    half = F.broadcast(table(spark, d, "chunk_vectors").agg(F.expr("max(row_no) div 2").alias("half")))  # one row
    v = v.crossJoin(half).select("id", "row_no", (F.col("row_no") > F.col("half")).alias("new"))
    old, new = (last_wins(x, "id", "row_no") for x in (v.where("NOT new"), v.where("new")))
    before = old.select("id", F.lit(True).alias("before"))
    after = ingest.upsert(old, new, ["id"]).join(before, "id", "left").join(current(spark, d, "id", "collection").where("collection IS NOT NULL"), "id")
    replaced = F.sum(F.when(F.col("new") & F.col("before"), 1).otherwise(0))
    return after.groupBy("collection").agg(F.count(F.lit(1)).alias("n"), F.max("row_no").alias("last_row"), F.count_if("new").alias("fresh"), replaced.alias("replaced"), F.ceil(F.count(F.lit(1)) / 5000).alias("calls"))


@query("status_report", NOW + """SELECT coalesce(category, 'TOTAL') AS category, count(*) AS total, count(*) FILTER (WHERE coalesce(chunk_count, 0) > 0) AS ok, count(*) FILTER (WHERE coalesce(chunk_count, 0) = 0) AS failed,
  CAST(sum(coalesce(chunk_count, 0)) AS BIGINT) AS chunks FROM now_ WHERE category IS NOT NULL GROUP BY ROLLUP (category)""")
def status_report(spark, d):
    return ingest.status_report(now(spark, d))


@query("disk_vs_manifest", STATES + """, a AS (SELECT category, count(*) AS on_disk FROM disk WHERE category IS NOT NULL GROUP BY 1), b AS (SELECT category, count(*) AS in_manifest FROM old WHERE category IS NOT NULL GROUP BY 1)
SELECT coalesce(a.category, b.category) AS category, coalesce(on_disk, 0) AS on_disk, coalesce(in_manifest, 0) AS in_manifest, coalesce(on_disk, 0) - coalesce(in_manifest, 0) AS missing FROM a FULL JOIN b ON a.category = b.category""")
def disk_vs_manifest(spark, d):
    old, disk = old_and_disk(spark, d)
    a = disk.where("category IS NOT NULL").groupBy("category").agg(F.count(F.lit(1)).alias("on_disk"))
    b = old.where("category IS NOT NULL").groupBy("category").agg(F.count(F.lit(1)).alias("in_manifest"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return a.join(b, "category", "full").select("category", z("on_disk").alias("on_disk"), z("in_manifest").alias("in_manifest"), (z("on_disk") - z("in_manifest")).alias("missing"))


@query("ghost_rows", STATES + "SELECT path, chunk_count FROM now_ WHERE path NOT IN (SELECT path FROM disk)")
def ghost_rows(spark, d):
    """Entries of the current manifest that aren't on disk."""
    _, disk = old_and_disk(spark, d)
    return now(spark, d).select("path", "chunk_count").join(disk.select("path"), "path", "left_anti")


@query("category_names", NOW + "SELECT category FROM now_ WHERE category IS NOT NULL UNION SELECT metadata.category FROM chunks WHERE metadata.category IS NOT NULL")
def category_names(spark, d):
    a = now(spark, d).select("category").distinct()
    return a.union(table(spark, d, "chunks").select("metadata.category").distinct()).where("category IS NOT NULL").distinct()


FAIL = NOW + """, f AS (SELECT DISTINCT path, error FROM failed_files WHERE path IS NOT NULL),
 c AS (SELECT f.path, f.error, category, size, CASE WHEN size IS NULL THEN 'missing' WHEN size > 62914560 THEN 'oversize' WHEN starts_with(error, 'stat:') THEN 'unreadable' WHEN contains(lower(error), 'timeout') THEN 'timeout' ELSE 'parse' END AS class FROM f LEFT JOIN now_ USING (path))
"""


def failures(spark, d):
    f = table(spark, d, "failed_files").where("path IS NOT NULL").distinct()
    j = f.join(now(spark, d).select("path", "category", "size"), "path", "left")
    return j.withColumn("class", ingest.failure_class(F.col("error"), F.col("size")))


@query("failure_classes", FAIL + "SELECT class, coalesce(category, '') AS category, count(*) AS n FROM c GROUP BY ALL")
def failure_classes(spark, d):
    return failures(spark, d).groupBy("class", F.coalesce("category", F.lit("")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("largest_failed", FAIL + "SELECT path, max(size) AS size FROM c WHERE size IS NOT NULL GROUP BY path ORDER BY 2 DESC, 1 LIMIT 10")
def largest_failed(spark, d):
    return failures(spark, d).where("size IS NOT NULL").groupBy("path").agg(F.max("size").alias("size")).orderBy(F.desc("size"), "path").limit(10)


@query("oversize_files", NOW + "SELECT path, size FROM now_ WHERE size > 62914560")
def oversize_files(spark, d):
    return now(spark, d).where(F.col("size") > C.MAX_FILE_BYTES).select("path", "size")


@query("failed_entries", NOW + "SELECT path FROM now_ WHERE coalesce(chunk_count, 0) = 0")
def failed_entries(spark, d):
    return now(spark, d).where("coalesce(chunk_count, 0) = 0").select("path")


@query("count_mismatches", "SELECT path, sha256, count(*) AS n FROM manifest WHERE path IS NOT NULL AND chunk_count IS NOT NULL AND chunk_count <> len(chunk_ids) GROUP BY ALL")
def count_mismatches(spark, d):
    return manifest(spark, d).where("path IS NOT NULL AND chunk_count IS NOT NULL").where(F.col("chunk_count") != F.size("chunk_ids")).groupBy("path", "sha256").agg(F.count(F.lit(1)).alias("n"))


@query("extraction_stats", CUR + """SELECT coalesce(category, '') AS category, count(DISTINCT file || '-' || coalesce(page, 0)) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS chunks, CAST(floor(avg(length(text))) AS BIGINT) AS avg_chars,
  count(*) FILTER (WHERE coalesce(article, '') <> '') AS with_article FROM cur WHERE text IS NOT NULL GROUP BY 1""")
def extraction_stats(spark, d):
    c = current(spark, d, F.coalesce("category", F.lit("")).alias("category"), "file", F.coalesce("page", F.lit(0)).alias("page"), F.length("text").alias("n"), (F.coalesce("article", F.lit("")) != "").alias("a")).where("n IS NOT NULL")
    per = c.groupBy("category", "file", "page").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.count_if("a").alias("a"))
    return per.groupBy("category").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("chars"), F.sum("k").alias("chunks"), F.floor(F.sum("n") / F.sum("k")).alias("avg_chars"), F.sum("a").alias("with_article"))


@query("running_index", CUR + """SELECT id, CAST(row_number() OVER (PARTITION BY file ORDER BY coalesce(page, 0), CAST(split_part(id, '-', 3) AS INTEGER), id) - 1 AS INTEGER) AS idx FROM cur""")
def running_index(spark, d):
    """Chunks numbered through each file."""
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy(F.coalesce("page", F.lit(0)), F.split("id", "-")[2].cast("int"), "id")
    return current(spark, d).select("id", (F.row_number().over(w) - 1).alias("idx"))
