"""Queries that go through files: each writes what the tables hold to the shared folder, and reads it back by the engine's sources."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from paperloom import config as C
from paperloom import models
from paperloom.functions import text as T
from paperloom.operators import extraction, fusion, ingest, tools
from paperloom.plans.base import CUR, VEC, current, sql_clean, sql_strip, vectors
from paperloom.plans.ingest_queries import STATES, manifest, now, old_and_disk
from paperloom.plans.registry import core
from paperloom.plans.text_queries import CLEAN_PAGE, struct_ctes
from paperloom.session import cut
from paperloom.sources import files, store
from paperloom.sources.tables import table
from paperloom.streaming import cycles
from paperloom.streaming.streams import new_folder

query = core.query

# ---- files of pages

PAGED = "replace(text, '. ', '.' || chr(12))"


def item_files(spark, d):
    """The evaluation items (320, fixed) as files below a folder per suite, pages parted by form feeds; some unreadable, some beside what counts."""
    root = new_folder(spark, "items")
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def write(name: str, data: bytes) -> None:
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{root}/{name}"))
        out.write(data)
        out.close()

    for r in table(spark, d, "eval_items").where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "suite", "text").toLocalIterator():
        data = {0: b"%BAD", 10: b"\xff\xfe"}.get(r.item_id % 40, r.text.replace(". ", ".\f").encode())
        write(f"{r.suite}/{'deep/' if r.item_id % 2 else ''}{r.item_id}.pdf", data)
    for name in (".hidden/a.pdf", "__old/b.pdf", "root.pdf", "suite/c.txt"):
        write(name, b"x")
    return root


def strict_parser(data: bytes) -> list[str]:
    if data.startswith(b"%BAD"):
        raise ValueError("no pages")
    return files.plain_text_parser(data)


def lenient_parser(data: bytes) -> list[str]:
    if data.startswith(b"%BAD"):
        raise ValueError("nothing to see")
    return data.decode("utf-8", "replace").split("\f")


@query("discovered_files", f"""SELECT suite AS category, 'indonesia_' || lower(regexp_replace(regexp_replace(CASE WHEN contains(suite, '_') THEN substr(suite, strpos(suite, '_') + 1) ELSE suite END, '[^A-Za-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g')) AS collection, item_id || '.pdf' AS name,
  CAST(CASE item_id % 40 WHEN 0 THEN 4 WHEN 10 THEN 2 ELSE strlen({PAGED}) END AS BIGINT) AS size FROM eval_items WHERE text IS NOT NULL""")
def discovered_files(spark, d):
    found = files.discover(spark, item_files(spark, d))
    return found.select("category", "collection", F.substring_index("path", "/", -1).alias("name"), "size")


@query("extracted_pages", f"""SELECT item_id, CAST(page AS INTEGER) AS page, text, error FROM (
  SELECT item_id, unnest(range(1, len(ps) + 1)) AS page, unnest(ps) AS text, NULL AS error FROM (SELECT item_id, CASE item_id % 40 WHEN 10 THEN [chr(65533) || chr(65533)] ELSE string_split({PAGED}, chr(12)) END AS ps FROM eval_items WHERE text IS NOT NULL AND item_id % 40 <> 0)
  UNION ALL SELECT item_id, NULL, NULL, 'ValueError: no pages; ValueError: nothing to see' FROM eval_items WHERE text IS NOT NULL AND item_id % 40 = 0)""")
def extracted_pages(spark, d):
    """The pages of every file by a strict parser and one to fall back on; files that neither reads give a row with the errors."""
    root = item_files(spark, d)
    pages = files.extract_pages(files.contents(spark, files.discover(spark, root), root), [strict_parser, lenient_parser])
    return pages.select(F.regexp_extract("path", r"(\d+)\.pdf$", 1).cast("long").alias("item_id"), "page", "text", "error")


EXTRACT = f""", p AS (SELECT file, page, {CLEAN_PAGE} AS t, row_number() OVER (PARTITION BY file ORDER BY page, CAST(split_part(id, '-', 3) AS INTEGER)) AS k FROM cur WHERE text IS NOT NULL AND page IS NOT NULL AND {CLEAN_PAGE} <> ''),
 f AS (SELECT *, CASE WHEN NOT (regexp_matches(lag(t) OVER w, '[^.!?…。:;)"”’]$') AND regexp_matches(t, '^[\\p{{Ll}}\\p{{Nd}}]')) OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS brk FROM p WINDOW w AS (PARTITION BY file ORDER BY k)),
 g AS (SELECT *, sum(brk) OVER (PARTITION BY file ORDER BY k) AS island FROM f),
 src AS (SELECT file || '/' || CAST(island AS BIGINT) || '/' || min(page) AS doc_id, string_agg(t, ' ' ORDER BY k) AS text FROM g GROUP BY file, island),
 {struct_ctes('src')},
 c AS (SELECT split_part(doc_id, '/', 1) AS file, CAST(split_part(doc_id, '/', 2) AS BIGINT) AS island, CAST(split_part(doc_id, '/', 3) AS INTEGER) AS page, idx AS part, chunk AS t FROM chunked),
 n AS (SELECT *, list_filter(list_transform(string_split(t, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS ls FROM c),
 q AS (SELECT * FROM n WHERE NOT (length(t) < 80 OR length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / greatest(length(t), 1) < 0.3 OR (len(list_filter(ls, lambda x: regexp_matches(x, '{T.SIGNATURE}'))) / len(ls) > 0.6 AND length(t) < 400))),
 done AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY island, part) - 1 AS idx FROM q)
SELECT file, page, CAST(idx AS INTEGER) AS idx, substr(sha1(file), 1, 10) || '-p' || page || '-' || idx AS id, coalesce(CASE WHEN regexp_matches(t, '(?i)\\bPembukaan\\b') THEN 'Pembukaan' END, nullif(regexp_extract(t, '(?i)\\b(BAB\\s+[IVXLCDM]+)\\b', 1), ''),
    nullif(regexp_extract(t, '(?i)\\b(Pasal\\s+\\d+[A-Za-z]?)\\b', 1), ''), nullif(regexp_extract(t, '(?i)\\b(Bagian\\s+[0-9A-Za-z_]+)\\b', 1), ''), '') AS article, t AS text FROM done"""


@query("structured_extraction", CUR + EXTRACT)
def structured_extraction(spark, d):
    """The current chunks taken as pages, through the whole extraction."""
    return extraction.structured_pages(current(spark, d, "file", "page", "text", F.split("id", "-")[2].cast("int").alias("idx")))


@query("parsed_and_embedded", f"""WITH cur AS (SELECT CAST(item_id AS VARCHAR) AS file, item_id || '-p1-0' AS id, unnest(range(1, len(ps) + 1)) AS page, unnest(ps) AS text FROM (SELECT item_id, string_split({PAGED}, chr(12)) AS ps FROM eval_items WHERE text IS NOT NULL AND item_id % 40 NOT IN (0, 10))),
 parts AS (""" + EXTRACT.replace(", p AS", "WITH p AS", 1) + """) SELECT 'ok' AS kind, count(*) AS chunks, count(DISTINCT file) AS files FROM parts UNION ALL SELECT 'error', count(*), count(*) FROM eval_items WHERE text IS NOT NULL AND item_id % 40 = 0""")
def parsed_and_embedded(spark, d):
    """Files to chunks with vectors of length 1, or an error; chunks and files by outcome."""
    root = item_files(spark, d)
    rows = extraction.parse_and_embed(files.contents(spark, files.discover(spark, root), root), [strict_parser, lenient_parser])
    unit = F.abs(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v) - 1) < 1e-5
    kind = F.when(F.col("error").isNotNull(), "error").when(unit & F.col("id").isNotNull(), "ok")
    per = rows.groupBy("path", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("kind").agg(F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("files"))


# ---- chunk files, stores

@query("jsonl_roundtrip", "SELECT id, text, metadata.source AS source, metadata.page AS page, count(*) AS n FROM chunks WHERE id IS NOT NULL GROUP BY ALL")
def jsonl_roundtrip(spark, d):
    """Chunks written as JSON lines, some blank ones among them, and read back: repeated ids are kept, rows without id are not."""
    at = new_folder(spark, "jsonl")
    c = table(spark, d, "chunks").select(F.to_json(F.struct("id", "text", "metadata")).alias("value"))
    c.unionByName(spark.createDataFrame([("",), ("  ",)], "value string")).write.text(at)
    return files.read_chunks(spark, at).groupBy("id", "text", "source", "page").agg(F.count(F.lit(1)).alias("n"))


@query("jsonl_sink", """SELECT 'chunks' AS part, count(*) AS n FROM chunks WHERE id IS NOT NULL AND text IS NOT NULL UNION ALL SELECT 'failed', count(DISTINCT id) FROM chunks WHERE id IS NOT NULL AND text IS NULL
  UNION ALL SELECT 'chunks.bak', count(*) // 2 * 0 + count(*) FILTER (WHERE line_no % 2 = 0) FROM chunks WHERE id IS NOT NULL AND text IS NOT NULL""")
def jsonl_sink(spark, d):
    """Chunks and failures written apart, twice: the counts of the second run, and what is kept of the first."""
    at = new_folder(spark, "sink")
    c = table(spark, d, "chunks").where("id IS NOT NULL").select("id", "text", "line_no", F.col("id").alias("path"), F.when(F.col("text").isNull(), "no text").alias("error"))
    files.write_chunks(c.where("line_no % 2 = 0"), at)
    files.write_chunks(c, at)
    stats = spark.read.schema("chunks long, failed long").json(f"{at}/stats").select(F.explode(F.create_map(F.lit("chunks"), "chunks", F.lit("failed"), "failed")).alias("part", "n"))
    return stats.unionByName(spark.read.schema("id string").json(f"{at}/chunks.bak").agg(F.lit("chunks.bak").alias("part"), F.count(F.lit(1)).alias("n")))


@query("stored_collections", CUR + """SELECT collection, count(*) AS n, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM cur WHERE collection IN ('v2_indonesia_uu', 'v2_indonesia_perda') OR collection = 'v2_indonesia_permen' GROUP BY collection""")
def stored_collections(spark, d):
    """Chunks stored by collection, one collection emptied and loaded anew, then read by the names a caller gives: other collections aren't touched."""
    at = new_folder(spark, "store")
    rows = current(spark, d, "id", "text", "collection").where("collection IS NOT NULL")
    store.rebuild(rows.withColumn("text", F.when(F.col("collection") != "v2_indonesia_perda", F.col("text"))), f"{at}/chunks")
    store.replace_collections(rows.where("collection = 'v2_indonesia_perda'"), f"{at}/chunks")
    wanted = spark.range(1).select(F.explode(fusion.wanted_collections(F.array(F.lit("V2_indonesia_UU"), F.lit(" 05_Perda"), F.lit("permen")))).alias("c"))
    names = [r[0] for r in wanted.collect()]  # as many as the caller gave
    df = store.Catalog(spark, "files", at).table("chunks", names)
    return df.groupBy("collection").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))


@query("vector_store", "SELECT 'hashed' AS model, count(*) AS rows_, 64 AS dim FROM chunk_vectors WHERE id IS NOT NULL AND len(embedding) = 64")
def vector_store(spark, d):
    v = table(spark, d, "chunk_vectors").where("id IS NOT NULL AND size(embedding) = 64").select("id", "embedding", F.substring("id", 1, 1).alias("collection"))
    return store.save_vectors(v, new_folder(spark, "vectors"), "hashed").withColumnRenamed("rows", "rows_")


@query("manifest_versions", STATES + """SELECT 'saved' AS step, collection, count(*) AS documents FROM now_ WHERE collection IS NOT NULL AND chunk_count > 0 GROUP BY collection
  UNION ALL SELECT 'broken', collection, count(*) FROM now_ WHERE collection IS NOT NULL AND chunk_count > 0 GROUP BY collection
  UNION ALL SELECT 'mended', collection, count(*) FROM old WHERE collection IS NOT NULL AND chunk_count > 0 GROUP BY collection""")
def manifest_versions(spark, d):
    """Counts per collection of the newest manifest: after a version was saved, while the next can't be read, and after that is mended."""
    at = new_folder(spark, "manifests")
    old, _ = old_and_disk(spark, d)
    entry = lambda df: df.withColumn("chunk_ids", F.array().cast("array<string>")).select([f.split()[0] for f in files.MANIFEST.split(", ")])
    files.save_manifest(entry(now(spark, d)), at, 1)
    counts, out = files.DocumentCounts(spark, at), []
    out += [("saved", *x) for x in counts().items()]
    spark.createDataFrame([("{not json",)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/version=2")
    out += [("broken", *x) for x in counts().items()]
    files.save_manifest(entry(old), at, 2)
    out += [("mended", *x) for x in counts().items()]
    return spark.createDataFrame(out, "step string, collection string, documents long")


@query("usage_pages", "SELECT doc_id, n_chars FROM (SELECT item_id AS doc_id, CAST(length(text) AS BIGINT) AS n_chars FROM eval_items WHERE text IS NOT NULL)")
def usage_pages(spark, d):
    """A report of several pages, each naming the next, read as one table."""
    at = new_folder(spark, "usage")
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    rows = [(r.item_id, len(r.text)) for r in table(spark, d, "eval_items").where("text IS NOT NULL").select("item_id", "text").toLocalIterator()]
    parts = [rows[i : i + 40] for i in range(0, len(rows), 40)] or [[]]
    for i, part in enumerate(parts):
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{at}/page-{i or ''}.json"))
        out.write(json.dumps({"data": [{"starting_at": str(k), "results": [{"n": n}]} for k, n in part], "has_more": i + 1 < len(parts), "next_page": str(i + 1)}).encode())
        out.close()
    spark.dataSource.register(files.UsageReport)
    url = at if at.startswith("file:") else f"file:{at}"
    got = spark.read.format("usage_report").option("url", url).load()
    return got.select(F.col("starting_at").cast("long").alias("doc_id"), F.get_json_object("results", "$[0].n").cast("long").alias("n_chars"))


# ---- cycles

def flaky(first: bool):
    """A parser's stand-in that makes some chunks of every file, and fails for some: for fewer when they are tried again."""
    def work(pending):
        bad = (F.col("size") % 13 == 0) & (F.lit(first) | (F.col("size") % 2 == 0))
        n = F.when(bad, F.lit(1)).otherwise((F.col("size") % 5 + 1).cast("int"))
        x = pending.select("path", bad.alias("bad"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
        return x.select("path", F.when(~F.col("bad"), T.chunk_id(F.col("path"), F.lit(1), F.col("i"))).alias("id"), F.when(F.col("bad"), "no pages").alias("error"))

    return work


@query("ingest_cycles", STATES + """, m1 AS (SELECT path, sha256, size, mtime, CASE WHEN size % 13 = 0 THEN 0 ELSE size % 5 + 1 END AS n FROM old),
 j2 AS (SELECT coalesce(d.path, o.path) AS path, d.path IS NOT NULL AS on_disk, o.path IS NOT NULL AS known, coalesce(o.n, 0) = 0 AS failed, d.size AS ds, d.mtime AS dm, d.sha256 AS dh, o.size AS os, o.mtime AS om, o.sha256 AS oh, o.n FROM disk d FULL JOIN m1 o ON d.path = o.path),
 c2 AS (SELECT *, CASE WHEN NOT known THEN 'added' WHEN NOT on_disk THEN 'deleted' WHEN failed AND ds > 62914560 THEN 'skipped' WHEN ds = os AND abs(dm - om) < 1 AND NOT failed THEN 'unchanged' WHEN dh IS NULL THEN 'unreadable' WHEN dh = oh AND NOT failed THEN 'touched' WHEN failed THEN 'retried' ELSE 'modified' END AS status FROM j2),
 fin AS (SELECT path, status, CASE WHEN status IN ('added', 'modified', 'retried') THEN CASE WHEN ds % 13 = 0 AND ds % 2 = 0 THEN 0 ELSE ds % 5 + 1 END ELSE n END AS n FROM c2 WHERE status <> 'deleted')
SELECT path, CAST(n AS BIGINT) AS chunks, CAST(CASE WHEN status IN ('added', 'modified', 'retried') THEN 2 ELSE 1 END AS INTEGER) AS made, CAST(CASE WHEN status = 'retried' THEN 2 ELSE 1 END AS INTEGER) AS tries, CASE WHEN n = 0 THEN 'no pages' END AS error FROM fin""")
def ingest_cycles(spark, d):
    """Two cycles over the disk as it was and as it is: chunks that count for each file, the cycle and number of its last try, its error."""
    state = new_folder(spark, "cycles")
    old, disk = old_and_disk(spark, d)
    cycles.run(spark, state, lambda: old, flaky(True), once=True)
    cycles.run(spark, state, lambda: disk, flaky(False), once=True)
    n = cycles.chunks(spark, state).groupBy("path").agg(F.count(F.lit(1)).alias("chunks"))
    m = cycles.manifest(spark, state).select("path", "made", "tries").join(n, "path", "left").join(cycles.failures(spark, state).select("path", "error"), "path", "left")
    return m.select("path", F.coalesce("chunks", F.lit(0)).alias("chunks"), "made", "tries", "error")


# ---- tools and critiques

CALLS = """, calls AS (SELECT item_id AS call_id, CAST(item_id % 6 AS INTEGER) AS k, ['uu', 'PERDA ', 'permen', 'heonbeob'][CAST(item_id // 6 % 4 + 1 AS INTEGER)] AS category, CAST(item_id % 12 AS INTEGER) AS top_k, item_id - 7000 AS row_no FROM eval_items),
 target AS (SELECT *, 'v2_indonesia_' || CASE lower(trim(category)) WHEN 'heonbeob' THEN 'constitution' ELSE lower(trim(category)) END AS collection FROM calls WHERE k = 0),
 picked_source AS (SELECT min(source) AS source, (SELECT min(article) FROM cur c WHERE c.source = min(s.source) AND article LIKE 'Pasal %') AS pasal FROM cur s WHERE source IS NOT NULL)"""


def calls(spark, d):
    """Calls of every kind, right and wrong, from the evaluation items."""
    k, lit = F.col("item_id") % 6, F.lit
    category = F.element_at(F.array(*[lit(x) for x in ("uu", "PERDA ", "permen", "heonbeob")]), (F.expr("item_id div 6") % 4 + 1).cast("int"))
    rows = current(spark, d, "source", "article").where("source IS NOT NULL")
    first = rows.agg(F.min("source").alias("s"))
    first = F.broadcast(first.join(rows, F.col("s") == F.col("source")).groupBy("s").agg(F.min(F.when(F.col("article").startswith("Pasal "), F.col("article"))).alias("p")))  # one row
    i = table(spark, d, "eval_items").crossJoin(first)
    args = (F.when(k == 0, F.to_json(F.struct(category.alias("category"), lit("x").alias("query"), (F.col("item_id") % 12).cast("int").alias("top_k"))))
            .when(k == 1, F.to_json(F.struct(F.col("s").alias("source_file"), F.col("p").alias("pasal")))).when(k == 2, F.to_json(F.struct(lit("Undang").alias("reference"))))
            .when(k == 3, lit("{}")).when(k == 4, lit('{"category": "qanun", "query": "x"}')).otherwise(lit('{"category": "uu"')))
    name = F.when(k.isin(0, 4, 5), "search_collection").when(k == 1, "fetch_article_chunks").when(k == 2, "fetch_cross_reference").otherwise("delete_everything")
    c = i.select(F.col("item_id").alias("call_id"), name.alias("name"), args.alias("args"))
    v = vectors(spark, d).select("row_no", "embedding")
    return c.join(v, F.col("call_id") - 7000 == F.col("row_no"), "left").drop("row_no")


@query("tool_calls", CUR + VEC + CALLS + f""", tv AS (SELECT call_id, collection, greatest(1, least(top_k, 8)) AS top_k, e AS q FROM target JOIN unit USING (row_no)),
 td AS (SELECT call_id, top_k, unit.id, round(1 - list_dot_product(q, e), 6) + 0.0::DOUBLE AS dist FROM tv JOIN cur USING (collection) JOIN unit ON unit.id = cur.id),
 tr AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY dist, id) AS place FROM td),
 rows AS (SELECT call_id, pasal, id, article, row_number() OVER (PARTITION BY call_id ORDER BY page NULLS FIRST, CAST(split_part(id, '-', 3) AS INTEGER), id) AS k2 FROM calls, picked_source p JOIN cur ON cur.source = p.source WHERE k = 1),
 fit AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY k2) AS place FROM rows WHERE k2 <= 200 AND (pasal IS NULL OR trim(coalesce(article, '')) <> '' AND starts_with(trim(article), pasal))),
 res AS (SELECT call_id, NULL AS error, place, id, round(1 - dist, 3) AS score FROM tr WHERE place <= top_k UNION ALL SELECT call_id, NULL, place, id, NULL FROM fit WHERE place <= 8
   UNION ALL SELECT call_id, CASE k WHEN 2 THEN 'type' WHEN 3 THEN 'unknown tool' WHEN 4 THEN 'unknown category' ELSE 'arguments' END, NULL, NULL, NULL FROM calls WHERE k > 1
   UNION ALL SELECT call_id, 'arguments', NULL, NULL, NULL FROM target WHERE call_id NOT IN (SELECT call_id FROM tv))
SELECT call_id, error, place, res.id, source, CASE WHEN error IS NULL THEN coalesce(page, 0) END AS page, article, score, CASE WHEN error IS NULL THEN substr({sql_clean('text')}, 1, 800) END AS text FROM res LEFT JOIN cur ON cur.id = res.id""")
def tool_calls(spark, d):
    chunks = current(spark, d, "id", "source", "page", F.split("id", "-")[2].cast("int").alias("idx"), "article", "text", "collection")
    return tools.dispatch(cut(calls(spark, d)), chunks, vectors(spark, d))


@query("tool_categories", CUR + "SELECT key, 'v2_indonesia_' || key AS collection, (SELECT count(*) FROM cur WHERE cur.collection = 'v2_indonesia_' || key) AS chunks FROM (SELECT unnest(['constitution', 'uu', 'pp', 'perpres', 'permen', 'kepmen', 'perda', 'lainnya']) AS key)")
def tool_categories(spark, d):
    return tools.list_categories(current(spark, d, "collection"))


def reviewing(prompt: str) -> str:
    """A stand-in for a reviewing model: its verdict goes by the answer's length; sometimes no JSON, sometimes it fails."""
    n = len(prompt.split("Answer:\n", 1)[1])
    if n % 5 == 0:
        raise TimeoutError
    if n % 5 == 1:
        return "I see nothing wrong."
    issues = [{"type": "missing", "description": "x"}] * (n % 3)
    return "Verdict: " + json.dumps({"confidence": ["high", "medium", "low"][n % 3], "verified_citations_count": n % 4, "issues": issues, "summary": "s"}) + " end"


@query("critiques", r"""WITH a AS (SELECT doc_id, least(length(text), 8000) AS n, regexp_replace(coalesce(text, ''), '\s', '', 'g') = '' AS blank FROM documents)
SELECT doc_id, CASE WHEN blank OR n % 5 < 2 THEN 'unknown' ELSE ['high', 'medium', 'low'][CAST(n % 3 + 1 AS INTEGER)] END AS confidence, CAST(CASE WHEN blank OR n % 5 < 2 THEN 0 ELSE n % 4 END AS INTEGER) AS verified, CAST(CASE WHEN blank OR n % 5 < 2 THEN 0 ELSE n % 3 END AS INTEGER) AS issues,
  CASE WHEN blank THEN 'not run' WHEN n % 5 = 0 THEN 'call failed' WHEN n % 5 = 1 THEN 'no JSON' ELSE 's' END AS summary FROM a""")
def critiques(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.lit("q").alias("question"), F.lit("c").alias("context"), F.col("text").alias("answer"))
    c = models.critique(x, reviewing)
    return c.select("doc_id", "confidence", F.col("verified_citations_count").alias("verified"), F.size("issues").alias("issues"), "summary")
