"""Queries of the training-text operators and the SQL to check them by."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.llm import boilerplate, leakage, neardup, neighbours, packing, scans, splitting, truncation
from paperloom.operators import dense
from paperloom.plans.registry import Registry
from paperloom.sources.tables import chunks_flat, last_wins, table

REGISTRY = Registry()
query = REGISTRY.query

CURRENT = """
WITH cur AS (SELECT id, text, metadata.category AS category, metadata.article AS article, line_no FROM (
  SELECT *, rank() OVER (PARTITION BY id ORDER BY line_no DESC) AS rn FROM chunks
  WHERE id IS NOT NULL AND line_no IS NOT NULL) WHERE rn = 1)
"""


def current(spark, d, *columns):
    return last_wins(chunks_flat(spark, d), "id", "line_no").select(*columns)


@query("p2_found", CURRENT + r"""
, long AS (SELECT id, text FROM cur WHERE length(text) > 1800),
heads AS (SELECT id, unnest(regexp_extract_all(text,
  '(?im)^[ \t\r\f\v\x{a0}\x{1680}\x{2000}-\x{200d}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]*pasal[ \t\r\f\v\x{a0}\x{1680}\x{2000}-\x{200d}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]+\d+[a-z]?[ \t\r\f\v\x{a0}\x{1680}\x{2000}-\x{200d}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]*(?:\.?[ \t\r\f\v\x{a0}\x{1680}\x{2000}-\x{200d}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]*$|[-\x{2010}-\x{2015}\x{2212}][ \t\r\f\v\x{a0}\x{1680}\x{2000}-\x{200d}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]*\S|\(1\))')) AS h FROM long)
SELECT DISTINCT id, 'Pasal ' || upper(regexp_extract(h, '\d+[A-Za-z]?')) AS article FROM heads
UNION ALL SELECT id, '' FROM long WHERE id NOT IN (SELECT id FROM heads)""")
def p2_found(spark, d):
    long = last_wins(chunks_flat(spark, d).select("line_no", "id", "text", "article"), "id", "line_no")
    return splitting.opened_articles(splitting.split_long(long))


@query("p2_pieces")
def p2_pieces(spark, d):
    return splitting.split_oversized(current(spark, d, "id", "text", "article"))


@query("p2_rebuilt", CURRENT + "SELECT id, sha256(text) AS sha256, true AS within, true AS tiled, true AS lapped FROM cur WHERE text IS NOT NULL")
def p2_rebuilt(spark, d):
    """Every text put together from its pieces."""
    return splitting.rebuilt(p2_pieces(spark, d))


def packed(spark, d):
    return packing.pack(table(spark, d, "documents"), packing.byte_tokens(F.col("text")))


@query("p7_found", "SELECT doc_id FROM documents WHERE strlen(text) + 1 > 4096")
def p7_found(spark, d):
    return packing.split_items(packed(spark, d))


@query("p7_containers")
def p7_containers(spark, d):
    return packed(spark, d)


@query("p7_checked", """SELECT count(*) AS items, CAST(sum((n + 4095) // 4096) AS BIGINT) AS parts, CAST(sum(n) AS BIGINT) AS total, true AS within, true AS whole, true AS filled
  FROM (SELECT strlen(text) + 1 AS n FROM documents WHERE text IS NOT NULL) HAVING count(*) > 0""")
def p7_checked(spark, d):
    """What holds for the containers."""
    return packing.checked(packed(spark, d))


P6_SQL = r"""
, rows AS (SELECT id, split_part(id, '-', 1) AS file, category, text FROM cur WHERE category IS NOT NULL),
split AS (SELECT id, file, category, string_split(text, chr(10)) AS ls FROM rows WHERE text IS NOT NULL),
pos AS (SELECT id, file, category, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS p FROM split),
forms AS (SELECT id, file, category, p, trim(regexp_replace(lower(line), '\P{L}+', ' ', 'g')) AS form FROM pos),
big AS (SELECT category, form, count(DISTINCT id) AS n_rows, count(DISTINCT file) AS n_files FROM forms
  WHERE length(form) >= 25 GROUP BY category, form),
total AS (SELECT category, count(*) AS total FROM rows GROUP BY category),
lines AS (SELECT category, form, n_rows, n_files FROM big JOIN total USING (category) WHERE n_files >= 5 AND n_rows * 100 >= total * 3)
"""


def categorised(spark, d):
    return current(spark, d, "id", "file", F.col("category").alias("source"), "text")


def repeated_lines(rows):
    """The rows come in two parts, each with half of the files: the second is merged and what it changes rebuilt."""
    half = F.pmod(F.xxhash64("file"), F.lit(2))
    return boilerplate.removed_by_parts([rows.where(half == 0), rows.where(half == 1)])


@query("p6_found", CURRENT + P6_SQL + """
SELECT DISTINCT id, CAST(p AS INTEGER) AS line_pos FROM forms JOIN lines USING (category, form)""")
def p6_found(spark, d):
    return repeated_lines(categorised(spark, d))[0]


@query("p6_lines", CURRENT + P6_SQL + """
SELECT category, form, n_rows, n_files FROM lines""")
def p6_lines(spark, d):
    return repeated_lines(categorised(spark, d))[1].select(
        F.col("source").alias("category"), "form", F.col("rows").alias("n_rows"), F.col("files").alias("n_files"))


@query("p6_clean_texts", CURRENT + P6_SQL + """, gone AS (SELECT DISTINCT id, p FROM forms JOIN lines USING (category, form)),
 kept AS (SELECT id, string_agg(line, chr(10) ORDER BY p) AS kept FROM pos ANTI JOIN gone USING (id, p) GROUP BY id)
SELECT id, CASE WHEN id IN (SELECT id FROM gone) THEN coalesce(kept, '') ELSE text END AS text FROM cur LEFT JOIN kept USING (id)""")
def p6_clean_texts(spark, d):
    rows = categorised(spark, d)
    return boilerplate.strip_lines(rows, repeated_lines(rows)[0]).select("id", "text")


P8_GRAMS = r"""(SELECT DISTINCT {0}, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(list_slice(w, i, i + 12), ' '))) AS g
  FROM (SELECT {0}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM {1} WHERE text IS NOT NULL) WHERE len(w) >= 13)"""


@query("p8_found", f"SELECT DISTINCT doc_id, item_id FROM {P8_GRAMS.format('doc_id', 'documents')} JOIN {P8_GRAMS.format('item_id', 'eval_items')} USING (g)")
def p8_found(spark, d):
    """Of the passages within one word edit those without any."""
    return near_leaks(spark, d, 0.95).where("distance = 0").select("doc_id", "item_id").distinct()


def near_leaks(spark, d, recall):
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), max_edits=1, recall=recall)


# Windows within one edit share a form: 13 words with one of them blotted out, 12 words, or 13 words of 14.
P8_WORDS = r"(SELECT {0} AS k, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM {1} WHERE text IS NOT NULL)"
P8_RUNS = "(SELECT k, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: list_slice(w, i, i + {n} - 1))) AS g FROM {t} WHERE len(w) >= {n})"
P8_NEAR = f"""WITH d AS MATERIALIZED {P8_WORDS.format('doc_id', 'documents')}, i AS MATERIALIZED {P8_WORDS.format('item_id', 'eval_items')},
 d12 AS {P8_RUNS.format(n=12, t='d')}, d13 AS {P8_RUNS.format(n=13, t='d')}, d14 AS {P8_RUNS.format(n=14, t='d')}, i13 AS {P8_RUNS.format(n=13, t='i')},
 df AS (SELECT DISTINCT k, hash(g) AS h FROM d12 UNION ALL SELECT DISTINCT k, unnest(list_transform(range(1, 14), lambda p: hash(p, list_slice(g, 1, p - 1), list_slice(g, p + 1, 13)))) FROM d13
   UNION ALL SELECT DISTINCT k, unnest(list_transform(range(1, 15), lambda p: hash('more', list_concat(list_slice(g, 1, p - 1), list_slice(g, p + 1, 14))))) FROM d14),
 itf AS (SELECT DISTINCT k, unnest(list_transform(range(1, 14), lambda p: hash(list_concat(list_slice(g, 1, p - 1), list_slice(g, p + 1, 13))))) AS h FROM i13
   UNION ALL SELECT DISTINCT k, unnest(list_transform(range(1, 14), lambda p: hash(p, list_slice(g, 1, p - 1), list_slice(g, p + 1, 13)))) FROM i13 UNION ALL SELECT DISTINCT k, hash('more', g) FROM i13)
SELECT DISTINCT df.k AS doc_id, itf.k AS item_id FROM df JOIN itf USING (h)"""


@query("p8_near", P8_NEAR)
def p8_near(spark, d):
    """Passages that leaked with up to one word put in, left out or replaced in 13."""
    return near_leaks(spark, d, 0.999).select("doc_id", "item_id").distinct()


@query("p3_found", """
WITH v AS (SELECT row_no, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM chunk_vectors WHERE row_no IS NOT NULL AND len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT row_no, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
c AS (SELECT a.row_no AS a, b.row_no AS b, round(list_dot_product(a.e, b.e), 12) AS cosine FROM u a JOIN u b ON a.row_no <> b.row_no),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS k FROM c)
SELECT DISTINCT least(a, b) AS row_a, greatest(a, b) AS row_b FROM k WHERE k <= 5 AND cosine >= 0.85""")
def p3_found(spark, d):
    near = neighbours.most_similar(table(spark, d, "chunk_vectors"), floor=0.85, recall=0.99)
    return near.select(F.least("row_no", "other").alias("row_a"), F.greatest("row_no", "other").alias("row_b")).distinct()


@query("p3_neighbours")
def p3_neighbours(spark, d):
    """The search form: every row whose number is divisible by 50, against all rows."""
    return neighbours.most_similar(table(spark, d, "chunk_vectors"), queries=F.col("row_no") % 50 == 0).select(
        "row_no", "other", F.round("cosine", 6).alias("cosine"), "rank")


@query("p3_recall", """SELECT count(DISTINCT row_no) AS queries, true AS enough FROM chunk_vectors WHERE row_no % 50 = 0 AND len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 HAVING count(*) > 0""")
def p3_recall(spark, d):
    """Whether the search form finds nine in ten of the exact neighbours: its queries against all rows, in blocks."""
    v = table(spark, d, "chunk_vectors")
    rows = v.where(F.col("row_no").isNotNull() & neighbours.valid(F.col("embedding"), 64)).dropDuplicates(["row_no"]).select(F.col("row_no").alias("id"), "embedding")
    asked = rows.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    exact = dense.nearest(asked, rows, 6).where("id <> query_id")
    w = Window.partitionBy("query_id").orderBy("dist", "id")
    exact = exact.withColumn("k", F.row_number().over(w)).where("k <= 5").select(F.col("query_id").alias("row_no"), F.col("id").alias("other"))
    found = p3_neighbours(spark, d).select("row_no", "other", F.lit(1).alias("hit"))
    share = exact.join(found, ["row_no", "other"], "left").agg(F.countDistinct("row_no").alias("queries"), (F.coalesce(F.sum("hit"), F.lit(0)) >= F.count(F.lit(1)) * 0.9).alias("enough"))
    return share.where("queries > 0")


def similar_chunks(spark, d, every=True):
    return neardup.Similar(current(spark, d, "id", "text"), threshold=0.7, words=3, every=every)


P5_PAIRS = r"""
, w AS (SELECT DISTINCT id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM cur WHERE text IS NOT NULL),
sets AS (SELECT id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: hash(w[i], w[i + 1], w[i + 2]))) AS g FROM w WHERE len(w) >= 3),
grams AS (SELECT id, len(g) AS n, unnest(g) AS g FROM sets),
both_ AS (SELECT a.id AS id_a, b.id AS id_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id GROUP BY ALL)"""


@query("p5_found", CURRENT + P5_PAIRS + "SELECT id_a, id_b FROM both_ WHERE k * 10 >= (na + nb - k) * 7")
def p5_found(spark, d):
    return neardup.id_pairs(similar_chunks(spark, d))


@query("p5_groups", "WITH RECURSIVE" + CURRENT.split("WITH", 1)[1] + P5_PAIRS + """, pairs AS (SELECT id_a, id_b FROM both_ WHERE k * 10 >= (na + nb - k) * 7),
 edges AS (SELECT id_a AS a, id_b AS b FROM pairs UNION ALL SELECT id_b, id_a FROM pairs),
 class AS (SELECT id, len(w) >= 3 AS long, min(id) OVER (PARTITION BY w) AS class_id FROM w),
 reach AS (SELECT id AS a, id AS b FROM w UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
 least_ AS (SELECT a AS id, min(b) AS group_id FROM reach GROUP BY a)
SELECT id, class_id, CASE WHEN long THEN group_id ELSE class_id END AS group_id FROM class JOIN least_ USING (id)""")
def p5_groups(spark, d):
    """Every text's class of copies and its group of near duplicates, without looking for the pairs within what a centre already connects."""
    return neardup.groups(similar_chunks(spark, d, every=False))


@query("p5_links", CURRENT + P5_PAIRS + """, pairs AS (SELECT id_a, id_b FROM both_ WHERE k * 10 >= (na + nb - k) * 7),
 edges AS (SELECT id_a AS a FROM pairs UNION ALL SELECT id_b FROM pairs), n AS (SELECT a AS id, count(*) AS links FROM edges GROUP BY a)
SELECT id, coalesce(links, 0) AS links FROM w LEFT JOIN n USING (id)""")
def p5_links(spark, d):
    """To how many other texts each is similar."""
    return neardup.groups(similar_chunks(spark, d)).select("id", "links")


@query("p9_found")
def p9_found(spark, d):
    return truncation.scores(table(spark, d, "documents")).where("score > 0.5").select("doc_id").distinct()


@query("p9_rates")
def p9_rates(spark, d):
    return truncation.rates(truncation.scores(table(spark, d, "documents")))


def scanned(spark, d):
    page = F.coalesce(F.expr("try_cast(regexp_extract(id, '-p([0-9]+)-', 1) AS int)"), F.col("page"))
    return scans.Repair(current(spark, d, "id", "file", page.alias("page"), "text"))


@query("p4_found")
def p4_found(spark, d):
    return scanned(spark, d).items()


@query("p4_texts")
def p4_texts(spark, d):
    return scanned(spark, d).texts()
