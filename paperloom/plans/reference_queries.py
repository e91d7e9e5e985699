"""Queries over references, article lookup and citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import references as R
from paperloom.plans.base import CUR, current, sql_clean
from paperloom.plans.registry import core
from paperloom.session import cut
from paperloom.sources.tables import table

query = core.query


REFS = r"""WITH refs AS (SELECT l_orderkey * 10 + l_linenumber AS ref_id, CASE l_orderkey % 6
   WHEN 0 THEN 'Pasal ' || l_linenumber || ' ayat (2) UU Nomor ' || (l_partkey % 60) || ' Tahun ' || (1960 + l_suppkey % 65)
   WHEN 1 THEN 'PERDA No. ' || (l_partkey % 60) || '/' || (1960 + l_suppkey % 65)
   WHEN 2 THEN 'Permenkes 0' || (l_partkey % 60) || ' Tahun ' || (1960 + l_suppkey % 65) || ' Pasal ' || l_linenumber || 'A'
   WHEN 3 THEN 'UUD 1945 Pasal ' || l_linenumber
   WHEN 4 THEN 'Keputusan bersama ' || l_partkey ELSE 'Perpres tentang ' || l_suppkey END AS reference FROM lineitem),
 p0 AS (SELECT ref_id, reference, nullif(regexp_extract(reference, '(?i)\b(UUD|UUDS|UURIS|UU|PP|Perpres|Permen[a-zA-Z]*|Kepmen[a-zA-Z]*|Perda|Inpres|Konstitusi)\b', 1), '') AS type,
   nullif(regexp_extract(reference, '(?i)(?:No\.?\s*|Nomor\s+)?(\d+)\s*(?:Tahun\s+|/|-)\s*(\d{4})', 1), '') AS num, nullif(regexp_extract(reference, '(?i)(?:No\.?\s*|Nomor\s+)?(\d+)\s*(?:Tahun\s+|/|-)\s*(\d{4})', 2), '') AS yr,
   'Pasal ' || nullif(regexp_extract(reference, '(?i)Pasal\s+(\d+[A-Za-z]?)', 1), '') AS pasal FROM refs),
 p1 AS (SELECT *, CASE WHEN lower(type) IN ('uud', 'uuds', 'uuris', 'konstitusi') THEN 'constitution' WHEN lower(type) IN ('uu', 'pp', 'perpres', 'perda') THEN lower(type)
   WHEN lower(type) LIKE 'permen%' THEN 'permen' WHEN lower(type) LIKE 'kepmen%' THEN 'kepmen' WHEN lower(type) = 'inpres' THEN 'lainnya' END AS category FROM p0),
 parsed AS (SELECT ref_id, reference, type, category, num, CASE WHEN category = 'constitution' THEN coalesce(yr, nullif(regexp_extract(reference, '\b(19\d{2}|20\d{2})\b', 1), '')) ELSE yr END AS year, pasal,
   CASE WHEN reference = '' THEN 'empty' WHEN type IS NULL THEN 'type' WHEN category <> 'constitution' AND num IS NULL THEN 'number' END AS error FROM p1)
"""


def refs(spark, d):
    x = table(spark, d, "lineitem")
    o, n, p, s = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey") % 60, F.col("l_suppkey") % 65 + 1960
    j = F.concat
    lit = F.lit
    ref = (F.when(o % 6 == 0, j(lit("Pasal "), n, lit(" ayat (2) UU Nomor "), p, lit(" Tahun "), s)).when(o % 6 == 1, j(lit("PERDA No. "), p, lit("/"), s))
           .when(o % 6 == 2, j(lit("Permenkes 0"), p, lit(" Tahun "), s, lit(" Pasal "), n, lit("A"))).when(o % 6 == 3, j(lit("UUD 1945 Pasal "), n))
           .when(o % 6 == 4, j(lit("Keputusan bersama "), F.col("l_partkey"))).otherwise(j(lit("Perpres tentang "), F.col("l_suppkey"))))
    return x.select((o * 10 + n).alias("ref_id"), ref.alias("reference"))


@query("crossref_parse", REFS + "SELECT * FROM parsed")
def crossref_parse(spark, d):
    return R.parse_reference(refs(spark, d))


SOURCES = """, srcs AS (SELECT DISTINCT source, replace(replace(collection, 'v2_', ''), 'indonesia_', '') AS collection FROM cur WHERE source IS NOT NULL AND collection IS NOT NULL)"""


def sources(spark, d):
    plain = F.replace(F.replace("collection", F.lit("v2_"), F.lit("")), F.lit("indonesia_"), F.lit(""))
    return current(spark, d).where("source IS NOT NULL AND collection IS NOT NULL").select("source", plain.alias("collection")).distinct()


@query("crossref_resolve", REFS + ", cur AS (" + CUR.split("WITH cur AS (", 1)[1].rstrip() + SOURCES + r""", known AS (SELECT source, collection, lower(nullif(regexp_extract(source, '(?i)^([A-Za-z]+)_0*\d+_Tahun_\d{4}', 1), '')) AS lead_,
   regexp_extract(source, '(?i)_0*(\d+)_Tahun_(\d{4})', 1) AS num, regexp_extract(source, '(?i)_0*(\d+)_Tahun_(\d{4})', 2) AS yr FROM srcs WHERE regexp_matches(source, '(?i)_0*(\d+)_Tahun_(\d{4})')),
 h AS (SELECT ref_id, CASE WHEN lead_ = lower(type) THEN 0 ELSE 1 END AS loose, source FROM parsed p JOIN known k ON k.collection = p.category AND k.num = coalesce(nullif(ltrim(p.num, '0'), ''), '0') AND k.yr = p.year WHERE error IS NULL AND category <> 'constitution'
   UNION ALL SELECT ref_id, CASE WHEN contains(source, year) THEN 0 ELSE 1 END, source FROM parsed, srcs WHERE error IS NULL AND category = 'constitution' AND srcs.collection = 'constitution' AND regexp_matches(source, '(?i)UUD') AND (contains(source, year) OR regexp_matches(source, '(?i)^UUD')))
SELECT ref_id, source AS matched_source FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY loose, source) AS k FROM h) WHERE k = 1""")
def crossref_resolve(spark, d):
    return R.resolve(R.parse_reference(refs(spark, d)), sources(spark, d))


@query("source_categories", CUR + """SELECT source, CASE WHEN starts_with(source, 'UUD_') OR starts_with(source, 'UU_7-1950_UUDS') OR starts_with(source, 'UU_11-1949_Konstitusi') THEN 'constitution'
  WHEN starts_with(source, 'UU_') THEN 'uu' WHEN starts_with(source, 'PP_') THEN 'pp' WHEN starts_with(source, 'Perpres_') THEN 'perpres' WHEN starts_with(source, 'Permen') THEN 'permen'
  WHEN starts_with(source, 'Kepmen') THEN 'kepmen' WHEN starts_with(source, 'Perda_') THEN 'perda' WHEN starts_with(source, 'Inpres_') THEN 'lainnya' END AS category, count(*) AS n FROM cur WHERE source IS NOT NULL GROUP BY source""")
def source_categories(spark, d):
    n = current(spark, d).where("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return n.select("source", T.source_category(F.col("source")).alias("category"), "n")


LOOKUP = CUR + f""", req AS (SELECT source AS s, min(article) AS pasal FROM cur WHERE source IS NOT NULL AND article LIKE 'Pasal %' GROUP BY source),
 rows AS (SELECT s AS request_id, pasal, id, page, article, text, row_number() OVER (PARTITION BY s ORDER BY page NULLS FIRST, CAST(split_part(id, '-', 3) AS INTEGER), id) AS k FROM cur JOIN req ON source = s),
 fit AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY k) AS place FROM rows WHERE k <= 200 AND trim(coalesce(article, '')) <> '' AND starts_with(trim(article), pasal))
SELECT request_id, id, coalesce(page, 0) AS page, article, substr({sql_clean('text')}, 1, 800) AS text, place FROM fit WHERE place <= 8"""


@query("article_lookup", LOOKUP)
def article_lookup(spark, d):
    """For every source its first article."""
    rows = current(spark, d, "id", "source", "page", F.split("id", "-")[2].cast("int").alias("idx"), "article", "text")
    req = rows.where("source IS NOT NULL AND article LIKE 'Pasal %'").groupBy("source").agg(F.min("article").alias("pasal")).select(F.col("source").alias("request_id"), "source", "pasal")
    return R.article_lookup(req, rows)


@query("source_lookup", CUR + """SELECT source, id, k FROM (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY page NULLS FIRST, CAST(split_part(id, '-', 3) AS INTEGER), id) AS k FROM cur WHERE source IS NOT NULL) WHERE k <= 200""")
def source_lookup(spark, d):
    """The first 200 chunks of every source."""
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("page", F.split("id", "-")[2].cast("int"), "id")
    return current(spark, d, "source", "page", "id").where("source IS NOT NULL").withColumn("k", F.row_number().over(w).cast("long")).where("k <= 200").select("source", "id", "k")


CITE = r"""SELECT doc_id AS answer_id, unnest(range(len(raw))) AS pos, unnest(raw) AS raw, trim(unnest(pasal)) AS pasal, trim(unnest(source)) AS source, CAST(unnest(page) AS INTEGER) AS page FROM (
  SELECT doc_id, """ + ", ".join(f"regexp_extract_all(text, '{T.CITATION}', {g}) AS {n}" for g, n in enumerate(["raw", "pasal", "source", "page"])) + " FROM documents WHERE text IS NOT NULL)"


def answers(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("answer_id"), F.col("text").alias("answer"))


@query("citation_extract", f"SELECT answer_id, CAST(pos AS INTEGER) AS pos, raw, pasal, source, page FROM ({CITE})")
def citation_extract(spark, d):
    return R.citations(answers(spark, d))


VERIFY = CUR + rf""", cites AS (SELECT *, lower(source) AS src, trim(regexp_replace(pasal, '(?i)\s+ayat.*', '')) AS art FROM ({CITE})),
 ctx AS (SELECT DISTINCT c.answer_id, k.line_no AS p, lower(k.source) AS key, nullif(k.page, 0) AS page, trim(coalesce(k.article, '')) AS art, k.text FROM cites c JOIN cur k ON lower(k.source) = c.src
   UNION SELECT c.answer_id, k.line_no, lower(k.source), nullif(k.page, 0), trim(coalesce(k.article, '')), k.text FROM cites c JOIN cur k ON k.line_no = c.answer_id WHERE k.source IS NOT NULL),
 pick AS (SELECT answer_id, pos, arg_min(key, [CASE WHEN src = key THEN 0 ELSE 1 END, p]) AS found FROM cites JOIN ctx USING (answer_id) WHERE src = key OR contains(key, src) OR contains(src, key) GROUP BY ALL),
 seen AS (SELECT c.answer_id, c.pos, bool_or(x.art = c.art OR starts_with(x.art, c.art)) AS art_ok, coalesce(bool_or(x.page = c.page), false) AS page_ok,
   min(CASE WHEN x.key = c.src AND regexp_matches(lower(x.text), '(^|[^\p{{L}}\p{{N}}_])' || regexp_escape(lower(c.art)) || '($|[^\p{{L}}\p{{N}}_])') THEN x.p END) AS bp
   FROM cites c JOIN pick USING (answer_id, pos) JOIN ctx x ON x.answer_id = c.answer_id AND x.key = pick.found GROUP BY ALL),
 res AS (SELECT c.*, pick.found, art_ok, page_ok, bp, NOT art_ok AND bp IS NOT NULL AS via, (SELECT page FROM cur WHERE line_no = bp) AS bpage FROM cites c LEFT JOIN pick USING (answer_id, pos) LEFT JOIN seen USING (answer_id, pos)),
 st AS (SELECT *, CASE WHEN found IS NULL THEN 'unverified' WHEN (art_ok OR via) AND (page_ok OR (via AND coalesce(nullif(bpage, 0) = page, false))) THEN 'verified' WHEN art_ok OR via THEN 'page_mismatch' ELSE 'article_mismatch' END AS status FROM res),
 verified AS (SELECT answer_id, CAST(pos AS INTEGER) AS pos, raw, pasal, source, page, status, CASE status WHEN 'unverified' THEN 'source_not_in_context' WHEN 'verified' THEN CASE WHEN via THEN 'body_fallback' ELSE 'ok' END ELSE status END AS reason FROM st)
"""


def verified(spark, d):
    """Every document's citations against the chunks of the sources it cites and the chunk of its own number."""
    cites = cut(R.citations(answers(spark, d)))
    rows = current(spark, d, F.col("line_no").alias("pos"), "source", "page", "article", "text").where("source IS NOT NULL")
    exact = cut(R.verify_in_sources(cites, rows))
    rest = cites.join(exact.select("answer_id", "pos"), ["answer_id", "pos"], "left_anti")
    own = rest.select("answer_id").distinct().join(rows, F.col("answer_id") == F.col("pos"))
    return exact.unionByName(R.verify(rest, own))


@query("citation_verify", VERIFY + "SELECT * FROM verified")
def citation_verify(spark, d):
    return verified(spark, d)


@query("citation_totals", VERIFY + "SELECT answer_id, count(*) AS total, count(*) FILTER (WHERE status = 'verified') AS verified, count(*) FILTER (WHERE status <> 'verified') AS unverified FROM verified GROUP BY answer_id")
def citation_totals(spark, d):
    return R.citation_totals(verified(spark, d))


CRIT = """WITH crit AS (SELECT doc_id, ['high', 'medium', 'low', 'unknown'][CAST(doc_id % 4 + 1 AS INTEGER)] AS confidence, ['high', 'medium', 'low', 'unknown'][CAST(doc_id // 4 % 4 + 1 AS INTEGER)] AS second,
   CAST(doc_id % 3 AS INTEGER) AS n, CASE WHEN doc_id % 7 = 0 THEN 'hallucination' ELSE 'missing' END AS kind, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(doc_id % 5 - 1 AS INTEGER) END AS unverified FROM documents)"""


def critiques(spark, d):
    k = F.col("doc_id")
    names = F.array(*[F.lit(x) for x in ("high", "medium", "low", "unknown")])
    issue = F.struct(F.when(k % 7 == 0, "hallucination").otherwise("missing").alias("type"), F.lit("x").alias("description"))
    return table(spark, d, "documents").select(
        "doc_id", F.element_at(names, (k % 4 + 1).cast("int")).alias("confidence"), F.element_at(names, F.expr("CAST((doc_id div 4) % 4 + 1 AS int)")).alias("second"),
        F.array_repeat(issue, (k % 3).cast("int")).alias("issues"), F.when(k % 5 != 0, (k % 5 - 1).cast("int")).alias("unverified"))


@query("retry_decision", CRIT + """, r AS (SELECT doc_id, CASE WHEN unverified >= 2 THEN 'verifier_unverified=' || unverified WHEN confidence = 'low' THEN 'confidence=low' WHEN kind = 'hallucination' AND n > 0 THEN 'serious_issues=' || n
  WHEN confidence = 'medium' AND n >= 2 THEN 'medium+issues=' || n ELSE 'ok' END AS reason FROM crit) SELECT doc_id, reason, reason <> 'ok' AS retry FROM r""")
def retry_decision(spark, d):
    yes, why = R.retry(F.col("confidence"), F.col("issues"), F.col("unverified"))
    return critiques(spark, d).select("doc_id", why.alias("reason"), yes.alias("retry"))


@query("critique_merge", CRIT + """, m AS (SELECT *, {'high': 3, 'medium': 2, 'low': 1, 'unknown': 0}[confidence] AS a, {'high': 3, 'medium': 2, 'low': 1, 'unknown': 0}[second] AS b FROM crit)
SELECT doc_id, confidence = 'low' OR (confidence = 'medium' AND n >= 1) OR coalesce(unverified, 0) >= 1 AS second_opinion, CASE WHEN a = 0 THEN second WHEN b < a THEN second ELSE confidence END AS merged, 2 * n AS issues FROM m""".replace("{'high': 3, 'medium': 2, 'low': 1, 'unknown': 0}[confidence]", "CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END").replace("{'high': 3, 'medium': 2, 'low': 1, 'unknown': 0}[second]", "CASE second WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"))
def critique_merge(spark, d):
    more = F.transform("issues", lambda x: F.struct(x["type"].alias("type"), x["description"].alias("description"), F.lit("adversarial").alias("source")))
    own = F.transform("issues", lambda x: F.struct(x["type"].alias("type"), x["description"].alias("description"), F.lit(None).cast("string").alias("source")))
    return critiques(spark, d).select(
        "doc_id", R.needs_second_opinion(F.col("confidence"), F.size("issues"), F.col("unverified")).alias("second_opinion"),
        R.merged_confidence(F.col("confidence"), F.col("second")).alias("merged"), F.size(F.concat(own, more)).alias("issues"))


@query("retry_message", CRIT + r"""SELECT c.doc_id, 'Question:' || chr(10) || coalesce(source, '') || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(lang, '') || chr(10) || chr(10) || 'Earlier answer:' || chr(10) || coalesce(doc_kind, '')
  || chr(10) || chr(10) || 'Put right:' || chr(10) || '1. citation B: page_mismatch' || chr(10) || '2. citation A: unverified' || array_to_string(list_transform(range(3, n + 3), lambda i: chr(10) || i || '. ' || kind || ': x'), '') AS message
  FROM crit c JOIN documents d ON c.doc_id = d.doc_id""")
def retry_message(spark, d):
    x = critiques(spark, d).join(table(spark, d, "documents").select("doc_id", "source", "lang", "doc_kind"), "doc_id")
    failed = F.array(F.struct(F.lit("A").alias("raw"), F.lit("unverified").alias("status")), F.struct(F.lit("B").alias("raw"), F.lit("page_mismatch").alias("status")))
    c = lambda n: F.coalesce(n, F.lit(""))
    return x.select("doc_id", R.retry_message(c("source"), c("lang"), c("doc_kind"), F.col("issues"), failed).alias("message"))
