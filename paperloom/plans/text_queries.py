"""Queries over text functions (cleaning, labels, ids, markup, durations)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from paperloom import config as C
from paperloom.functions import text as T
from paperloom.operators import chunking
from paperloom.plans.base import COMPOSED, CUR, current, sql_clean, sql_strip, sql_visible
from paperloom.plans.registry import core
from paperloom.sources.tables import table

query = core.query


@query("clean_chunk", CUR + f"SELECT id, {sql_clean('text')} AS text FROM cur")
def clean_chunk(spark, d):
    return current(spark, d, "id", T.clean_chunk(F.col("text")).alias("text"))


PAGE = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({sql_visible('text')},
  '(?m)^[\s\-]*\b(?:Halaman|Hal\.|Page|Hal)\s+\d+\s+(?:dari|of|/)\s+\d+[\s\-]*$|^\s*-\s*\d+\s*-\s*$', '', 'g'), '(?m)^\s*\d{{1,4}}\s*$', '', 'g'),
  '[ \t]+\n', chr(10), 'g'), '\n[ \t]+', chr(10), 'g')"""
CLEAN_PAGE = f"coalesce({sql_strip(f'''regexp_replace(regexp_replace({PAGE}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')''')}, '')"


@query("clean_page", CUR + f"SELECT id, {CLEAN_PAGE} AS text FROM cur")
def clean_page(spark, d):
    return current(spark, d, "id", T.clean_page(F.col("text")).alias("text"))


@query("clean_page_old", CUR + f"""SELECT id, coalesce({sql_strip(r"regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{2,}', chr(10), 'g')")}, '') AS text FROM cur""")
def clean_page_old(spark, d):
    return current(spark, d, "id", T.clean_page_old(F.col("text")).alias("text"))


MARKED = "text || ' ' || ['" + "', '".join(COMPOSED) + f"'][CAST(doc_id % {len(COMPOSED)} + 1 AS INTEGER)]"


@query("clean_chunk_composed", f"SELECT doc_id, {sql_clean(f'({MARKED})')} AS text FROM documents")
def clean_chunk_composed(spark, d):
    """Every document with a character behind it that compatibility composition changes."""
    mark = F.element_at(F.array(*[F.lit(x) for x in COMPOSED]), (F.col("doc_id") % len(COMPOSED) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", T.clean_chunk(F.concat("text", F.lit(" "), mark)).alias("text"))


@query("token_counts", r"""SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (
  SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z가-힣]+|\d+(?:[/-]\d+)*'))) AS term FROM documents WHERE text IS NOT NULL) GROUP BY term""")
def token_counts(spark, d):
    per = table(spark, d, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term", "doc_id").agg(
        F.count(F.lit(1)).alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


@query("article_labels", CUR + r"""SELECT id,
  coalesce(CASE WHEN regexp_matches(text, '(?i)\bPembukaan\b') THEN 'Pembukaan' END, nullif(regexp_extract(text, '(?i)\b(BAB\s+[IVXLCDM]+)\b', 1), ''),
    nullif(regexp_extract(text, '(?i)\b(Pasal\s+\d+[A-Za-z]?)\b', 1), ''), nullif(regexp_extract(text, '(?i)\b(Bagian\s+[0-9A-Za-z_]+)\b', 1), ''), '') AS label,
  coalesce(regexp_extract(text, '(?i)(Pasal\s+\d+[A-Za-z]?|Bab\s+[IVXLCDM]+|Pembukaan)', 1), '') AS old_label FROM cur""")
def article_labels(spark, d):
    return current(spark, d, "id", T.article(F.col("text")).alias("label"), T.article_old(F.col("text")).alias("old_label"))


BLOCKS = """SELECT id, k, b FROM (SELECT id, unnest(range(len(bs))) AS k, unnest(bs) AS b FROM (
  SELECT id, list_transform(range(0, len(ls), 3), lambda i: array_to_string(list_slice(ls, i + 1, i + 3), chr(10))) AS bs FROM (SELECT id, string_split(text, chr(10)) AS ls FROM cur WHERE text IS NOT NULL)))"""
NOISE = rf"""SELECT id, k, (length(t) < 80 OR length(regexp_replace(t, '[^\p{{L}}\p{{N}}]', '', 'g')) / greatest(length(t), 1) < 0.3
   OR (len(list_filter(ls, lambda x: regexp_matches(x, '{T.SIGNATURE}'))) / len(ls) > 0.6 AND length(t) < 400)) AS noise
  FROM (SELECT id, k, t, list_filter(list_transform(string_split(t, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS ls
        FROM (SELECT id, k, {sql_strip("b")} AS t FROM ({BLOCKS})))"""


def text_blocks(spark, d):
    """(id, k, b): every current chunk in blocks of three lines, as short texts as an extraction may leave."""
    lines = F.split("text", "\n")
    blocks = F.transform(F.sequence(F.lit(0), F.size(lines) - 1, F.lit(3)), lambda i: F.array_join(F.slice(lines, i + 1, F.lit(3)), "\n"))
    return current(spark, d, "id", "text").where("text IS NOT NULL").select("id", F.posexplode(blocks).alias("k", "b"))


@query("noise_chunks", CUR + f"SELECT id, CAST(k AS INTEGER) AS k FROM ({NOISE}) WHERE noise")
def noise_chunks(spark, d):
    return text_blocks(spark, d).where(T.is_noise(F.col("b"))).select("id", "k")


@query("short_chunks", CUR + f"SELECT id, CAST(k AS INTEGER) AS k, length({sql_strip('b')}) AS chars FROM ({BLOCKS}) WHERE length({sql_strip('b')}) < 80")
def short_chunks(spark, d):
    chars = F.length(T.strip(F.col("b")))
    return text_blocks(spark, d).where(chars < C.STRUCT_MIN).select("id", "k", chars.cast("long").alias("chars"))


SLUG = "lower(regexp_replace(regexp_replace(slug, '[^A-Za-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g'))"


@query("folder_collections", f"""SELECT category, 'indonesia_' || {SLUG} AS collection, n FROM (
  SELECT category, count(*) AS n, CASE WHEN category = '헌법' THEN 'constitution' WHEN contains(category, '_') THEN substr(category, strpos(category, '_') + 1) ELSE category END AS slug
  FROM manifest WHERE category IS NOT NULL GROUP BY category)""")
def folder_collections(spark, d):
    n = table(spark, d, "manifest").where("category IS NOT NULL").groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return n.select("category", T.folder_collection(F.col("category")).alias("collection"), "n")


@query("chunk_ids", """SELECT path, id, substr(sha1(path), 1, 10) || '-p' || regexp_extract(id, '-p(\\d+)-(\\d+)$', 1) || '-' || regexp_extract(id, '-p(\\d+)-(\\d+)$', 2) AS made
  FROM (SELECT DISTINCT path, unnest(chunk_ids) AS id FROM manifest WHERE path IS NOT NULL)""")
def chunk_ids(spark, d):
    """The ids that the manifest lists, and what path, page and running number make of them."""
    m = table(spark, d, "manifest").where("path IS NOT NULL").select("path", F.explode("chunk_ids").alias("id")).distinct()
    part = lambda g: F.regexp_extract("id", r"-p(\d+)-(\d+)$", g)
    return m.select("path", "id", T.chunk_id(F.col("path"), part(1), part(2)).alias("made"))


@query("content_hashes", "SELECT doc_id, sha256(text) AS sha256, strlen(text) AS size FROM documents WHERE text IS NOT NULL")
def content_hashes(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))


@query("snippets", CUR + f"""SELECT id, substr({sql_clean('text')}, 1, 240) || CASE WHEN length(text) > 240 THEN '…' ELSE '' END AS snippet,
  CASE WHEN length(source) <= 32 THEN source ELSE substr(source, 1, 18) || '…' || right(source, 13) END AS name FROM cur""")
def snippets(spark, d):
    return current(spark, d, "id", T.snippet(F.col("text")).alias("snippet"), T.short_name(F.col("source"), 32).alias("name"))


@query("reading_time", r"SELECT doc_id, greatest(1, CAST(floor(length(regexp_replace(coalesce(text, ''), '\s', '', 'g')) / 350 + 0.5) AS INTEGER)) AS minutes FROM documents")
def reading_time(spark, d):
    return table(spark, d, "documents").select("doc_id", T.reading_minutes(F.col("text")).alias("minutes"))


ESC = """replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')"""


@query("highlighted", f"""SELECT doc_id, regexp_replace({ESC}, '(?i)(tahun anggaran)', '<mark>\\1</mark>', 'g') AS html FROM documents
  WHERE contains(lower(text), 'tahun anggaran')""")
def highlighted(spark, d):
    return table(spark, d, "documents").where(F.lower("text").contains("tahun anggaran")).select(
        "doc_id", T.highlight(T.escape_html(F.col("text")), "tahun anggaran").alias("html"))


# The second engine has no lookarounds: italics and links are written with the character before them.
def _inline_sql(x: str) -> str:
    for rx, to in T.INLINE:
        to = re.sub(r"\$(\d)", r"\\\1", to)
        if rx.startswith(r"(?<![*\w])"):
            rx, to = r"(^|[^*\w])\*([^*\n]+?)\*(\W|$)", r"\1<em>\2</em>\3"
        elif rx == T.LINK:
            rx, to = rx.replace(r'(?<![\">])', r'(^|[^\">])'), to.replace(r"\1", r"\2")
            to = r"\1" + to
        x = f"regexp_replace({x}, '{rx}', '{to}', 'g')"
    return x


LINE = "'**' || suite || '** `' || lang || '` *' || replace(text, '*', '') || '* UU No. ' || item_id || '/2003, Perda 7 Tahun 2011 [' || item_id % 30 || '] https://example.org/' || item_id || '. (Pasal 3 ayat (2), 출처: UU_5.pdf, p.3)'"


@query("inline_markup", f"""SELECT item_id, {_inline_sql("replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '" + chr(34) + "', '&quot;')")} AS html FROM (SELECT item_id, {LINE} AS t FROM eval_items)""")
def inline_markup(spark, d):
    lit = F.lit
    t = F.concat(lit("**"), "suite", lit("** `"), "lang", lit("` *"), F.replace("text", lit("*"), lit("")), lit("* UU No. "), "item_id", lit("/2003, Perda 7 Tahun 2011 ["), F.col("item_id") % 30,
                 lit("] https://example.org/"), "item_id", lit(". (Pasal 3 ayat (2), 출처: UU_5.pdf, p.3)"))
    return table(spark, d, "eval_items").select("item_id", T.inline_markup(t).alias("html"))


LAW = {"articles": r"(?i)Pasal\s+\d+[A-Za-z]?", "paragraphs": r"(?i)ayat\s*\(\d+\)", "letters": r"(?i)huruf\s+[a-z]\b", "chapters": r"(?i)\bBAB\s+[IVXLCDM]+\b",
       "korean": r"제\d+조", "numbers": r"(?i)Nomor\s+\d+", "years": r"(?i)Tahun\s+\d{4}", "english": r"(?i)Article\s+\d+"}


@query("law_references", "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{rx}')) AS {n}" for n, rx in LAW.items()) + " FROM documents WHERE text IS NOT NULL")
def law_references(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", *[F.regexp_count("text", F.lit(rx)).cast("long").alias(n) for n, rx in LAW.items()])


@query("durations", r"""SELECT event_id, given, CASE WHEN regexp_matches(given, '^[0-9]+$') THEN CAST(given AS INTEGER)
  ELSE coalesce(CAST(nullif(regexp_extract(given, '([0-9]+)h', 1), '') AS INTEGER), 0) * 3600 + coalesce(CAST(nullif(regexp_extract(given, '([0-9]+)m', 1), '') AS INTEGER), 0) * 60
     + coalesce(CAST(nullif(regexp_extract(given, '([0-9]+)s', 1), '') AS INTEGER), 0) END AS seconds
  FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN user_id || 's' WHEN 2 THEN (event_id % 24) || 'h' || (user_id % 60) || 'm' ELSE (user_id % 90) || 'm' END AS given FROM events)""")
def durations(spark, d):
    u, e = F.col("user_id"), F.col("event_id")
    given = F.when(e % 4 == 0, u.cast("string")).when(e % 4 == 1, F.concat(u, F.lit("s"))).when(
        e % 4 == 2, F.concat(e % 24, F.lit("h"), u % 60, F.lit("m"))).otherwise(F.concat(u % 90, F.lit("m")))
    df = table(spark, d, "events").select("event_id", given.alias("given"))
    return df.select("event_id", "given", T.duration_seconds(F.col("given")).alias("seconds"))


@query("display_names", """SELECT collection, coalesce(CASE replace(collection, 'indonesia_', '') WHEN 'constitution' THEN '헌법' WHEN 'uu' THEN '법률' WHEN 'pp' THEN '정부령' WHEN 'perpres' THEN '대통령령'
  WHEN 'permen' THEN '장관령' WHEN 'kepmen' THEN '장관결정' WHEN 'perda' THEN '조례' WHEN 'lainnya' THEN '기타' END, collection) AS name FROM (SELECT DISTINCT collection FROM manifest WHERE collection IS NOT NULL)""")
def display_names(spark, d):
    m = table(spark, d, "manifest").where("collection IS NOT NULL").select("collection").distinct()
    names = F.create_map(*[F.lit(x) for kv in C.DISPLAY.items() for x in kv])
    return m.select("collection", F.coalesce(F.try_element_at(names, F.replace("collection", F.lit(C.COLLECTION_PREFIX), F.lit(""))), "collection").alias("name"))


@query("event_stamps", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, strftime(ts, '%Y-%m') AS month,
  CASE WHEN age < 60 THEN 'now' WHEN age < 3600 THEN (age // 60) || ' min' WHEN age < 86400 THEN (age // 3600) || ' h' ELSE (age // 86400) || ' d' END AS label
  FROM (SELECT event_id, ts, CAST(epoch(last) AS BIGINT) - CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS age FROM events, (SELECT date_trunc('second', max(ts)) AS last FROM events))""")
def event_stamps(spark, d):
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    last = e.agg(F.unix_seconds(F.date_trunc("second", F.max("t"))).alias("last"))
    e = e.crossJoin(F.broadcast(last)).withColumn("age", F.col("last") - F.unix_seconds(F.date_trunc("second", "t")))  # one row
    unit = lambda n, u: F.concat(F.expr(f"age div {n}"), F.lit(u))
    return e.select("event_id", F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"), F.date_format("t", "yyyy-MM").alias("month"),
                    F.when(F.col("age") < 60, "now").when(F.col("age") < 3600, unit(60, " min")).when(F.col("age") < 86400, unit(3600, " h")).otherwise(unit(86400, " d")).alias("label"))


# The end of a window: behind the last mark that stands in it whole, if that is in its second half.
FIXED_SQL = r"""WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
 w AS (SELECT doc_id, 0 AS idx, 1 AS pos, substr(t, 1, 700) AS win, length(t) AS n FROM t WHERE t <> ''
   UNION ALL SELECT w.doc_id, idx + 1, nxt, substr(t.t, nxt, 700), n FROM (SELECT doc_id, idx, n, greatest(pos + used - 120, pos + 1) AS nxt FROM (SELECT *, CASE WHEN split > 350 THEN split + 1 ELSE 700 END AS used
     FROM (SELECT *, greatest(CASE WHEN contains(win, chr(10)) THEN length(win) - strpos(reverse(win), chr(10)) ELSE -1 END, CASE WHEN contains(win, '. ') THEN length(win) - strpos(reverse(win), ' .') - 1 ELSE -1 END,
       CASE WHEN contains(win, '。') THEN length(win) - strpos(reverse(win), '。') ELSE -1 END) AS split FROM w) WHERE pos + 699 < n)) w JOIN t ON t.doc_id = w.doc_id),
 s AS (SELECT *, greatest(CASE WHEN contains(win, chr(10)) THEN length(win) - strpos(reverse(win), chr(10)) ELSE -1 END, CASE WHEN contains(win, '. ') THEN length(win) - strpos(reverse(win), ' .') - 1 ELSE -1 END,
       CASE WHEN contains(win, '。') THEN length(win) - strpos(reverse(win), '。') ELSE -1 END) AS split FROM w)
SELECT doc_id, CAST(idx AS INTEGER) AS idx, regexp_replace(CASE WHEN pos + 699 >= n OR split <= 350 THEN win ELSE substr(win, 1, split + 1) END, '^\s+|\s+$', '', 'g') AS chunk FROM s"""


@query("fixed_chunks", FIXED_SQL)
def fixed_chunks(spark, d):
    return chunking.fixed_chunks(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def _sql_parts(x: str, mark: str, keep: str = "") -> str:
    """The parts of a text between marks, stripped, without blank ones."""
    return f"list_filter(list_transform(string_split(regexp_replace({x}, '{mark}', '{keep}', 'g'), chr(31)), lambda p: {sql_strip('p')}), lambda p: p <> '')"


# Greedy joins as folds over lists of {done, held}.
def _sql_fold(parts: str, limit: str, glue: str, full: str, then: str) -> str:
    start = f"list_transform({parts}, lambda p: {{'done': []::VARCHAR[], 'held': p}})"
    fit = f"length(a.held) + length(b.held) + 1 <= {limit}"
    both = f"a.held || {glue} || b.held"
    step = f"""CASE WHEN a.held = '' THEN {{'done': a.done, 'held': b.held}} WHEN {fit} AND length({both}) >= {full} THEN {{'done': list_append(a.done, {both}), 'held': ''}}
      WHEN {fit} THEN {{'done': a.done, 'held': {both}}} ELSE {{'done': list_append(a.done, a.held), 'held': {then}}} END"""
    return f"list_reduce({start}, lambda a, b: {step})"


def struct_ctes(src: str) -> str:
    """CTEs that cut ``src`` (doc_id, text) by structure; the last is chunked (doc_id, idx, chunk)."""
    return rf"""t AS (SELECT doc_id, {sql_strip('text')} AS t FROM {src} WHERE text IS NOT NULL),
 sec AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS s FROM (SELECT doc_id, {_sql_parts('t', chr(92) + "n(" + chr(92) + "s*(?:BAB" + chr(92) + "s+[IVXLCDM]+|Pasal" + chr(92) + "s+" + chr(92) + "d+[A-Za-z]?|Bagian" + chr(92) + "s+[" + chr(92) + "p{L}" + chr(92) + "p{N}_]+|Pembukaan)" + chr(92) + "b)", chr(31) + chr(92) + "1").replace("'\\n(", "'(?i)\\n(")} AS p FROM t)),
 par AS (SELECT doc_id, i, 0 AS j, s FROM sec WHERE length(s) <= 1800
   UNION ALL SELECT doc_id, i, generate_subscripts(p, 1), unnest(p) FROM (SELECT doc_id, i, {_sql_parts('s', chr(92) + "n" + chr(92) + "s*" + chr(92) + "n", chr(31))} AS p FROM sec WHERE length(s) > 1800)),
 run AS (SELECT doc_id, i, j, list_append(f.done, f.held) AS runs FROM (SELECT doc_id, i, j, {_sql_fold(_sql_parts('s', '([.!?。])' + chr(92) + 's+', chr(92) + '1' + chr(31)), '1200', "' '", '1000000000', "CASE WHEN length(a.held) > 180 THEN right(a.held, 180) || ' ' || b.held ELSE b.held END")} AS f FROM par WHERE length(s) > 1800)),
 cutr AS (SELECT doc_id, i, j, k, CASE WHEN length(r) <= 1800 THEN [r] ELSE list_transform(range(0, length(r), 1200), lambda q: substr(r, q + 1, 1200)) END AS cs FROM (SELECT doc_id, i, j, generate_subscripts(runs, 1) AS k, unnest(runs) AS r FROM run)),
 part AS (SELECT doc_id, i, j, 0 AS k, 0 AS m, s FROM par WHERE length(s) <= 1800 UNION ALL SELECT doc_id, i, j, k, generate_subscripts(cs, 1), unnest(cs) FROM cutr),
 lst AS (SELECT doc_id, list(s ORDER BY i, j, k, m) AS ps FROM part GROUP BY doc_id),
 merged AS (SELECT doc_id, list_filter(list_append(f.done, f.held), lambda c: length(c) >= 80) AS cs FROM (SELECT doc_id, {_sql_fold('ps', '1800', 'chr(10)', '1200', 'b.held')} AS f FROM lst)),
 chunked AS (SELECT doc_id, CAST(idx - 1 AS INTEGER) AS idx, chunk FROM (SELECT doc_id, generate_subscripts(cs, 1) AS idx, unnest(cs) AS chunk FROM merged))"""


@query("struct_chunks", f"WITH {struct_ctes('documents')} SELECT doc_id, idx, chunk FROM chunked")
def struct_chunks(spark, d):
    return chunking.structured_chunks(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


MERGE_SQL = CUR + r""", p AS (SELECT file, page, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, id, row_number() OVER (PARTITION BY file ORDER BY page, CAST(split_part(id, '-', 3) AS INTEGER)) AS k
   FROM cur WHERE text IS NOT NULL AND page IS NOT NULL AND regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''),
 f AS (SELECT *, CASE WHEN NOT (regexp_matches(lag(t) OVER w, '[^.!?…。:;)"”’]$') AND regexp_matches(t, '^[\p{Ll}\p{Nd}]')) OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS brk FROM p WINDOW w AS (PARTITION BY file ORDER BY k)),
 g AS (SELECT *, sum(brk) OVER (PARTITION BY file ORDER BY k) AS island FROM f)
SELECT file, CAST(island AS BIGINT) AS island, min(page) AS page, string_agg(t, ' ' ORDER BY k) AS text FROM g GROUP BY file, island"""


@query("page_merge", MERGE_SQL)
def page_merge(spark, d):
    rows = current(spark, d, "file", "page", "text", F.split("id", "-")[2].cast("int").alias("idx"))
    return chunking.merge_pages(rows)


@query("rendered_answers")
def rendered_answers(spark, d):
    """Every document as HTML blocks."""
    from paperloom.functions.markup import render

    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", render(F.col("text")).alias("html"))
