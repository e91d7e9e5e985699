"""Queries over lexical and dense search, fusion and reranking.

Questions are the evaluation items whose number is divisible by 50. A question is expanded to its sentences, its keywords and its last
sentences as hypothetical answers; the vector of its n-th expanded query is the row of chunk_vectors numbered item_id - 7000 + n - 1. Intent and
suggested collection go round with its number, and some questions ask for two collections alone.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom import config as C
from paperloom import models
from paperloom.functions.text import tokens
from paperloom.operators import dense, fusion, lexical
from paperloom.plans.base import CUR, VEC, current, vectors
from paperloom.plans.registry import core
from paperloom.session import cut, shared_folder
from paperloom.sources.tables import table

query = core.query
TOK = r"regexp_extract_all(lower({0}), '[a-z가-힣]+|\d+(?:[/-]\d+)*')"

BM25 = CUR + rf"""
, toks AS (SELECT id, {TOK.format("coalesce(text, '')")} AS t FROM cur),
 stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
 dfs AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM toks) GROUP BY term),
 raw AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM dfs, stats),
 idfs AS (SELECT term, df, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25::DOUBLE FROM raw) ELSE raw END AS idf FROM raw),
 q AS (SELECT item_id AS query_id, text, ['single_answer', 'article_lookup', 'hierarchy', 'comparison', 'case_application', 'general'][CAST(item_id // 50 % 6 + 1 AS INTEGER)] AS intent,
   'indonesia_' || ['constitution', 'uu', 'pp', 'perpres', 'permen', 'kepmen', 'perda', 'lainnya'][CAST(item_id // 50 % 8 + 1 AS INTEGER)] AS auto,
   CASE WHEN item_id // 50 % 4 = 3 THEN ['v2_indonesia_uu', 'v2_indonesia_permen'] END AS wanted FROM eval_items WHERE item_id % 50 = 0),
 lists AS (SELECT query_id, 0 AS list_no, {TOK.format('text')} AS t FROM q
   UNION ALL SELECT query_id, 1, list_slice({TOK.format('text')}, 1, 6) FROM q),
 terms AS (SELECT query_id, list_no, term, count(*) AS qtf FROM (SELECT query_id, list_no, unnest(t) AS term FROM lists) GROUP BY ALL),
 tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM toks) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
 bm AS (SELECT query_id, list_no, id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
   FROM tf JOIN terms USING (term) JOIN idfs USING (term), stats GROUP BY ALL),
 hits AS (SELECT query_id, list_no, id, score, row_number() OVER (PARTITION BY query_id, list_no ORDER BY score DESC, id) - 1 AS rank FROM bm WHERE score > 0)
"""


def questions(spark, d):
    q = table(spark, d, "eval_items").where("item_id % 50 = 0")
    names = lambda xs: F.array(*[F.lit(x) for x in xs])
    k = F.expr("CAST(item_id div 50 AS int)")
    return q.select(F.col("item_id").alias("query_id"), "text", F.element_at(names(list(C.STRATEGIES)), k % 6 + 1).alias("intent"),
                    F.concat(F.lit(C.COLLECTION_PREFIX), F.element_at(names(C.COLLECTIONS), k % 8 + 1)).alias("auto"),
                    F.when(k % 4 == 3, fusion.wanted_collections(names(["V2_Indonesia_UU ", "04_Permen"]))).alias("wanted"))


def expanded(items):
    """(query_id, label, query, place) of (query_id, text), by sentences and terms in place of a model's analysis."""
    s = F.transform(F.split("text", r"\. "), F.trim)
    return models.expand(items.select("query_id", F.trim("text").alias("text"), s.alias("sub_queries"), F.slice(tokens(F.col("text")), 1, 6).alias("id_keywords"),
                                      F.slice(F.reverse(s), 1, 3).alias("hyde")), "query_id")


def index(spark, d):
    """The lexical index of the current chunks: stored once, read by every search until the chunks change."""
    chunks = current(spark, d, "id", "text", "line_no")
    n, version = chunks.agg(F.count(F.lit(1)), F.max("line_no")).first()
    at = shared_folder(spark, f"lexical-{hashlib.sha1(d.encode()).hexdigest()[:12]}")
    return lexical.stored(chunks.select("id", "text"), at, f"{n}-{version}")


@query("bm25_stats", BM25 + "SELECT n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM dfs) AS terms, (SELECT round(sum(idf), 4) FROM idfs) AS idf_sum FROM stats")
def bm25_stats(spark, d):
    x = index(spark, d)
    return x.stats.crossJoin(x.terms.agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("idf"), 4).alias("idf_sum"))).select("n", F.round("avgdl", 6).alias("avgdl"), "terms", "idf_sum")


@query("bm25_terms", BM25 + "SELECT term, df, round(idf, 6) AS idf FROM idfs")
def bm25_terms(spark, d):
    return index(spark, d).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query("bm25_postings", BM25 + "SELECT term, id, CAST(dl AS BIGINT) AS dl, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY ALL")
def bm25_postings(spark, d):
    """The postings of the occurrences as they are read back."""
    return lexical.postings(index(spark, d).occurrences).select("term", "id", F.col("dl").cast("long").alias("dl"), "tf")


@query("bm25_topk", BM25 + "SELECT query_id, id, score, rank FROM hits WHERE list_no = 0 AND rank < 40")
def bm25_topk(spark, d):
    return lexical.search(questions(spark, d), index(spark, d), 40)


@query("bm25_fingerprint", CUR + "SELECT collection, count(*) AS n, max(line_no) AS version FROM cur WHERE collection IS NOT NULL GROUP BY collection")
def bm25_fingerprint(spark, d):
    """What an index was built from: it is rebuilt when this changes."""
    return current(spark, d).where("collection IS NOT NULL").groupBy("collection").agg(F.count(F.lit(1)).alias("n"), F.max("line_no").alias("version"))


DENSE = VEC + """, dq AS (SELECT row_no AS query_id, e AS q FROM unit WHERE row_no % 50 = 0),
 dvec AS (SELECT unit.id, e, collection, source, page, article FROM unit JOIN cur USING (id) WHERE collection IS NOT NULL),
 dist AS (SELECT query_id, id, collection, source, page, article, round(1 - list_dot_product(q, e), 6) + 0.0::DOUBLE AS dist FROM dq, dvec),
 dhits AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY dist, id) - 1 AS rank FROM dist)
"""


def placed_vectors(spark, d, vecs=None, chunks=None):
    """(id, embedding, collection, source, page, article) of vectors that belong to a current chunk with a collection."""
    meta = (chunks if chunks is not None else current(spark, d)).select("id", "collection", "source", "page", "article").where("collection IS NOT NULL")
    return (vecs if vecs is not None else vectors(spark, d)).select("id", "embedding").join(meta, "id")


def dense_hits(spark, d, queries, n, vecs=None, chunks=None):
    chunks = chunks if chunks is not None else current(spark, d)
    hits = dense.nearest(queries, placed_vectors(spark, d, vecs, chunks), n, "collection")
    return hits.join(chunks.select("id", "source", "page", "article"), "id")


@query("dense_topk", CUR + DENSE + "SELECT query_id, id, collection, dist, rank FROM dhits WHERE rank < 5")
def dense_topk(spark, d):
    q = vectors(spark, d).where("row_no % 50 = 0").select(F.col("row_no").alias("query_id"), "embedding")
    return dense.nearest(q, placed_vectors(spark, d), 5, "collection")


@query("dense_weighted", CUR + DENSE + """, w AS (SELECT *, coalesce(weight, 1.0::DOUBLE) AS wt FROM dhits LEFT JOIN (SELECT 'v2_' || collection AS collection, weight FROM collection_weights) USING (collection) WHERE rank < 20),
 e AS (SELECT query_id, id, collection, round(dist * wt * CASE WHEN coalesce(nullif(page, 0), 99) <= 2 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END, 12) AS eff, round(1 - coalesce(nullif(dist, 0), 1), 3) AS score FROM w)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY eff, id) AS place FROM e) WHERE place <= 12""")
def dense_weighted(spark, d):
    q = vectors(spark, d).where("row_no % 50 = 0").select(F.col("row_no").alias("query_id"), "embedding")
    hits = fusion.weighted(dense_hits(spark, d, q, 20), table(spark, d, "collection_weights"))
    eff = F.round(F.col("dist") * F.col("weight") * fusion.page_penalty(F.col("page")), 12)
    score = F.round(1 - F.coalesce(F.nullif("dist", F.lit(0.0)), F.lit(1.0)), 3)
    hits = hits.select("query_id", "id", "collection", eff.alias("eff"), score.alias("score"))
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("eff", "id")).cast("long")).where("place <= 12")


@query("collection_search", CUR + DENSE + """SELECT query_id, id, place, score FROM (SELECT query_id, id, round(1 - dist, 3) AS score, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS place
  FROM dhits WHERE collection = 'v2_indonesia_perda') WHERE place <= 8""")
def collection_search(spark, d):
    """One collection asked by the alias 'perda', at most eight results."""
    name = f"{C.VERSION_PREFIX}{C.COLLECTION_PREFIX}{C.ALIASES['perda']}"
    q = vectors(spark, d).where("row_no % 50 = 0").select(F.col("row_no").alias("query_id"), "embedding")
    hits = dense.nearest(q, placed_vectors(spark, d).where(F.col("collection") == name), C.TOOL_CHUNKS)
    return hits.select("query_id", "id", (F.col("rank") + 1).alias("place"), F.round(1 - F.col("dist"), 3).alias("score"))


# The choice by quotas as a fold over the rows in the order in which they are looked at: each is taken or left.
QUOTA = """, w AS (SELECT h.*, coalesce(weight, 1.0::DOUBLE) AS wt, replace(h.collection, 'v2_indonesia_', '') AS plain FROM dhits h LEFT JOIN (SELECT 'v2_' || collection AS collection, weight FROM collection_weights) c ON c.collection = h.collection WHERE rank < 36),
 e AS (SELECT query_id, id, plain, coalesce(source, '') AS source, coalesce(page, 0) AS page, coalesce(article, '') AS article, dist,
   round(dist * wt * CASE WHEN coalesce(nullif(page, 0), 99) <= 2 THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END, 12) AS eff FROM w),
 o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY eff, id) AS i FROM e),
 looked AS (SELECT query_id, i, concat_ws('|', source, page, article) AS key, CASE plain WHEN 'constitution' THEN 1 WHEN 'uu' THEN 2 ELSE 3 END AS pass, CASE plain WHEN 'constitution' THEN 3 WHEN 'uu' THEN 4 ELSE 2 END AS quota FROM o WHERE plain IN ('constitution', 'uu', 'pp')
   UNION ALL SELECT query_id, i, concat_ws('|', source, page, article), 4, 12 FROM o),
 folded AS (SELECT query_id, list_reduce(list_prepend({'i': 0::BIGINT, 'key': '', 'pass': 0, 'quota': 0, 'took': 0, 'chosen': []::BIGINT[], 'seen': []::VARCHAR[]},
     list({'i': i, 'key': key, 'pass': pass, 'quota': quota, 'took': 0, 'chosen': []::BIGINT[], 'seen': []::VARCHAR[]} ORDER BY pass, i)),
   lambda a, x: CASE WHEN NOT list_contains(a.seen, x.key) AND CASE WHEN x.pass = 4 THEN len(a.chosen) < 12 ELSE CASE WHEN a.pass = x.pass THEN a.took ELSE 0 END < x.quota END
     THEN {'i': x.i, 'key': x.key, 'pass': x.pass, 'quota': x.quota, 'took': CASE WHEN a.pass = x.pass THEN a.took ELSE 0 END + 1, 'chosen': list_append(a.chosen, x.i), 'seen': list_append(a.seen, x.key)}
     ELSE {'i': x.i, 'key': x.key, 'pass': x.pass, 'quota': x.quota, 'took': CASE WHEN a.pass = x.pass THEN a.took ELSE 0 END, 'chosen': a.chosen, 'seen': a.seen} END).chosen[1:12] AS chosen FROM looked GROUP BY query_id),
 picks AS (SELECT query_id, unnest(chosen) AS i FROM folded)
SELECT query_id, id, plain, source, CAST(page AS INTEGER) AS page, article, dist, eff, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o.i) AS INTEGER) AS place FROM picks JOIN o USING (query_id, i)"""


@query("quota_topk", CUR + DENSE + QUOTA)
def quota_topk(spark, d):
    q = vectors(spark, d).where("row_no % 50 = 0").select(F.col("row_no").alias("query_id"), "embedding")
    top_k = 12
    return fusion.quota_search(dense_hits(spark, d, q, max(3 * top_k, 20)), table(spark, d, "collection_weights"), top_k)


EXPANDED = r"""eq AS (SELECT item_id, list_transform(string_split(text, '. '), lambda x: trim(x)) AS s, trim(text) AS text FROM eval_items),
 eu AS (SELECT item_id, 0 AS k, 'original' AS label, text AS query FROM eq
  UNION ALL SELECT item_id, i, 'sub_' || i, s[i] FROM eq, (SELECT unnest(range(1, 5)) AS i) WHERE i <= len(s)
  UNION ALL SELECT item_id, 5, 'id_keywords', array_to_string(list_slice(regexp_extract_all(lower(text), '[a-z가-힣]+|\d+(?:[/-]\d+)*'), 1, 6), ' ') FROM eq
  UNION ALL SELECT item_id, 5 + i, 'hyde_' || i, s[len(s) - i + 1] FROM eq, (SELECT unnest(range(1, 4)) AS i) WHERE i <= len(s)),
 exp AS (SELECT item_id, label, query, place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY k) AS place FROM eu WHERE trim(query) <> '') WHERE place <= 10)"""


FUSE = BM25 + VEC + ", " + EXPANDED + """, dvec AS (SELECT unit.id, e, collection FROM unit JOIN cur USING (id) WHERE collection IS NOT NULL),
 dq AS (SELECT query_id, place - 1 AS list_no, e AS q, wanted, CASE intent WHEN 'single_answer' THEN 20 ELSE 30 END AS fetch_n FROM q JOIN exp ON item_id = query_id JOIN unit ON row_no = query_id - 7000 + place - 1),
 dist AS (SELECT query_id, list_no, fetch_n, wanted, id, collection, round(1 - list_dot_product(q, e), 6) + 0.0::DOUBLE AS dist FROM dq, dvec),
 dh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, list_no, collection ORDER BY dist, id) - 1 AS rank FROM dist) WHERE rank < fetch_n AND (wanted IS NULL OR list_contains(wanted, collection))),
 wts AS (SELECT 'v2_' || collection AS collection, collection AS plain, weight FROM collection_weights),
 both_ AS (SELECT query_id, id, 0 AS lexical, list_no, rank, dist FROM dh
   UNION ALL SELECT h.query_id, h.id, 1, h.list_no, h.rank, NULL FROM hits h JOIN q USING (query_id) JOIN cur USING (id)
     WHERE h.rank < 2 * CASE intent WHEN 'single_answer' THEN 20 ELSE 30 END AND collection IS NOT NULL AND (wanted IS NULL OR list_contains(wanted, collection))),
 wtd AS (SELECT b.*, cur.collection, source, page, article, intent,
   coalesce(weight, 1.0::DOUBLE) * CASE WHEN wanted IS NULL AND regexp_replace(cur.collection, '^v2_', '') = auto THEN 0.92::DOUBLE ELSE 1.0::DOUBLE END AS w,
   CASE WHEN coalesce(nullif(page, 0), 99) <= 2 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END AS pen FROM both_ b JOIN cur USING (id) JOIN q USING (query_id) LEFT JOIN wts ON wts.collection = cur.collection),
 eff AS (SELECT *, CASE WHEN lexical = 0 THEN coalesce(dist, 1.0::DOUBLE) ELSE 1.0::DOUBLE END * w * pen AS eff FROM wtd),
 fused AS (SELECT query_id, id, any_value(intent) AS intent, any_value(collection) AS collection, any_value(source) AS source, any_value(page) AS page, any_value(article) AS article,
   round(sum(1.0::DOUBLE / (61 + rank) / w), 9) AS rrf, round(arg_min(eff, {'a': lexical, 'b': eff, 'c': list_no, 'd': rank}), 12) AS eff, min(dist) AS dist FROM eff GROUP BY query_id, id)
"""


def fused(spark, d):
    """Candidates of every question after fusion: the hybrid search over its expanded queries, up to the filters."""
    q = questions(spark, d)
    fetch = F.create_map(*[F.lit(x) for k, v in C.STRATEGIES.items() for x in (k, v[2])])
    # The collections that an analysis suggests only weigh where the caller names none.
    side = q.select(F.col("query_id").alias("__q"), "intent", F.when(F.col("wanted").isNull(), F.col("auto")).alias("auto"), "wanted", F.try_element_at(fetch, F.col("intent")).alias("fetch"))
    most = max(v[2] for v in C.STRATEGIES.values())
    chunks, vecs = current(spark, d), vectors(spark, d)
    every = expanded(q)
    # The queries of a question are searched at once, numbered by question and place.
    qv = vecs.join(every.select("query_id", "place"), F.col("row_no") == F.col("query_id") - 7000 + F.col("place") - 1).select(
        (F.col("query_id") * 16 + F.col("place") - 1).alias("query_id"), "embedding")
    dh = dense_hits(spark, d, qv, most, vecs, chunks).withColumn("list_no", F.pmod("query_id", F.lit(16)).cast("int")).withColumn("query_id", F.shiftright("query_id", 4))
    dh = fusion.within(dh.join(side, F.col("query_id") == F.col("__q")).where("rank < fetch"))
    meta = ("collection", "source", "page", "article")
    lists = every.where("label IN ('original', 'id_keywords')").select((F.col("query_id") * 2 + F.when(F.col("label") == "original", 0).otherwise(1)).alias("query_id"), F.col("query").alias("text"))
    lh = lexical.search(lists, index(spark, d), 2 * most).join(chunks.select("id", *meta).where("collection IS NOT NULL"), "id")
    lh = lh.withColumn("list_no", F.pmod("query_id", F.lit(2)).cast("int")).withColumn("query_id", F.shiftright("query_id", 1))
    lh = fusion.within(lh.join(side, F.col("query_id") == F.col("__q")).where("rank < 2 * fetch"))
    w = table(spark, d, "collection_weights")
    keep = ("intent", *meta)
    return fusion.fuse(fusion.weighted(dh, w, F.array("auto")), fusion.weighted(lh, w, F.array("auto")), keep)


@query("rrf_fusion", FUSE + "SELECT query_id, id, rrf, eff, dist FROM fused")
def rrf_fusion(spark, d):
    return fused(spark, d).select("query_id", "id", "rrf", "eff", "dist")


HIER = FUSE + """, sums AS (SELECT query_id, intent, trim(source) AS s, round(sum(rrf), 9) AS total FROM fused WHERE trim(source) <> '' GROUP BY ALL),
 tops AS (SELECT query_id, s FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, s) AS k FROM sums) WHERE k <= CASE intent WHEN 'comparison' THEN 4 WHEN 'hierarchy' THEN 5 WHEN 'case_application' THEN 5 END),
 marked AS (SELECT f.*, t.s IS NOT NULL AS in_top, count(t.s) OVER (PARTITION BY f.query_id) AS kept FROM fused f LEFT JOIN tops t ON t.query_id = f.query_id AND t.s = f.source),
 hier AS (SELECT * FROM marked WHERE kept < 12 OR in_top)
"""


@query("source_filter", HIER + "SELECT query_id, id, source, rrf FROM hier")
def source_filter(spark, d):
    return fusion.source_filter(fused(spark, d)).select("query_id", "id", "source", "rrf")


# The greedy choice as a recursion over lists: (chosen, rest) of each query, one choice a step.
MMR = HIER.replace("WITH cur", "WITH RECURSIVE cur", 1) + """, pools AS (SELECT query_id, any_value(intent) AS intent, list({'id': id, 'source': coalesce(source, ''), 'article': coalesce(article, ''), 'r': rrf, 'eff': eff} ORDER BY rrf DESC, id) AS rest FROM hier GROUP BY query_id),
 sized AS (SELECT query_id, intent, rest, least(len(rest), CASE intent WHEN 'single_answer' THEN 30 WHEN 'article_lookup' THEN 40 WHEN 'general' THEN 50 ELSE 60 END) AS size, len(rest) AS total, CASE WHEN rest[1].r = 0 THEN 1.0::DOUBLE ELSE rest[1].r END AS top FROM pools),
 numbered AS (SELECT query_id, intent, size, total, list_transform(rest, lambda x, i: {'id': x.id, 'source': x.source, 'article': x.article, 'eff': x.eff, 'g': round(0.7::DOUBLE * x.r / top, 9), 'like': 0.0::DOUBLE, 'k': i}) AS rest FROM sized),
 steps AS (SELECT query_id, intent, size, total, 0 AS n, rest, NULL::STRUCT(s DOUBLE, nk BIGINT, c STRUCT(id VARCHAR, source VARCHAR, article VARCHAR, eff DOUBLE, g DOUBLE, "like" DOUBLE, k BIGINT)) AS best FROM numbered
   UNION ALL
   SELECT query_id, intent, size, total, n + 1, list_transform(list_filter(rest, lambda x: x.k <> b.c.k), lambda x: {'id': x.id, 'source': x.source, 'article': x.article, 'eff': x.eff, 'g': x.g,
       'like': CASE WHEN b.c.source <> '' AND x.source = b.c.source THEN greatest(x.like, CASE WHEN b.c.article <> '' AND x.article = b.c.article THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) ELSE x.like END, 'k': x.k}), b
   FROM (SELECT *, list_max(list_transform(rest, lambda x: {'s': round(x.g - CASE WHEN total <= size THEN 0.0::DOUBLE ELSE (1 - 0.7::DOUBLE) * x.like END, 9), 'nk': -x.k, 'c': x})) AS b FROM steps WHERE n < size)),
 picked AS (SELECT query_id, intent, n AS pick, best.c.id AS id, best.c.source AS source, best.c.eff AS eff FROM steps WHERE n > 0)
"""


@query("hybrid_retrieve", MMR + "SELECT query_id, id, CAST(pick AS INTEGER) AS pick FROM picked")
def hybrid_retrieve(spark, d):
    """The whole retrieval: both searches, fusion, source filter, diversification."""
    return fusion.diversify(fusion.source_filter(fused(spark, d)).select("query_id", "id", "intent", "source", "article", "rrf", "eff")).select("query_id", "id", "pick")


def scoring(prompt: str) -> str:
    """A stand-in for a scoring model: scores that go by a row's place and the prompt, every fifth missing, text around them; to every third question no reply."""
    question, *rows = re.split(r"\n\n\[\d+\] ", prompt)
    n = len(question) - len("Question:\n")
    if n % 3 == 0:
        return "I can't tell."
    scores = [{"idx": i, "score": (i * 7 + n) % 11, "reason": "x" * 300} for i in range(len(rows)) if i % 5 != 4]
    return "Here you are:\n" + json.dumps({"scores": [*scores, {"idx": None}, {"score": 3}]}) + "\nDone."


@query("rerank_diversity", MMR + r""", sized2 AS (SELECT p.*, q.text AS question, CASE p.intent WHEN 'single_answer' THEN 8 WHEN 'article_lookup' THEN 12 WHEN 'hierarchy' THEN 18 WHEN 'comparison' THEN 20 WHEN 'case_application' THEN 18 ELSE 15 END AS top_k,
   count(*) OVER (PARTITION BY p.query_id) AS n, list_distinct(regexp_extract_all(lower(q.text), '\S+')) AS qw, list_distinct(regexp_extract_all(lower(coalesce(cur.text, '')), '\S+')) AS tw
   FROM picked p JOIN q ON q.query_id = p.query_id JOIN cur ON cur.id = p.id),
 crossed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 20 THEN -round(len(list_intersect(qw, tw)) / len(qw), 9) END, pick) AS k FROM sized2),
 cutp AS (SELECT * FROM crossed WHERE k <= greatest(20, top_k)),
 sc AS (SELECT *, CASE WHEN (k - 1) % 5 = 4 OR length(question) % 3 = 0 THEN 5.0::DOUBLE ELSE CAST(((k - 1) * 7 + length(question)) % 11 AS DOUBLE) END AS score, count(*) OVER (PARTITION BY query_id) <= top_k OR length(question) % 3 = 0 AS small FROM cutp),
 fac AS (SELECT *, CASE WHEN source = '' THEN 1.0::DOUBLE ELSE greatest(0.55::DOUBLE, 1 - 0.15::DOUBLE * (row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, eff, id) - 1)) END AS factor FROM sc),
 adj AS (SELECT *, CASE WHEN small THEN score ELSE round(score * round(factor, 6), 6) END AS adjusted FROM fac)
SELECT query_id, id, score, adjusted, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN small THEN k END, adjusted DESC, eff, id) AS place FROM adj) WHERE place <= top_k""")
def rerank_diversity(spark, d):
    """Both stages: a cross-encoder's stand-in cuts the pool, a model's stand-in scores the rest."""
    pool = fusion.diversify(fusion.source_filter(fused(spark, d)).select("query_id", "id", "intent", "source", "article", "rrf", "eff"))
    ask = questions(spark, d).select(F.col("query_id").alias("__q"), F.col("text").alias("question"))
    texts = current(spark, d, "id", F.col("text").alias("body"))
    pool = pool.join(texts, "id").join(F.broadcast(ask), F.col("query_id") == F.col("__q")).drop("__q")  # one row per question
    pool = cut(pool.withColumn("cross", models.cross_score(F.col("question"), F.col("body"), models.overlap_scorer)))
    first = fusion.cross_cut(pool, F.col("cross"))
    scores = models.rerank_scores(first.select("query_id", "question", (F.col("k") - 1).alias("idx"), "id", F.left("body", F.lit(C.TOOL_CHARS)).alias("block")), scoring)
    return fusion.rerank(pool, scores, F.col("cross")).select("query_id", "id", "score", "adjusted", "place")


@query("expanded_queries", "WITH " + EXPANDED + " SELECT item_id, label, query, place FROM exp")
def expanded_queries(spark, d):
    return expanded(table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "text")).withColumnRenamed("query_id", "item_id")
