"""Queries of the operational reports. Costs and probes are read off the events table, histories off the documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom import config as C
from paperloom.functions.text import clean_chunk
from paperloom.operators import fusion
from paperloom.operators import reports as R
from paperloom.operators.references import merged_issues
from paperloom.plans.base import CUR, current, sql_clean
from paperloom.plans.registry import core
from paperloom.plans.search_queries import MMR, fused
from paperloom.sources.tables import table

query = core.query


def events(spark, d):
    return table(spark, d, "events")


@query("daily_cost", "SELECT coalesce(strftime(ts, '%Y-%m-%d'), 'TOTAL') AS day, round(sum(value), 6) AS amount FROM events GROUP BY ROLLUP (strftime(ts, '%Y-%m-%d'))")
def daily_cost(spark, d):
    return R.daily_totals(events(spark, d), F.col("ts"), F.col("value"))


@query("cost_breakdown", "WITH b AS (SELECT event_type || ' / ' || (user_id % 3) AS label, round(sum(value), 6) AS amount FROM events GROUP BY 1 HAVING round(sum(value), 6) > 0) SELECT label, amount, round(amount * 100 / sum(amount) OVER (), 4) AS share FROM b")
def cost_breakdown(spark, d):
    return R.breakdown(events(spark, d), F.concat("event_type", F.lit(" / "), F.col("user_id") % 3), F.col("value"))


@query("token_usage", """SELECT event_type AS model, CAST(sum(CASE WHEN event_id % 3 = 0 THEN k ELSE 0 END) AS BIGINT) AS uncached, CAST(sum(CASE WHEN event_id % 3 = 1 THEN k ELSE 0 END) AS BIGINT) AS cached, CAST(sum(CASE WHEN event_id % 3 = 2 THEN k ELSE 0 END) AS BIGINT) AS written,
  round(sum(CASE WHEN event_id % 3 = 1 THEN k ELSE 0 END) * 100.0::DOUBLE / nullif(sum(k), 0), 4) AS hit_percent FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1""")
def token_usage(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    part = lambda i: F.sum(F.when(F.col("event_id") % 3 == i, F.col("k")).otherwise(0))
    return events(spark, d).withColumn("k", k).groupBy(F.col("event_type").alias("model")).agg(
        part(0).alias("uncached"), part(1).alias("cached"), part(2).alias("written"), F.round(part(1) * 100.0 / F.nullif(F.sum("k"), F.lit(0)), 4).alias("hit_percent"))


@query("usage_buckets", """SELECT strftime(ts, '%Y-%m-%d') AS day, t.type AS kind, CAST(sum(t.amount) AS BIGINT) AS amount FROM (SELECT ts, unnest([{'type': 'uncached', 'amount': CAST(json_extract(props, '$.k') AS BIGINT)}, {'type': 'output', 'amount': user_id}]) AS t FROM events) GROUP BY ALL""")
def usage_buckets(spark, d):
    """Nested usage results taken apart and summed by day and kind."""
    k = F.get_json_object("props", "$.k").cast("long")
    res = F.array(F.struct(F.lit("uncached").alias("type"), k.alias("amount")), F.struct(F.lit("output").alias("type"), F.col("user_id").alias("amount")))
    return events(spark, d).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.explode(res).alias("t")).groupBy("day", F.col("t.type").alias("kind")).agg(F.sum("t.amount").alias("amount"))


@query("stage_timing", "SELECT event_type AS stage, count(*) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, round(sum(value) * 100 / (SELECT sum(value) FROM events), 4) AS share FROM events GROUP BY 1")
def stage_timing(spark, d):
    e = events(spark, d)
    by = e.groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("t"), F.avg("value").alias("m"))
    total = by.agg(F.sum("t").alias("all"))  # one row
    return by.crossJoin(F.broadcast(total)).select("stage", "n", F.round("t", 6).alias("total"), F.round("m", 6).alias("mean"), F.round(F.col("t") * 100 / F.col("all"), 4).alias("share"))


@query("progress_rate", """SELECT user_id, event_id, CAST(k AS BIGINT) AS done, round(rate, 6) AS rate, CASE WHEN rate > 0 THEN CAST(floor((n - k) / rate) AS BIGINT) END AS eta FROM (
  SELECT *, CASE WHEN k > 1 THEN 1 / greatest((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6::DOUBLE, 1) ELSE 0 END AS rate
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def progress_rate(spark, d):
    """Rate between two log points of a worker, and the seconds that the rest of its work takes at it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = (us - F.lag(us).over(w)) / 1e6
    x = events(spark, d).select("user_id", "event_id", F.row_number().over(w).alias("k"), F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("n"), gap.alias("gap"))
    rate = F.when(F.col("k") > 1, 1 / F.greatest("gap", F.lit(1.0))).otherwise(0.0)
    return x.select("user_id", "event_id", F.col("k").cast("long").alias("done"), F.round(rate, 6).alias("rate"), F.when(rate > 0, F.floor((F.col("n") - F.col("k")) / rate)).alias("eta"))


@query("history_source", """SELECT doc_id % 50 AS client, count(*) AS items, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM documents WHERE doc_id % 50 % 7 <> 3 GROUP BY 1""")
def history_source(spark, d):
    """Histories as clients keep them, one JSON text each, read back; some are broken and count as empty."""
    x = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("client"), F.struct(F.col("doc_id").alias("id"), F.col("text").alias("a")).alias("item"))
    kept = x.groupBy("client").agg(F.to_json(F.collect_list("item")).alias("json"))  # a client's history is one text by its nature
    kept = kept.withColumn("json", F.when(F.col("client") % 7 == 3, F.concat(F.lit("{"), "json")).otherwise(F.col("json")))
    return R.history_items(kept, "client", "json").groupBy("client").agg(F.count(F.lit(1)).alias("items"), F.sum(F.length(F.coalesce("a", F.lit("")))).alias("chars"))


HIST = """WITH h AS (SELECT doc_id AS id, coalesce(lang, '') AS q, text AS a, source, doc_kind AS category, nullif(n_chars, 0) AS elapsed, received_at AS ts, declared_chars IS NOT NULL AS starred FROM documents)"""


def history(spark, d):
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("q"), F.col("text").alias("a"), "source", F.col("doc_kind").alias("category"),
        F.nullif("n_chars", F.lit(0)).alias("elapsed"), F.col("received_at").alias("ts"), F.col("declared_chars").isNotNull().alias("starred"))


@query("history_stats", HIST + """SELECT count(*) AS n, round(avg(elapsed), 4) AS mean, min(elapsed) AS fastest, max(elapsed) AS slowest, CAST(sum(length(coalesce(a, ''))) AS BIGINT) AS chars, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_,
  (SELECT category FROM h WHERE category IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_category FROM h""")
def history_stats(spark, d):
    h = history(spark, d)
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    one = h.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("elapsed"), 4).alias("mean"), F.min("elapsed").alias("fastest"), F.max("elapsed").alias("slowest"),
                F.sum(F.length(F.coalesce("a", F.lit("")))).alias("chars"), day(F.min("ts")).alias("first_"), day(F.max("ts")).alias("last_"))
    top = h.where("category IS NOT NULL").groupBy("category").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "category").limit(1).select(F.col("category").alias("top_category"))
    return one.join(top, how="left")  # one row each


@query("category_share", HIST + "SELECT category, n, greatest(1, CAST(floor(n * 100 / sum(n) OVER () + 0.5) AS BIGINT)) AS bar FROM (SELECT category, count(*) AS n FROM h WHERE category IS NOT NULL GROUP BY 1)")
def category_share(spark, d):
    return R.share_bars(history(spark, d).where("category IS NOT NULL").groupBy("category").agg(F.count(F.lit(1)).alias("n")), "category")


@query("history_search", HIST + "SELECT id FROM h WHERE starred AND contains(lower(concat_ws(' ', q, a, source, category)), 'paling lambat')")
def history_search(spark, d):
    return R.history_matches(history(spark, d), "Paling Lambat", ["q", "a", "source", "category"], F.col("starred")).select("id")


@query("history_latest", HIST + "SELECT id FROM h ORDER BY ts DESC NULLS LAST, id LIMIT 30")
def history_latest(spark, d):
    """What is kept of a history: the thirty newest."""
    return history(spark, d).orderBy(*R.history_order("latest")).limit(C.HISTORY_ITEMS).select("id")


@query("history_sorts", HIST + "SELECT * FROM (SELECT 'fastest' AS mode, id FROM h ORDER BY elapsed ASC NULLS LAST, id LIMIT 30) UNION ALL SELECT * FROM (SELECT 'slowest', id FROM h ORDER BY coalesce(elapsed, 0) DESC, id LIMIT 30) UNION ALL SELECT * FROM (SELECT 'oldest', id FROM h ORDER BY ts ASC NULLS LAST, id LIMIT 30)")
def history_sorts(spark, d):
    h = history(spark, d)
    out = [h.orderBy(*R.history_order(m)).limit(C.HISTORY_ITEMS).select(F.lit(m).alias("mode"), "id") for m in ("fastest", "slowest", "oldest")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("history_markdown", HIST + ", t AS (SELECT *, row_number() OVER (ORDER BY ts DESC NULLS LAST, id) AS k FROM (SELECT * FROM h ORDER BY ts DESC NULLS LAST, id LIMIT 30)) SELECT string_agg('## ' || k || '. ' || substr(coalesce(a, ''), 1, 60) || chr(10) || chr(10) || '- scope: ' || coalesce(category, '-') || chr(10) || '- sources: ' || coalesce(source, '-') || chr(10) || '- time: ' || coalesce(elapsed, 0) || ' ms' || chr(10), chr(10) ORDER BY k) AS markdown FROM t")
def history_markdown(spark, d):
    top = history(spark, d).orderBy(*R.history_order("latest")).limit(C.HISTORY_ITEMS)
    k = F.row_number().over(Window.orderBy(*R.history_order("latest")))  # thirty rows
    z, dash = F.lit(""), F.lit("-")
    item = R.markdown_item(F.col("k"), F.substring(F.coalesce("a", z), 1, 60), F.coalesce("category", dash), F.coalesce("source", dash), F.coalesce("elapsed", F.lit(0)))
    return top.withColumn("k", k).select("k", item.alias("m")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]), "\n").alias("markdown"))


@query("corpus_order", CUR + """, n AS (SELECT replace(replace(collection, 'v2_', ''), 'indonesia_', '') AS name, count(*) AS n FROM cur WHERE collection IS NOT NULL GROUP BY 1)
SELECT name, n, row_number() OVER (ORDER BY n DESC, name) AS most, row_number() OVER (ORDER BY n, name) AS least, row_number() OVER (ORDER BY name) AS alpha,
  row_number() OVER (ORDER BY coalesce(nullif(list_position(['constitution', 'uu', 'pp', 'perpres', 'permen', 'kepmen', 'perda', 'lainnya'], name), 0), 999), name) AS rank_ FROM n WHERE n > 0""")
def corpus_order(spark, d):
    """Collections in each of the display orders; a row per collection."""
    name = F.replace(F.replace("collection", F.lit("v2_"), F.lit("")), F.lit("indonesia_"), F.lit(""))
    n = current(spark, d).where("collection IS NOT NULL").groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    place = lambda m: F.row_number().over(Window.orderBy(*R.collection_order(F.col("name"), F.col("n"), m))).cast("long")
    return n.select("name", "n", place("most").alias("most"), place("least").alias("least"), place("alpha").alias("alpha"), place("rank").alias("rank_"))


CONV = """WITH m AS (SELECT user_id AS conv_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, CASE WHEN event_type IN ('view', 'click') THEN 'user' ELSE 'assistant' END AS role, event_type, props FROM events)"""


def messages(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events(spark, d).select(F.col("user_id").alias("conv_id"), "event_id", "ts", F.row_number().over(w).cast("long").alias("turn"),
                                   F.when(F.col("event_type").isin("view", "click"), "user").otherwise("assistant").alias("role"), "event_type", "props")


@query("conversation_cap", CONV + """, k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b, count(*) OVER (PARTITION BY conv_id) AS n FROM m)
SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS f FROM k WHERE b <= 10) WHERE NOT (n > 10 AND f = 1 AND role = 'assistant')""")
def conversation_cap(spark, d):
    return R.last_messages(messages(spark, d).select("conv_id", "turn", "role"))


@query("turn_numbers", CONV + "SELECT conv_id, turn, (turn - 1) // 2 + 1 AS turn_no FROM m WHERE role = 'user'")
def turn_numbers(spark, d):
    return messages(spark, d).where("role = 'user'").select("conv_id", "turn", F.expr("(turn - 1) div 2 + 1").alias("turn_no"))


KIND = "CASE event_type WHEN 'signup' THEN 'regenerating' WHEN 'purchase' THEN 'sources' WHEN 'error' THEN CASE event_id % 2 WHEN 0 THEN 'rate_limited' ELSE 'error' END ELSE 'token' END"


def sse_kind():
    e = F.col("event_type")
    return F.when(e == "signup", "regenerating").when(e == "purchase", "sources").when(
        e == "error", F.when(F.col("event_id") % 2 == 0, "rate_limited").otherwise("error")).otherwise("token")


@query("sse_format", CONV + f"SELECT event_id, 'event: ' || {KIND} || chr(10) || 'data: ' || props || chr(10) || chr(10) AS frame FROM m")
def sse_format(spark, d):
    return messages(spark, d).select("event_id", R.sse_format(sse_kind(), F.col("props")).alias("frame"))


@query("answer_events", r"""WITH a AS (SELECT doc_id AS conv_id, doc_kind, source, CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE list_slice(string_split(text, ' '), 1, 5) END AS ts, lang, CAST(doc_id % 3 AS INTEGER) AS un, CASE WHEN doc_id % 9 = 0 THEN 'limit' END AS err FROM documents),
 e AS (SELECT conv_id, list_filter(list_concat([{'e': 'conversation', 'd': '{"conv_id":' || conv_id || '}'}, {'e': 'retrieving', 'd': '{}'}, {'e': 'intent', 'd': '{"intent":' || CAST(to_json(doc_kind) AS VARCHAR) || '}'}, {'e': 'sources', 'd': '{"sources":' || CAST(to_json(source) AS VARCHAR) || '}'}],
   list_transform(ts, lambda t: {'e': 'token', 'd': '{"text":' || CAST(to_json(t) AS VARCHAR) || '}'}),
   CASE WHEN err IS NOT NULL THEN [{'e': 'error', 'd': '{"message":"limit"}'}] ELSE [{'e': 'critique', 'd': '{"confidence":' || CAST(to_json(lang) AS VARCHAR) || '}'}, {'e': 'verifier', 'd': '{"unverified":' || un || '}'}, {'e': 'done', 'd': '{}'}] END), lambda x: x.d IS NOT NULL AND NOT contains(x.d, ':null}')) AS es FROM a)
SELECT conv_id, CAST(i - 1 AS INTEGER) AS seq, es[i].e AS event, es[i].d AS data FROM (SELECT conv_id, es, unnest(range(1, len(es) + 1)) AS i FROM e)""")
def answer_events(spark, d):
    """What a client is sent for each document taken as an answer, the first five words as its tokens."""
    x = table(spark, d, "documents").select(
        F.col("doc_id").alias("conv_id"), F.col("doc_kind").alias("intent"), F.col("source").alias("sources"), F.slice(F.split("text", " "), 1, 5).alias("tokens"), F.col("lang").alias("critique"),
        (F.col("doc_id") % 3).cast("int").alias("verifier"), F.when(F.col("doc_id") % 9 == 0, "limit").alias("error"))
    return R.answer_events(x)


@query("sse_parse", CONV + f"SELECT conv_id, turn - 1 AS seq, {KIND} AS event, props AS data FROM m WHERE event_id % 11 <> 5")
def sse_parse(spark, d):
    """Every conversation's stream written as text, with some malformed events and an incomplete end, and read back."""
    data = F.when(F.col("event_id") % 11 == 5, F.concat(F.col("props"), F.lit("}{"))).otherwise(F.col("props"))
    frames = messages(spark, d).select("conv_id", "turn", R.sse_format(sse_kind(), data).alias("frame"))
    text = F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "frame"))), lambda x: x["frame"]), ""), F.lit("event: token\ndata: {"))
    streams = frames.groupBy("conv_id").agg(text.alias("stream"))  # a conversation is one text by its nature
    return R.sse_parse(streams, "conv_id", "stream").withColumn("seq", F.col("seq").cast("long"))


@query("event_fold", CONV + f""", e AS (SELECT conv_id, turn AS seq, {KIND} AS event, props AS data FROM m), s AS (SELECT *, coalesce(max(CASE WHEN event = 'regenerating' THEN seq END) OVER (PARTITION BY conv_id), -1) AS since FROM e)
SELECT conv_id, answer, coalesce(sources, '') AS sources, error OR limited AND answer = '' AS failed FROM (SELECT conv_id, coalesce(string_agg(CASE WHEN event = 'token' AND seq > since THEN data END, '' ORDER BY seq), '') AS answer, arg_max(CASE WHEN event = 'sources' THEN data END, CASE WHEN event = 'sources' THEN seq END) AS sources, bool_or(event = 'rate_limited') AS limited, bool_or(event = 'error') AS error FROM s GROUP BY conv_id)""")
def event_fold(spark, d):
    return R.fold_events(messages(spark, d).select("conv_id", F.col("turn").alias("seq"), sse_kind().alias("event"), F.col("props").alias("data")))


@query("probe_runs", """WITH p AS (SELECT user_id, event_type <> 'error' AS ok, row_number() OVER w AS no, CASE WHEN lag(event_type <> 'error') OVER w = (event_type <> 'error') THEN 0 ELSE 1 END AS turned FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 r AS (SELECT *, sum(turned) OVER (PARTITION BY user_id ORDER BY no) AS run FROM p) SELECT user_id, min(no) AS start_no, count(*) AS length, any_value(ok) AS ok FROM r GROUP BY user_id, run""")
def probe_runs(spark, d):
    p = events(spark, d).select("user_id", "ts", "event_id", (F.col("event_type") != "error").alias("ok"))
    return R.runs(p, "user_id", ["ts", "event_id"], "ok").withColumn("start_no", F.col("start_no").cast("long"))


@query("restarts", """WITH p AS (SELECT user_id, event_type <> 'error' AS ok, row_number() OVER w AS no, CASE WHEN lag(event_type <> 'error') OVER w = (event_type <> 'error') THEN 0 ELSE 1 END AS turned FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 r AS (SELECT *, sum(turned) OVER (PARTITION BY user_id ORDER BY no) AS run FROM p), l AS (SELECT user_id, count(*) AS length, any_value(ok) AS ok FROM r GROUP BY user_id, run)
SELECT user_id, CASE user_id % 3 WHEN 0 THEN 'server' WHEN 1 THEN 'tunnel' ELSE 'store' END AS service, CAST(sum(length // CASE WHEN user_id % 3 = 2 THEN 1 ELSE 5 END) AS BIGINT) AS restarts, max(length) AS longest FROM l WHERE NOT ok GROUP BY user_id""")
def restarts(spark, d):
    """How often each probed service was started anew: after as many failed probes in a row as its kind allows."""
    kind = F.element_at(F.array(*[F.lit(x) for x in R.PATIENCE]), (F.col("user_id") % len(R.PATIENCE) + 1).cast("int"))
    p = events(spark, d).select("user_id", "ts", "event_id", (F.col("event_type") != "error").alias("ok"))
    failed = R.runs(p, "user_id", ["ts", "event_id"], "ok").where("NOT ok").withColumn("service", kind)
    return failed.groupBy("user_id", "service").agg(F.sum(R.restarts(F.col("service"), F.col("length"))).alias("restarts"), F.max("length").alias("longest"))


@query("context_blocks", CUR + f"""SELECT id, '[' || k || '] ' || coalesce(source, '') || ' p.' || coalesce(page, 0) || ' ' || coalesce(nullif(article, ''), '-') || chr(10) || substr(t, 1, 1500) || CASE WHEN length(t) > 1500 THEN '…' ELSE '' END AS block
 FROM (SELECT *, {sql_clean('text')} AS t, row_number() OVER (PARTITION BY file ORDER BY line_no) AS k FROM cur)""")
def context_blocks(spark, d):
    w = Window.partitionBy("file").orderBy("line_no")
    x = current(spark, d).withColumn("k", F.row_number().over(w)).withColumn("t", clean_chunk(F.col("text")))
    return x.select("id", R.context_block(F.col("k"), F.col("source"), F.col("page"), F.col("article"), F.col("t")).alias("block"))


PICKED = MMR + ", top AS (SELECT p.*, collection FROM picked p JOIN cur USING (id) WHERE pick <= 20) "


def picked(spark, d):
    f = fused(spark, d)
    pool = fusion.diversify(fusion.source_filter(f).select("query_id", "id", "intent", "source", "article", "collection", "rrf", "eff"))
    return pool.where("pick <= 20")


@query("source_diversity", PICKED + "SELECT query_id, count(DISTINCT source) AS sources, count(*) - count(DISTINCT source) AS repeats FROM top WHERE source <> '' GROUP BY query_id")
def source_diversity(spark, d):
    per = picked(spark, d).where("coalesce(source, '') <> ''").groupBy("query_id", "source").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("query_id").agg(F.count(F.lit(1)).alias("sources"), F.sum(F.col("n") - 1).alias("repeats"))


@query("source_chips", PICKED + ", c AS (SELECT query_id, collection, count(*) AS n FROM top GROUP BY ALL) SELECT query_id, collection, n FROM c WHERE query_id IN (SELECT query_id FROM c GROUP BY 1 HAVING count(*) >= 2)")
def source_chips(spark, d):
    """Counts per collection of an answer's sources, where there are two collections or more."""
    c = picked(spark, d).groupBy("query_id", "collection").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("query_id"))).where("k >= 2").drop("k")


@query("issue_union", """SELECT doc_id, coalesce(CASE WHEN doc_id % 3 > 0 THEN 'missing:' || coalesce(lang, '-') || ':-' END, '') || CASE WHEN doc_id % 3 = 2 THEN ';bad_citation:' || coalesce(doc_kind, '-') || ':-' ELSE '' END
  || CASE WHEN doc_id % 3 > 0 AND doc_id % 2 = 1 THEN ';' ELSE '' END || CASE WHEN doc_id % 2 = 1 THEN 'hallucination:' || coalesce(source, '-') || ':adversarial' ELSE '' END AS issues FROM documents""")
def issue_union(spark, d):
    """The issues of a critique and of a second opinion put together, the latter marked."""
    dash = lambda c: F.coalesce(c, F.lit("-"))
    issue = lambda kind, text: F.struct(F.lit(kind).alias("type"), dash(text).alias("description"))
    k = F.col("doc_id")
    own = F.slice(F.array(issue("missing", F.col("lang")), issue("bad_citation", F.col("doc_kind"))), F.lit(1), (k % 3).cast("int"))
    second = F.slice(F.array(issue("hallucination", F.col("source"))), F.lit(1), (k % 2).cast("int"))
    x = table(spark, d, "documents").select("doc_id", merged_issues(own, second).alias("i"))
    return x.select("doc_id", F.array_join(F.transform("i", lambda i: F.concat_ws(":", i["type"], i["description"], dash(i["source"]))), ";").alias("issues"))


@query("percent_scores", "SELECT doc_id, CAST(floor(least(greatest(coalesce(declared_chars, 0) / n_chars, 0), 1) * 100 + 0.5) AS BIGINT) AS percent FROM documents WHERE n_chars > 0")
def percent_scores(spark, d):
    share = F.coalesce("declared_chars", F.lit(0)) / F.col("n_chars")
    return table(spark, d, "documents").where("n_chars > 0").select("doc_id", F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * 100 + 0.5).alias("percent"))


@query("parsed_replies", """SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'general' ELSE 'comparison' END AS intent, CASE WHEN item_id % 2 = 0 THEN 0 ELSE 2 END AS sub_queries FROM eval_items""")
def parsed_replies(spark, d):
    """Analysis replies with text around the JSON, some with an unknown intent or without lists."""
    from paperloom.models import parse_analysis

    k = F.col("item_id")
    body = F.concat(F.lit('{"intent": "'), F.when(k % 3 == 0, "chat").otherwise("comparison"), F.lit('"'), F.when(k % 2 == 0, "").otherwise(', "sub_queries": ["a", "b"]'), F.lit("}"))
    x = table(spark, d, "eval_items").select("item_id", parse_analysis(F.concat(F.lit("Here it is:\n"), body, F.lit("\nDone."))).alias("r"))
    return x.select("item_id", "r.intent", F.size("r.sub_queries").alias("sub_queries"))


@query("hashed_embeddings", r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\S+')) AS w FROM documents WHERE text IS NOT NULL),
 h AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 2) AS BIGINT) % 64 AS b, CASE WHEN CAST('0x' || substr(md5(w), 3, 1) AS BIGINT) >= 8 THEN 1 ELSE -1 END AS s FROM w),
 c AS (SELECT doc_id, b, sum(s) AS v FROM h GROUP BY ALL), u AS (SELECT doc_id, count(*) FILTER (WHERE v <> 0) > 0 AS any_ FROM c GROUP BY doc_id),
 g AS (SELECT doc_id, b FROM documents, (SELECT unnest(range(64)) AS b) WHERE text IS NOT NULL)
SELECT g.doc_id, string_agg(CASE WHEN NOT coalesce(any_, false) THEN CASE g.b WHEN 0 THEN '+' ELSE '0' END WHEN v > 0 THEN '+' WHEN v < 0 THEN '-' ELSE '0' END, '' ORDER BY g.b) AS signs, true AS unit
  FROM g LEFT JOIN c ON c.doc_id = g.doc_id AND c.b = g.b LEFT JOIN u ON u.doc_id = g.doc_id GROUP BY g.doc_id""")
def hashed_embeddings(spark, d):
    """The embedding of every document without a model: the signs of its numbers, and whether its length is 1."""
    from paperloom.models import embed

    x = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", embed(F.col("text")).alias("e"))
    sign = F.transform("e", lambda v: F.when(v > 0, "+").when(v < 0, "-").otherwise("0"))
    length = F.aggregate("e", F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    return x.select("doc_id", F.array_join(sign, "").alias("signs"), (F.abs(length - 1) < 1e-5).alias("unit"))


@query("extractive_answers", PICKED + rf""", firsts AS (SELECT query_id, pick, regexp_extract({sql_clean('text')}, '(?s)^(.*?[.!?])(\s|$)', 1) || ' (' || coalesce(nullif(cur.article, ''), '-') || ', 출처: ' || coalesce(cur.source, '') || ', p.' || coalesce(cur.page, 0) || ')' AS cited,
   regexp_extract({sql_clean('text')}, '(?s)^(.*?[.!?])(\s|$)', 1) AS s FROM top JOIN cur USING (id)),
 best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pick) AS k FROM firsts WHERE s <> '')
SELECT query_id, string_agg(cited, ' ' ORDER BY k) AS answer FROM best WHERE k <= 3 GROUP BY query_id""")
def extractive_answers(spark, d):
    from paperloom.models import extractive_answer

    x = picked(spark, d).select("query_id", "id", F.col("pick").alias("place"))
    ctx = x.join(current(spark, d, "id", "source", "page", "article", "text"), "id")
    return extractive_answer(ctx, "query_id")
