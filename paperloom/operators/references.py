"""Legal references and citations: parsing, resolving, looking up, verifying, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import config as C
from paperloom.functions import text as T
from paperloom.operators import keyed
from paperloom.session import cut


def _none(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def parse_reference(refs: DataFrame) -> DataFrame:
    """(ref_id, reference, type, category, num, year, pasal, error): the law a phrase names.

    A number and year are needed unless it is the constitution, of which a year anywhere will do. Errors: empty, type, number.
    """
    # In steps, so that each pattern is tried once for a phrase.
    x = refs.select("ref_id", "reference", T.strip(F.coalesce("reference", F.lit(""))).alias("__ref"))
    x = x.withColumns({"type": _none(F.regexp_extract("__ref", T.LAW_TYPE, 1)), "__found": F.regexp_extract("__ref", T.NUMBER_YEAR, 0)})
    x = x.withColumns({"__type": F.lower("type"), "num": _none(F.regexp_extract("__found", T.NUMBER_YEAR, 1)), "year": _none(F.right("__found", F.lit(4)))})
    x = x.withColumn("category", T.law_category(F.col("__type")))
    any_year = F.when(F.col("category") == "constitution", _none(F.regexp_extract("__ref", T.YEAR, 1)))
    error = F.when(F.col("__ref") == "", "empty").when(F.col("type").isNull(), "type").when((F.col("category") != "constitution") & F.col("num").isNull(), "number")
    return x.select(
        "ref_id", "reference", "type", "category", "num", F.coalesce("year", any_year).alias("year"),
        F.concat(F.lit("Pasal "), _none(F.regexp_extract("__ref", T.CITED_ARTICLE, 1))).alias("pasal"), error.alias("error"))


def parse_source(sources: DataFrame) -> DataFrame:
    """(source, category, type, num, year, at_start) of file names that hold ``_<number>_Tahun_<year>``; the number without leading zeros.

    Parsed once per name, so that resolving is an equi-join and no pattern is tried against every name.
    """
    hit = F.regexp_extract("source", r"(?i)_0*(\d+)_Tahun_(\d{4})", 1)
    lead = F.regexp_extract("source", r"(?i)^([A-Za-z]+)_0*\d+_Tahun_\d{4}", 1)
    return sources.where(hit != "").select(
        "source", "collection", F.lower(_none(lead)).alias("lead"), hit.alias("num"), F.regexp_extract("source", r"(?i)_0*(\d+)_Tahun_(\d{4})", 2).alias("year"))


def resolve(parsed: DataFrame, sources: DataFrame) -> DataFrame:
    """(ref_id, matched_source) of the references that name a known file.

    ``sources`` holds (source, collection), a plain collection name. A name that starts with the law's kind goes before one that only
    holds number and year; the constitution goes by year, else by any constitution. The first name in order wins.
    """
    parsed, known = cut(parsed), parse_source(sources)
    named = parsed.where(F.col("error").isNull() & (F.col("category") != "constitution")).select(
        "ref_id", F.lower("type").alias("type"), "category", F.regexp_replace("num", "^0+(?=\\d)", "").alias("n"), F.col("year").alias("y"))
    cond = (F.col("n") == F.col("num")) & (F.col("y") == F.col("year")) & (F.col("category") == F.col("collection"))
    strict = F.when(F.col("lead") == F.col("type"), 0).otherwise(1)
    hits = named.join(known, cond).select("ref_id", strict.alias("loose"), "source")
    uud = sources.where(F.col("source").rlike("(?i)UUD") & (F.col("collection") == "constitution")).select("source", F.regexp_extract_all("source", F.lit(r"\d{4}"), F.lit(0)).alias("years"))
    cons = parsed.where(F.col("error").isNull() & (F.col("category") == "constitution")).select("ref_id", F.col("year").alias("y"))
    by_year = uud.select(F.explode("years").alias("y"), "source").groupBy("y").agg(F.min("source").alias("named"))
    any_uud = uud.where(F.col("source").rlike("(?i)^UUD")).agg(F.min("source").alias("any_uud"))  # one row
    best = cons.join(by_year, "y", "left").crossJoin(F.broadcast(any_uud)).select("ref_id", F.lit(0).alias("loose"), F.coalesce("named", "any_uud").alias("source"))
    hits = hits.unionByName(best.where("source IS NOT NULL"))
    return hits.groupBy("ref_id").agg(F.min(F.struct("loose", "source")).alias("m")).select("ref_id", F.col("m.source").alias("matched_source"))


def article_lookup(requests: DataFrame, chunks: DataFrame, strict: bool = False) -> DataFrame:
    """(request_id, id, page, article, text, place): up to eight chunks of a source, of an article if one is asked.

    ``requests`` holds (request_id, source, pasal), ``chunks`` (id, source, page, idx, article, text). At most the first 200 chunks
    of the source are looked at, in page order. An article fits if it is equal or starts so ('Pasal 7' also finds 'Pasal 71'),
    with ``strict`` only if equal.
    """
    r = requests.select("request_id", F.col("source").alias("__s"), "pasal")
    # Sources are cut to their first chunks before they meet the requests, without text, which is fetched for the few that are given.
    asked = chunks.select("id", "source", "page", "idx", "article").join(r.select("__s").distinct(), F.col("source") == F.col("__s"), "left_semi")
    first = keyed.top_rows(asked, "source", [F.asc("page"), F.asc("idx"), F.asc("id")], C.TOOL_SCAN, rank="k")
    rows = first.join(r, F.col("source") == F.col("__s"))
    art = F.trim(F.coalesce("article", F.lit("")))
    fits = (art == F.col("pasal")) if strict else (art != "") & art.startswith(F.col("pasal"))
    rows = rows.where(F.col("pasal").isNull() | fits).withColumn("place", F.row_number().over(Window.partitionBy("request_id").orderBy("k")).cast("long"))
    rows = rows.where(F.col("place") <= C.TOOL_CHUNKS).select("request_id", F.col("id").alias("__id"), F.col("source").alias("__source"), "place")
    same = (F.col("id") == F.col("__id")) & (F.col("source") == F.col("__source"))
    return rows.join(chunks.select("id", "source", "page", "article", "text"), same).select(
        "request_id", "id", F.coalesce("page", F.lit(0)).alias("page"), "article", F.substring(T.clean_chunk(F.col("text")), 1, C.TOOL_CHARS).alias("text"), "place")


def citations(answers: DataFrame) -> DataFrame:
    """(answer_id, pos, raw, pasal, source, page): the citations in a text, in order from 0. ``answers`` holds (answer_id, answer)."""
    part = lambda g: F.regexp_extract_all("answer", F.lit(T.CITATION), F.lit(g))
    z = answers.select("answer_id", F.posexplode(F.arrays_zip(part(0).alias("raw"), part(1).alias("pasal"), part(2).alias("source"), part(3).alias("page"))).alias("pos", "c"))
    return z.select("answer_id", "pos", "c.raw", T.strip(F.col("c.pasal")).alias("pasal"), T.strip(F.col("c.source")).alias("source"), F.col("c.page").try_cast("int").alias("page"))


def verify(cites: DataFrame, retrieved: DataFrame) -> DataFrame:
    """The citations with status and reason, against what was retrieved for their answer.

    ``retrieved`` holds (answer_id, pos, source, page, article, text). A source fits by name in any case, else the first retrieved
    source that holds the cited name or is held in it. The article fits if a row of that source has it or starts so; else if it
    stands as a word in the text of a row of exactly that name, the first such row, whose page then counts too. Pages
    that are missing or 0 fit none.
    """
    key = lambda c: F.lower(T.strip(F.coalesce(c, F.lit(""))))
    c = cites.withColumn("src", key(F.col("source"))).withColumn("art", T.strip(F.regexp_replace("pasal", r"(?i)\s+ayat.*", "")))
    r = retrieved.where(key(F.col("source")) != "").select(
        F.col("answer_id").alias("__a"), F.col("pos").alias("__p"), key(F.col("source")).alias("key"), F.nullif("page", F.lit(0)).alias("__page"),
        T.strip(F.coalesce("article", F.lit(""))).alias("__art"), "text")
    ids = ["answer_id", "pos"]
    per = r.groupBy("__a", "key").agg(F.min("__p").alias("first"))
    near = c.join(per, (F.col("answer_id") == F.col("__a")) & ((F.col("src") == F.col("key")) | F.col("key").contains(F.col("src")) | F.col("src").contains(F.col("key"))))
    chosen = near.groupBy(*ids).agg(F.min(F.struct((F.col("src") != F.col("key")).alias("fuzzy"), "first", "key")).alias("m")).select(*ids, F.col("m.key").alias("found"))
    c = c.join(chosen, ids, "left")
    body = F.regexp_like(F.lower("text"), F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.lower("art"), F.lit(r"\E(?![\p{L}\p{N}_])")))
    rows = c.join(r, (F.col("answer_id") == F.col("__a")) & (F.col("found") == F.col("key")))
    seen = rows.groupBy(*ids).agg(
        F.bool_or((F.col("__art") == F.col("art")) | F.col("__art").startswith(F.col("art"))).alias("art_ok"),
        F.bool_or(F.coalesce(F.col("__page") == F.col("page"), F.lit(False))).alias("page_ok"),
        F.min(F.when((F.col("key") == F.col("src")) & F.coalesce(body, F.lit(False)), F.struct("__p", "__page"))).alias("body"))
    out = c.join(seen, ids, "left")
    via_body = ~F.col("art_ok") & F.col("body").isNotNull()
    art_ok = F.col("art_ok") | via_body
    page_ok = F.col("page_ok") | (via_body & F.coalesce(F.col("body.__page") == F.col("page"), F.lit(False)))
    status = F.when(F.col("found").isNull(), "unverified").when(art_ok & page_ok, "verified").when(art_ok, "page_mismatch").otherwise("article_mismatch")
    reason = F.when(F.col("found").isNull(), "source_not_in_context").when(status == "verified", F.when(via_body, "body_fallback").otherwise("ok")).otherwise(status)
    return out.select(*ids, "raw", "pasal", "source", "page", status.alias("status"), reason.alias("reason"))


#: An article as a citation names it, standing alone in lower-cased text.
NAMED = r"(?<![\p{L}\p{N}_])pasal\s+[a-z0-9]+(?![\p{L}\p{N}_])"


def verify_in_sources(cites: DataFrame, chunks: DataFrame) -> DataFrame:
    """As :func:`verify`, for citations whose context is every chunk of the source that they name exactly; others are left out.

    ``chunks`` holds (pos, source, page, article, text). Each chunk is looked at once, whoever cites it: a source becomes the sets of its articles, of its
    pages and of the articles named in its text, with the first chunk for each, and citations meet these by equality. An article that only
    begins as the cited one does is found by its beginnings, which are few.
    """
    key = lambda c: F.lower(T.strip(F.coalesce(c, F.lit(""))))
    ids = ["answer_id", "pos"]
    c = cites.withColumn("src", key(F.col("source"))).withColumn("art", T.strip(F.regexp_replace("pasal", r"(?i)\s+ayat.*", "")))
    r = chunks.select(key(F.col("source")).alias("key"), F.col("pos").alias("__p"), F.nullif("page", F.lit(0)).alias("__page"), T.strip(F.coalesce("article", F.lit(""))).alias("__art"), "text").where("key <> ''")
    asked = c.select(F.col("src").alias("key")).distinct()
    r = r.join(asked, "key", "left_semi")
    known = r.select("key").distinct().withColumn("found", F.lit(True))
    starts = F.transform(F.sequence(F.lit(1), F.length("__art")), lambda n: F.substring(F.col("__art"), F.lit(1), n))
    arts = r.where("__art <> ''").select("key", "__art").distinct().select("key", F.explode(starts).alias("art")).distinct().withColumn("art_ok", F.lit(True))
    pages = r.where("__page IS NOT NULL").select("key", F.col("__page").alias("page")).distinct().withColumn("page_ok", F.lit(True))
    named = r.select("key", "__p", "__page", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(NAMED), F.lit(0)))).alias("low"))
    named = named.groupBy("key", "low").agg(F.min(F.struct("__p", "__page")).alias("body"))
    c = c.withColumn("key", F.col("src")).withColumn("low", F.lower("art"))
    out = c.join(known, "key").join(arts, ["key", "art"], "left").join(pages, ["key", "page"], "left").join(named, ["key", "low"], "left")
    no = lambda x: F.coalesce(x, F.lit(False))
    via_body = ~no(F.col("art_ok")) & F.col("body").isNotNull()
    art_ok = no(F.col("art_ok")) | via_body
    page_ok = no(F.col("page_ok")) | (via_body & no(F.col("body.__page") == F.col("page")))
    status = F.when(art_ok & page_ok, "verified").when(art_ok, "page_mismatch").otherwise("article_mismatch")
    reason = F.when(status == "verified", F.when(via_body, "body_fallback").otherwise("ok")).otherwise(status)
    return out.select(*ids, "raw", "pasal", "source", "page", status.alias("status"), reason.alias("reason"))


def citation_totals(verified: DataFrame) -> DataFrame:
    """(answer_id, total, verified, unverified); everything that isn't verified counts as unverified."""
    ok = F.count_if(F.col("status") == "verified")
    return verified.groupBy("answer_id").agg(F.count(F.lit(1)).alias("total"), ok.alias("verified"), (F.count(F.lit(1)) - ok).alias("unverified"))


# Kinds of issues that call for another try by themselves, and the order of confidence.
SERIOUS = ("hallucination", "bad_citation")
CONFIDENCE = {"high": 3, "medium": 2, "low": 1, "unknown": 0}


def retry(confidence: Column, issues: Column, unverified: Column, max_retries: int = 1) -> tuple[Column, Column]:
    """(retry, reason) from a critique and the count of unverified citations. ``issues`` is an array of structs with a type."""
    serious = F.size(F.filter(F.coalesce(issues, F.array().cast("array<struct<type:string,description:string>>")), lambda x: x["type"].isin(*SERIOUS)))
    n = F.greatest(F.size(issues), F.lit(0))
    reason = (
        F.when(F.lit(max_retries <= 0), "disabled").when(unverified >= 2, F.concat(F.lit("verifier_unverified="), unverified))
        .when(confidence == "low", "confidence=low").when(serious > 0, F.concat(F.lit("serious_issues="), serious))
        .when((confidence == "medium") & (n >= 2), F.concat(F.lit("medium+issues="), n)).otherwise("ok"))
    return ~reason.isin("ok", "disabled"), reason


def needs_second_opinion(confidence: Column, n_issues: Column, unverified: Column) -> Column:
    """Low confidence, medium with an issue, or any citation that isn't verified."""
    return (confidence == "low") | ((confidence == "medium") & (n_issues >= 1)) | (F.coalesce(unverified, F.lit(0)) >= 1)


def merged_issues(own: Column, second: Column) -> Column:
    """The issues (type, description) of a critique and of a second opinion, with ``source``: null, or 'adversarial' for the latter."""
    marked = lambda xs, s: F.transform(xs, lambda x: F.struct(x["type"].alias("type"), x["description"].alias("description"), F.lit(s).cast("string").alias("source")))
    return F.concat(marked(own, None), marked(second, "adversarial"))


def merged_confidence(first: Column, second: Column) -> Column:
    """The lower of two; an unknown first gives way to the second, an unknown second ranks lowest."""
    rank = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    r = lambda c: F.coalesce(F.try_element_at(rank, c), F.lit(0))
    return F.when(r(first) == 0, second).when(r(second) < r(first), second).otherwise(first)


def retry_message(question: Column, context: Column, answer: Column, issues: Column, failed: Column) -> Column:
    """The text of another try: failed citations first, the last of them on top, then the critique's issues, all numbered."""
    lines = F.concat(F.reverse(F.transform(failed, lambda x: F.concat(F.lit("citation "), x["raw"], F.lit(": "), x["status"]))),
                     F.transform(issues, lambda x: F.concat(x["type"], F.lit(": "), x["description"])))
    numbered = F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return F.concat(F.lit("Question:\n"), question, F.lit("\n\nContext:\n"), context, F.lit("\n\nEarlier answer:\n"), answer, F.lit("\n\nPut right:\n"), F.array_join(numbered, "\n"))
