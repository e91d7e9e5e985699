"""Operational reports: costs, histories, conversations, event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import config as C


def daily_totals(rows: DataFrame, day: Column, amount: Column) -> DataFrame:
    """(day, amount) with a TOTAL row, days as text."""
    return rows.select(F.date_format(day, "yyyy-MM-dd").alias("day"), amount.alias("a")).rollup("day").agg(F.round(F.sum("a"), 6).alias("amount")).withColumn(
        "day", F.coalesce("day", F.lit("TOTAL")))


def breakdown(rows: DataFrame, label: Column, amount: Column) -> DataFrame:
    """(label, amount, share in per cent) of labels with a positive amount."""
    by = rows.groupBy(label.alias("label")).agg(F.round(F.sum(amount), 6).alias("amount")).where("amount > 0")
    total = by.agg(F.sum("amount").alias("total"))  # one row
    return by.crossJoin(F.broadcast(total)).select("label", "amount", F.round(F.col("amount") * 100 / F.col("total"), 4).alias("share"))


def share_bars(counts: DataFrame, name: str) -> DataFrame:
    """(name, n, bar): the rounded share of the total in per cent, at least 1."""
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(name, "n", F.greatest(F.lit(1), F.floor(F.col("n") * 100 / F.col("total") + 0.5)).cast("long").alias("bar"))


def history_matches(rows: DataFrame, needle: str, columns: list[str], starred: Column | None = None) -> DataFrame:
    """Rows that hold ``needle`` in any case in one of the columns, of the starred ones if so asked."""
    text = F.lower(F.concat_ws(" ", *columns))
    cond = text.contains(needle.lower())
    return rows.where(cond & starred if starred is not None else cond)


def history_order(mode: str) -> list[Column]:
    """latest, oldest, fastest (missing last), slowest (missing as 0)."""
    return {"latest": [F.desc_nulls_last("ts"), F.asc("id")], "oldest": [F.asc_nulls_last("ts"), F.asc("id")], "fastest": [F.asc_nulls_last("elapsed"), F.asc("id")],
            "slowest": [F.desc(F.coalesce("elapsed", F.lit(0))), F.asc("id")]}[mode]


def collection_order(name: Column, n: Column, mode: str) -> list[Column]:
    """most, least, alpha, or by legal rank with unknown collections last."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in C.COLLECTIONS]), name), F.lit(0)), F.lit(999))
    return {"most": [F.desc(n), F.asc(name)], "least": [F.asc(n), F.asc(name)], "alpha": [F.asc(name)], "rank": [F.asc(place), F.asc(name)]}[mode]


def last_messages(messages: DataFrame, most: int = C.HISTORY_MESSAGES) -> DataFrame:
    """The last messages of each conversation (conv_id, turn, role); where some were dropped, a leading answer goes too."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = messages.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most + 1)
    n = F.max("k").over(Window.partitionBy("conv_id"))
    kept = kept.withColumn("over", n > most).where(F.col("k") <= most)
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return kept.withColumn("first", first).where(~(F.col("over") & (F.col("first") == 1) & (F.col("role") == "assistant"))).drop("k", "over", "first")


def sse_format(event: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


#: The events of an answer in their order; tokens come between the sources and the critique.
EVENTS = ("conversation", "retrieving", "intent", "sources", "token", "critique", "verifier", "done")


def answer_events(answers: DataFrame) -> DataFrame:
    """(conv_id, seq, event, data): what a client is sent while an answer is made, from (conv_id, intent, sources, tokens, critique, verifier, error).

    An answer that failed ends with ``error`` in place of critique, verifier and done. Data are JSON; parts that are null are left out, ``seq`` counts from 0 without gaps.
    """
    event = lambda name, data: F.struct(F.lit(name).alias("event"), data.alias("data"))
    obj = lambda name, c: F.when(F.col(c).isNotNull(), F.to_json(F.struct(F.col(c).alias(name))))
    head = F.array(event("conversation", F.to_json(F.struct("conv_id"))), event("retrieving", F.lit("{}")), event("intent", obj("intent", "intent")), event("sources", obj("sources", "sources")))
    tokens = F.transform(F.coalesce("tokens", F.array().cast("array<string>")), lambda t: F.struct(F.lit("token").alias("event"), F.to_json(F.struct(t.alias("text"))).alias("data")))
    good = F.array(event("critique", obj("confidence", "critique")), event("verifier", obj("unverified", "verifier")), event("done", F.lit("{}")))
    tail = F.when(F.col("error").isNotNull(), F.array(event("error", obj("message", "error")))).otherwise(good)
    every = F.filter(F.concat(head, tokens, tail), lambda e: e["data"].isNotNull())
    return answers.select("conv_id", F.posexplode(every).alias("seq", "e")).select("conv_id", "seq", "e.event", "e.data")


def sse_parse(streams: DataFrame, key: str, text: str) -> DataFrame:
    """(key, seq, event, data): the complete, well-formed events of a stream; what follows the last blank line is not one."""
    frames = F.split(text, "\n\n", -1)
    whole = F.slice(frames, F.lit(1), F.greatest(F.size(frames) - 1, F.lit(0)))
    x = streams.select(key, F.posexplode(whole).alias("seq", "frame"))
    event, data = F.regexp_extract("frame", r"(?m)^event: (.*)$", 1), F.regexp_extract("frame", r"(?m)^data: (.*)$", 1)
    # In brackets, as the parser overlooks what stands behind a value.
    whole = F.try_parse_json("data").isNotNull() & (F.json_array_length(F.concat(F.lit("["), "data", F.lit("]"))) == 1)
    return x.select(key, "seq", event.alias("event"), data.alias("data")).where((F.col("event") != "") & whole)


def fold_events(events: DataFrame) -> DataFrame:
    """One record per conversation from (conv_id, seq, event, data): tokens since the last regeneration in order, the last sources,
    and whether it failed: an error, or a rate limit with no text."""
    w = Window.partitionBy("conv_id")
    e = events.withColumn("since", F.coalesce(F.max(F.when(F.col("event") == "regenerating", F.col("seq"))).over(w), F.lit(-1)))
    token = F.when((F.col("event") == "token") & (F.col("seq") > F.col("since")), F.struct("seq", "data"))
    folded = e.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(token)).alias("tokens"), F.max_by("data", F.when(F.col("event") == "sources", F.col("seq"))).alias("sources"),
        F.bool_or(F.col("event") == "error").alias("error"), F.bool_or(F.col("event") == "rate_limited").alias("limited"))
    answer = F.array_join(F.transform("tokens", lambda x: x["data"]), "")
    return folded.select("conv_id", answer.alias("answer"), F.coalesce("sources", F.lit("")).alias("sources"), (F.col("error") | (F.col("limited") & (answer == ""))).alias("failed"))


def runs(rows: DataFrame, key: str, order: list[str], ok: str) -> DataFrame:
    """(key, start_no, length, ok): runs of equal ``ok`` in order, per key."""
    w = Window.partitionBy(key).orderBy(*order)
    r = rows.withColumn("no", F.row_number().over(w)).withColumn("turned", F.coalesce((F.lag(ok).over(w) != F.col(ok)).cast("int"), F.lit(1)))
    r = r.withColumn("run", F.sum("turned").over(w))
    return r.groupBy(key, "run").agg(F.min("no").alias("start_no"), F.count(F.lit(1)).alias("length"), F.first(ok).alias("ok")).drop("run")


# Failed probes in a row after which a service of each kind is started anew.
PATIENCE = {"server": 5, "tunnel": 5, "store": 1}


def restarts(service: Column, failed: Column) -> Column:
    """How often a service was started anew during a run of failed probes: counting begins again with each start."""
    patience = F.create_map(*[F.lit(x) for kv in PATIENCE.items() for x in kv])
    return F.floor(failed / F.try_element_at(patience, service)).cast("long")


def history_items(kept: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, id, a): the items of each kept history, a JSON array; text that is none gives no items."""
    whole = F.when(F.try_parse_json(text).isNotNull(), F.col(text))
    items = F.from_json(whole, "array<struct<id: bigint, a: string>>")
    return kept.select(key, F.posexplode(items).alias("place", "item")).select(key, "place", "item.*")


def markdown_item(no: Column, title: Column, scope: Column, sources: Column, elapsed: Column) -> Column:
    return F.concat(F.lit("## "), no, F.lit(". "), title, F.lit("\n\n- scope: "), scope, F.lit("\n- sources: "), sources, F.lit("\n- time: "), elapsed, F.lit(" ms\n"))


def context_block(no: Column, source: Column, page: Column, article: Column, text: Column) -> Column:
    """A labelled block of a prompt: at most 1,500 characters of text, an ellipsis if there was more, '-' for no article."""
    cut = F.concat(F.substring(text, 1, C.CONTEXT_CHARS), F.when(F.length(text) > C.CONTEXT_CHARS, F.lit("…")).otherwise(F.lit("")))
    return F.concat(F.lit("["), no, F.lit("] "), F.coalesce(source, F.lit("")), F.lit(" p."), F.coalesce(page, F.lit(0)), F.lit(" "), F.coalesce(F.nullif(article, F.lit("")), F.lit("-")), F.lit("\n"), cut)
