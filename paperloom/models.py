"""Places where models plug in, each with the deterministic fallback used without one."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from paperloom import config as C
from paperloom.functions.text import clean_chunk, tokens


class Embedder(Protocol):
    """Texts to normalised vectors, in batches; loaded once per worker."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Scorer(Protocol):
    """A relevance score for every (question, text)."""

    def __call__(self, questions: list[str], texts: list[str]) -> np.ndarray: ...


class Completer(Protocol):
    """A prompt to text: question analysis, reranking, answering and critique all ask so."""

    def __call__(self, prompt: str) -> str: ...


def hashed_embedder(dim: int = 64) -> Embedder:
    """Normalised counts of hashed words with a sign, of up to 256 dimensions; a text without words, or of which all cancel, gets the first unit vector."""

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\S+", (t or "").lower(), re.A):
                h = hashlib.md5(w.encode(), usedforsecurity=False).digest()
                out[i, h[0] % dim] += 1 if h[1] >> 7 else -1
            if not out[i].any():
                out[i, 0] = 1
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    return run


def embed(text: Column, make=hashed_embedder) -> Column:
    """The embedding of a text column; ``make`` is called once per task and gives the embedder."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for b in batches:
            yield pd.Series(list(model(b.fillna("").tolist())))

    return run(text)


def cross_score(question: Column, text: Column, scorer: Scorer) -> Column:
    @F.pandas_udf("double")
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(scorer(q.fillna("").tolist(), t.fillna("").tolist()), dtype=float))

    return run(question, text)


def fallback_analysis(questions: DataFrame) -> DataFrame:
    """What a failed analysis gives: a general intent and nothing else."""
    empty = F.array().cast("array<string>")
    return questions.select("query_id", "text", F.lit("general").alias("intent"), empty.alias("sub_queries"), empty.alias("id_keywords"), empty.alias("hyde"), empty.alias("category_filter"))


def parse_analysis(reply: Column) -> Column:
    """A model's reply as a struct: the text from its first to its last brace, read as JSON; an unknown intent becomes general."""
    schema = "intent string, sub_queries array<string>, id_keywords array<string>, hyde array<string>, category_filter array<string>"
    parsed = F.from_json(json_part(reply), schema)
    none = F.array().cast("array<string>")
    intent = F.when(parsed["intent"].isin(*C.STRATEGIES), parsed["intent"]).otherwise("general")
    return F.struct(intent.alias("intent"), *[F.coalesce(parsed[c], none).alias(c) for c in ("sub_queries", "id_keywords", "hyde", "category_filter")])


def expand(analysis: DataFrame, key: str) -> DataFrame:
    """(key, label, query, place): the question, up to four sub-queries, the joined keywords, up to three hypothetical answers.

    Blank entries are dropped (their numbers stay), and ten queries are kept.
    """
    def numbered(c: str, label: str, most: int, base: int) -> DataFrame:
        x = analysis.select(key, F.posexplode(F.slice(c, 1, most)).alias("i", "query"))
        return x.select(key, (F.col("i") + base + 1).alias("k"), F.concat(F.lit(label + "_"), F.col("i") + 1).alias("label"), "query")

    every = (
        analysis.select(key, F.lit(0).alias("k"), F.lit("original").alias("label"), F.col("text").alias("query"))
        .unionByName(numbered("sub_queries", "sub", C.MAX_SUB_QUERIES, 0))
        .unionByName(analysis.select(key, F.lit(C.MAX_SUB_QUERIES + 1).alias("k"), F.lit("id_keywords").alias("label"), F.array_join("id_keywords", " ").alias("query")))
        .unionByName(numbered("hyde", "hyde", C.MAX_HYPOTHESES, C.MAX_SUB_QUERIES + 1)))
    w = Window.partitionBy(key).orderBy("k")
    return every.where(F.trim("query") != "").withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= C.MAX_QUERIES).select(key, "label", "query", "place")


def complete(prompt: Column, completer: Completer) -> Column:
    """The reply to every prompt; null where the model fails, so that one failure ends no job."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        def one(p):
            try:
                return None if p is None else completer(p)
            except Exception:  # noqa: BLE001 - a model may raise anything
                return None

        return prompts.map(one)

    return run(prompt)


def json_part(reply: Column) -> Column:
    """The text from a reply's first to its last brace."""
    return F.regexp_extract(reply, r"(?s)\{.*\}", 0)


def critique(answers: DataFrame, completer: Completer) -> DataFrame:
    """``answers`` (question, context, answer and others) with a model's verdict: confidence, verified_citations_count, issues (type, description), summary.

    Blank answers aren't asked for. Where there is no answer to review, the call fails or its reply has no JSON, the verdict is unknown without issues, and
    the summary says why. Contexts are cut at 30,000 characters, answers at 8,000.
    """
    issue = "array<struct<type: string, description: string>>"
    blank = F.regexp_replace(F.coalesce("answer", F.lit("")), r"\s", "") == ""
    prompt = F.concat(F.lit("Question:\n"), F.coalesce("question", F.lit("")), F.lit("\n\nContext:\n"), F.left(F.coalesce("context", F.lit("")), F.lit(30_000)),
                      F.when(F.length("context") > 30_000, "…[truncated]").otherwise(""), F.lit("\n\nAnswer:\n"), F.left("answer", F.lit(8_000)))
    x = answers.withColumn("__blank", blank).withColumn("__reply", complete(F.when(~blank, prompt), completer))
    got = F.from_json(json_part(F.col("__reply")), f"confidence string, verified_citations_count int, issues {issue}, summary string")
    x = x.withColumn("__v", got)
    ok = F.col("__v").isNotNull() & (json_part(F.col("__reply")) != "")
    why = F.when(F.col("__blank"), "not run").when(F.col("__reply").isNull(), "call failed").otherwise("no JSON")
    return x.select(
        *answers.columns, F.when(ok, F.coalesce("__v.confidence", F.lit("unknown"))).otherwise("unknown").alias("confidence"),
        F.when(ok, F.coalesce("__v.verified_citations_count", F.lit(0))).otherwise(0).alias("verified_citations_count"),
        F.when(ok, F.coalesce("__v.issues", F.array().cast(issue))).otherwise(F.array().cast(issue)).alias("issues"),
        F.when(ok, F.left(F.coalesce("__v.summary", F.lit("")), F.lit(400))).otherwise(why).alias("summary"))


def rerank_scores(pool: DataFrame, completer: Completer) -> DataFrame:
    """(query_id, id, score, reason) that a model gives to the rows of each query's pool, asked once for all of them.

    ``pool`` holds (query_id, question, idx, id, block): the rows numbered from 0 in the pool's order, at most some dozens. Entries without a number or
    score are dropped, of repeated ones the last counts; a reply that can't be read gives none.
    """
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "block"))), lambda x: F.concat(F.lit("["), x["idx"], F.lit("] "), x["block"])), "\n\n")
    prompt = pool.groupBy("query_id").agg(F.concat(F.lit("Question:\n"), F.max("question"), F.lit("\n\n"), text).alias("prompt"))
    reply = F.from_json(json_part(complete(F.col("prompt"), completer)), "scores array<struct<idx: int, score: double, reason: string>>")
    given = prompt.select("query_id", F.posexplode(reply["scores"]).alias("n", "s")).where("s.idx IS NOT NULL AND s.score IS NOT NULL")
    last = given.groupBy("query_id", "s.idx").agg(F.max_by("s", "n").alias("s"))
    return last.select("query_id", "idx", "s.score", F.left("s.reason", F.lit(200)).alias("reason")).join(pool.select("query_id", "idx", "id"), ["query_id", "idx"]).drop("idx")


def extractive_answer(context: DataFrame, key: str, sentences: int = 3) -> DataFrame:
    """(key, answer): without a model, the first sentence of each of the best chunks, with its citation."""
    first = F.regexp_extract(clean_chunk(F.col("text")), r"(?s)^(.*?[.!?])(\s|$)", 1)
    cite = F.concat(first, F.lit(" ("), F.coalesce(F.nullif("article", F.lit("")), F.lit("-")), F.lit(", 출처: "), F.coalesce("source", F.lit("")), F.lit(", p."), F.coalesce("page", F.lit(0)), F.lit(")"))
    w = Window.partitionBy(key).orderBy("place")
    return context.withColumn("cited", cite).where(first != "").withColumn("k", F.row_number().over(w)).where(F.col("k") <= sentences).groupBy(key).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "cited"))), lambda x: x["cited"]), " ").alias("answer"))


def overlap_scorer(questions: list[str], texts: list[str]) -> np.ndarray:
    """A scorer without a model: the share of a question's words that the text has, to nine places."""
    words = lambda x: set(re.findall(r"\S+", x.lower(), re.A))
    out = []
    for q, t in zip(questions, texts):
        a = words(q)
        out.append(round(len(a & words(t)) / len(a), 9) if a else 0.0)
    return np.array(out)


__all__ = ["Completer", "Embedder", "Scorer", "complete", "cross_score", "embed", "expand", "extractive_answer", "fallback_analysis", "hashed_embedder", "json_part", "overlap_scorer", "parse_analysis", "rerank_scores", "tokens"]
