"""Cutting oversized texts at natural boundaries (problem 2).

The boundaries of a text are collected once into sorted offset arrays, one for each kind: article
headings, paragraphs, sentences, blanks. A piece ends at the last boundary under the limit, found by
binary search, the strongest kind first; where none is left the cut is hard. Within one article the
next piece steps back by the overlap. Limit and overlap are counted in characters, UTF-8 bytes or the tokens of a tokenizer
(``unit``): prefix sums over the character offsets say how many of them stand before each, and are searched for the
furthest offset that is in reach.

An article always opens a piece, so that each piece belongs to one article.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blanks within a line, among them the invisible ones that extraction leaves.
BLANK = "[^\\S\\n]|[\u200b\u200c\u200d\u2060\ufeff]"

HEADING = re.compile(
    rf"(?im)^(?:{BLANK})*pasal(?:{BLANK})+(\d+)([a-z]?)(?:{BLANK})*"
    rf"(?=$|\.(?:{BLANK})*$|[-‐-―−](?:{BLANK})*\S|\(1\))"
)
PARAGRAPH = re.compile(r"\n\s*\n|\n(?=\s*\(\d+\))")
LINE = re.compile(r"\n")
SENTENCE = re.compile(r"[.!?。][\"'”)]?\s+")
SPACE = re.compile(r"\s+")

PIECES = "piece_no int, article string, opens_article boolean, start int, stop int, overlap int, piece string"


def headings(text: str) -> list[tuple[int, str]]:
    """Offset of the line and name of every article heading."""
    return [(m.start(), f"Pasal {m[1]}{m[2].upper()}") for m in HEADING.finditer(text)]


#: The offsets at which the units of a text begin, in order.
Unit = Callable[[str], Sequence[int]]


def token_unit(path: str) -> Unit:
    """The tokens of the tokenizer in the file ``path`` (of the ``tokenizers`` library), loaded once per worker."""
    return lambda text: [a for a, b in _tokenizer(path).encode(text, add_special_tokens=False).offsets if a < b]


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def prefix_sums(text: str, unit: str | Unit) -> Sequence[int]:
    """How many units begin before each character offset, up to the text's length."""
    if unit == "chars":
        return range(len(text) + 1)
    if unit == "bytes":
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        return [0, *np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).tolist()]
    return [0, *np.cumsum(np.bincount(np.asarray(unit(text), dtype=np.int64), minlength=len(text))[: len(text)]).tolist()]


def cuts(sums: Sequence[int], start: int, stop: int, limit: int, overlap: int, marks: list[list[int]]) -> list[int]:
    """End offsets of the pieces of a text's part from ``start`` to ``stop``; a piece after the first holds ``overlap`` more before it.

    ``sums`` are the text's prefix sums, ``marks`` sorted offsets where it may be cut, the best kind first.
    """
    ends: list[int] = []
    at, room = start, limit
    while sums[stop] - sums[at] > room:
        far = max(at + 1, min(bisect_right(sums, sums[at] + room) - 1, stop))
        half = bisect_left(sums, sums[at] + room // 2)
        best = 0
        for floor in (half, at):  # first a well-filled piece, then any
            for kind in marks:
                k = bisect_right(kind, far) - 1
                if k >= 0 and kind[k] > floor:
                    best = kind[k]
                    break
            if best:
                break
        at = best or far
        ends.append(at)
        room = limit - min(overlap, sums[at] - sums[start])
    ends.append(stop)
    return ends


def split_text(text: str, article: str | None, limit: int, overlap: int, unit: str | Unit = "chars") -> Iterator[tuple]:
    """Pieces of one text as (piece_no, article, opens_article, start, stop, overlap, piece).

    ``start`` and ``stop`` bound the piece without its overlap; these spans tile the text. What stands
    before the first heading belongs to ``article``, the one the text came with. Offsets count characters in any unit; a
    piece of one character may be over a limit that is less than its units.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    heads = headings(text)
    parts = [(0, article, False)] if not heads or heads[0][0] > 0 else []
    if parts and heads and not text[: heads[0][0]].strip():  # blanks alone go with the first article
        parts, heads = [], [(0, heads[0][1]), *heads[1:]]
    parts += [(o, a, True) for o, a in heads]
    marks = [[m.end() for m in rx.finditer(text)] for rx in (PARAGRAPH, LINE, SENTENCE, SPACE)]
    marks[1] = sorted({*marks[0], *marks[1]})
    sums = prefix_sums(text, unit)
    no = 0
    for k, (start, name, opens) in enumerate(parts):
        stop = parts[k + 1][0] if k + 1 < len(parts) else len(text)
        at = start
        for end in cuts(sums, start, stop, limit, overlap, marks):
            back = max(start, bisect_left(sums, sums[at] - overlap))
            yield no, name, opens and at == start, at, end, at - back, text[back:end]
            at, no = end, no + 1


def split_oversized(df: DataFrame, text: str = "text", article: str = "article", limit: int = 1800, overlap: int = 180,
                    keep: tuple[str, ...] = ("id",), unit: str | Unit = "chars") -> DataFrame:
    """One row per piece of every text: the ``keep`` columns and ``PIECES``.

    Texts within the limit stay one piece and never leave the JVM; where the unit is a tokenizer's those with at most ``limit`` bytes
    do, a token has one at least. Null texts give no piece, an empty
    text gives one empty piece. Piece columns replace kept columns of the same name. ``piece`` has at most
    ``limit`` units, up to ``overlap`` of them from the piece before within one article. Only a long text's
    own task holds it: work per text is linear in its length.
    """
    names = [c for c in keep if c not in {x.split()[0] for x in PIECES.split(", ")}]
    src = df.where(F.col(text).isNotNull()).select(*names, F.col(article).alias("__article"), F.col(text).alias("__text"))
    size = F.length("__text") if unit == "chars" else F.octet_length("__text")
    small = src.where(size <= limit).select(
        *names, F.lit(0).alias("piece_no"), F.col("__article").alias("article"), F.lit(False).alias("opens_article"),
        F.lit(0).alias("start"), F.length("__text").alias("stop"), F.lit(0).alias("overlap"), F.col("__text").alias("piece"))
    return small.unionByName(_split_long(src.where(size > limit), names, limit, overlap, unit))


def _split_long(src: DataFrame, names: list[str], limit: int, overlap: int, unit: str | Unit) -> DataFrame:
    fields = [f for f in src.schema.fields if f.name in names]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        new = [x.split()[0] for x in PIECES.split(", ")]
        for b in batches:
            rows = [(*k, *p) for *k, a, t in b[[*names, "__article", "__text"]].itertuples(index=False, name=None)
                    for p in split_text(t, a, limit, overlap, unit)]
            yield pd.DataFrame(rows, columns=[*names, *new])

    return src.mapInPandas(run, schema=f"{kept}, {PIECES}")


def split_long(df: DataFrame, text: Column | str = "text", article: str = "article", limit: int = 1800, overlap: int = 180,
               keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """As :func:`split_oversized`, for the texts over the limit, in characters, alone."""
    src = df.where(F.length(text) > limit).select(*keep, F.col(article).alias("__article"), F.col(text).alias("__text"))
    return _split_long(src, list(keep), limit, overlap, "chars")


def rebuilt(pieces: DataFrame, key: str = "id", limit: int = 1800, overlap: int = 180) -> DataFrame:
    """(key, sha256, within, tiled, lapped): each text put together again from its pieces, hashed; whether every piece is within the limit, is the text from its
    start less its overlap to its stop, and holds the overlap that is due: all of it, or what its article has before it. In characters."""
    p = F.sort_array(F.collect_set(F.struct("piece_no", "start", "stop", "overlap", "opens_article", "piece")))  # a text's pieces
    x = pieces.groupBy(key).agg(p.alias("p"))
    x = x.withColumn("text", F.array_join(F.transform("p", lambda q: F.substring(q["piece"], q["overlap"] + 1, F.length(q["piece"]))), ""))
    begun = lambda q: F.array_max(F.transform(F.filter("p", lambda o: (o["start"] <= q["start"]) & ((o["overlap"] == 0) | o["opens_article"])), lambda o: o["start"]))
    return x.select(
        key, F.sha2("text", 256).alias("sha256"), F.forall("p", lambda q: F.length(q["piece"]) <= limit).alias("within"),
        F.forall("p", lambda q: F.substring("text", q["start"] - q["overlap"] + 1, q["stop"] - q["start"] + q["overlap"]) == q["piece"]).alias("tiled"),
        F.forall("p", lambda q: q["overlap"] == F.least(F.lit(overlap), q["start"] - begun(q))).alias("lapped"))


def opened_articles(pieces: DataFrame) -> DataFrame:
    """(id, article) for every article that opens in a text, or ('' as article) where none does."""
    return pieces.groupBy("id").agg(F.collect_set(F.when(F.col("opens_article"), F.col("article"))).alias("a")).select(
        "id", F.explode(F.when(F.size("a") > 0, F.col("a")).otherwise(F.array(F.lit("")))).alias("article"))
