"""Pages to chunks: page-boundary merge, fixed windows, structure-aware chunks.

The chunkers work on offsets. The places where a text may be cut are collected once, in sorted arrays; each chunk's end is looked up in
them by binary search, so that a text of any length costs its length and a search per chunk.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom import config as C
from paperloom.functions.text import strip

# Where a structured text may be cut.
SECTION = re.compile(r"(?=\n\s*(?:BAB\s+[IVXLCDM]+|Pasal\s+\d+[A-Za-z]?|Bagian\s+\w+|Pembukaan)\b)", re.I)
PARAGRAPH, SENTENCE = re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?。])\s+")
OPEN_END, GOES_ON = r"""[^.!?…。:;)"”’]$""", r"^[\p{Ll}\p{Nd}]"


def merge_pages(rows: DataFrame, key: str = "file") -> DataFrame:
    """(key, island, page, text): pages joined where one ends open and the next goes on in lower case or a digit.

    ``rows`` holds key, page, idx, text. Blank pages and rows without page are left out. A page's tail is the tail of
    whatever it was joined to, so the breaks follow from neighbours alone; an island's page is its first.
    """
    order = Window.partitionBy(key).orderBy("page", "idx")
    pages = rows.withColumn("t", strip(F.col("text"))).where("t <> '' AND page IS NOT NULL")
    joins = F.lag("t").over(order).rlike(OPEN_END) & F.col("t").rlike(GOES_ON)
    flagged = pages.withColumn("brk", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("k", F.row_number().over(order))
    islands = flagged.withColumn("island", F.sum("brk").over(order))
    return islands.groupBy(key, "island").agg(
        F.min("page").alias("page"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), " ").alias("text"))


def windows(text: str, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP) -> list[str]:
    """Windows of ``size`` characters that overlap; each ends behind the last line or sentence end of its second half, if there is one."""
    text = text.strip()
    short = [m.end() for m in re.finditer("[\n。]", text)]
    long = [m.end() for m in re.finditer(r"\. ", text)]  # the blank must be in the window, but is not kept

    def stop(at: int) -> int:
        far = at + size
        i, j = bisect_right(short, far), bisect_right(long, far)
        end = max(short[i - 1] if i else 0, long[j - 1] - 1 if j else 0)
        return end if end - at - 1 > size / 2 else far

    spans, at = [], 0
    while len(text) - at > size:
        spans.append((at, stop(at)))
        at = max(spans[-1][1] - overlap, at + 1)
    return [text[a:b].strip() for a, b in [*spans, (at, len(text))]] if text else []


def structured(text: str, target: int = C.STRUCT_TARGET, most: int = C.STRUCT_MAX, least: int = C.STRUCT_MIN, overlap: int = C.STRUCT_OVERLAP) -> list[str]:
    """Chunks of at most ``most`` characters: sections, of long ones the paragraphs, of long paragraphs runs of sentences; what is
    small is joined to its neighbours up to ``target``, and chunks under ``least`` are dropped."""
    whole = text.strip()

    def fitting(piece: str, kinds: tuple[re.Pattern, ...]) -> Iterator[str]:
        for part in _between(piece, kinds[0]):
            if len(part) <= most:
                yield part
            elif len(kinds) > 1:
                yield from fitting(part, kinds[1:])
            else:
                yield from _sentence_runs(list(_between(part, SENTENCE)), target, most, overlap)

    parts = list(fitting(whole, (SECTION, PARAGRAPH)))
    return ["\n".join(parts[a:b]) for a, b in _joins([len(p) for p in parts], target, most)
            if sum(map(len, parts[a:b])) + b - a - 1 >= least]


def _between(text: str, mark: re.Pattern) -> Iterator[str]:
    """What stands between the marks, without outer blanks; blank pieces are left out."""
    edges = [(0, 0), *(m.span() for m in mark.finditer(text)), (len(text), len(text))]
    for (_, a), (b, _) in zip(edges, edges[1:]):
        if piece := text[a:b].strip():
            yield piece


def _joins(sizes: list[int], target: int, most: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbours: one that reaches ``target`` by a join is full, and none is joined beyond ``most``; a joint is a character."""
    ends = [0, *accumulate(n + 1 for n in sizes)]
    at = 0
    while at < len(sizes):
        full = bisect_left(ends, ends[at] + target + 1, min(at + 2, len(ends)))
        room = bisect_right(ends, ends[at] + most + 1) - 1
        stop = max(at + 1, min(full, room, len(sizes)))
        yield at, stop
        at = stop


def _sentence_runs(sentences: list[str], target: int, most: int, overlap: int) -> Iterator[str]:
    """Runs of sentences up to ``target``, each with the last ``overlap`` characters of a longer one before it; one still over ``most`` is cut hard.

    Laid out with single blanks the sentences are one text, of which every run, its overlap included, is a span.
    """
    flat = " ".join(sentences)
    ends = [e - 1 for e in accumulate(len(s) + 1 for s in sentences)]
    at = taken = 0
    while taken < len(ends):
        last = max(taken, bisect_right(ends, at + target) - 1)
        stop = ends[last]
        step = target if stop - at > most else stop - at
        yield from (flat[a : min(a + step, stop)] for a in range(at, stop, step))
        at, taken = (stop - overlap if 0 < overlap < stop - at else stop + 1), last + 1


def _chunks(df: DataFrame, key: str, cutter: Callable[[str], list[str]]) -> DataFrame:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cutter(t) if t is not None else [])

    cut = F.pandas_udf(run, "array<string>")
    return df.where(F.col("text").isNotNull()).select(key, F.posexplode(cut(F.col("text"))).alias("idx", "chunk"))


def fixed_chunks(df: DataFrame, key: str) -> DataFrame:
    """(key, idx, chunk) by :func:`windows`; null and blank texts give none."""
    return _chunks(df, key, windows)


def structured_chunks(df: DataFrame, key: str) -> DataFrame:
    """(key, idx, chunk) by :func:`structured`; null, blank and very short texts give none."""
    return _chunks(df, key, structured)
