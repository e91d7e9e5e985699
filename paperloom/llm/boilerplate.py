"""Lines repeated across one source's documents (problem 6).

Kept as tables that grow by deltas:

* counts (source, line_key, file_key, rows): in how many rows of each file of a source a line occurs;
* totals (source, rows): how many rows the source has.

A delta is the same pair of tables for the rows that came in (sign 1) or were replaced (sign -1), so a new
partition is merged by a sum over its own keys, without looking at old text. Comparing the keys over the threshold
before and after the merge gives the crossings; only new documents and those that hold a crossed line are rebuilt
(:func:`removed_by_parts`). What is removed is decided on the counts of the state, whichever rows are rebuilt.

Line keys are 64-bit hashes of (source, form), file keys of the file. Two lines that share a key would be counted as one: of a thousand million
different lines one meets one of a thousand repeated lines with a chance of about 10^-7.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.session import cut

#: Frequent keys up to this many are sent to every task; more are joined by a shuffle.
BROADCAST_KEYS = 100_000


class Counts(NamedTuple):
    lines: DataFrame  # source, line_key, file_key, rows
    totals: DataFrame  # source, rows


def form(line: Column) -> Column:
    """Lower-cased, every run of other characters than letters one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(line), r"\P{L}+", " "))


def _forms(rows: DataFrame, min_chars: int) -> Column:
    forms = F.transform(F.split(F.col("text"), "\n"), form)
    return F.filter(forms, lambda x: F.length(x) >= min_chars)


def delta(rows: DataFrame, sign: int = 1, min_chars: int = 25) -> Counts:
    """Counts of ``rows`` (id, file, source, text). An id counts once for a line however often it holds it.

    Rows without source are left out; rows with null or empty text count in the totals. The hash aggregate combines
    on the map side, so a line found in a third of all rows sends one number per task and file. All rows of an id belong in one delta.
    """
    rows = rows.where(F.col("source").isNotNull())
    lines = rows.select("id", "source", F.when(F.col("file").isNotNull(), F.xxhash64("file")).alias("file_key"), F.explode(F.array_distinct(F.transform(
        _forms(rows, min_chars), lambda x: F.xxhash64(F.col("source"), x)))).alias("line_key"))
    twice = cut(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("__id")))
    n = twice.count()
    if n:  # rows that share an id are few; their lines are made different first
        twice = F.broadcast(twice) if n <= BROADCAST_KEYS else twice
        same = F.col("id").eqNullSafe(F.col("__id"))
        lines = lines.join(twice, same, "left_anti").unionByName(lines.join(twice, same, "left_semi").distinct())
    lines = lines.groupBy("source", "line_key", "file_key").agg((F.count(F.lit(1)) * sign).alias("rows"))
    return Counts(lines, rows.groupBy("source").agg((F.count(F.lit(1)) * sign).alias("rows")))


def merge(state: Counts, change: Counts) -> Counts:
    """The state after a delta; keys whose count falls to nothing leave it."""
    def add(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
        return a.unionByName(b).groupBy(*keys).agg(F.sum("rows").alias("rows")).where("rows > 0")

    return Counts(add(state.lines, change.lines, ["source", "line_key", "file_key"]), add(state.totals, change.totals, ["source"]))


def counted(state: Counts, percent: int = 3, min_files: int = 5) -> DataFrame:
    """(source, line_key, rows, files) of the lines in at least ``percent`` per cent of a source's rows and ``min_files`` files.

    At most 100 / percent times the mean number of lines per row are left for a source.
    """
    totals = state.totals.select(F.col("source").alias("__s"), F.col("rows").alias("__total"))
    lines = state.lines.groupBy("source", "line_key").agg(F.sum("rows").alias("rows"), F.count("file_key").alias("files"))
    return lines.where(F.col("files") >= min_files).join(totals, F.col("source") == F.col("__s")).where(
        F.col("rows") * 100 >= F.col("__total") * percent).drop("__s", "__total")


def frequent(state: Counts, percent: int = 3, min_files: int = 5) -> DataFrame:
    """(source, line_key) of the lines that :func:`counted` gives."""
    return counted(state, percent, min_files).select("source", "line_key")


def crossings(before: DataFrame, after: DataFrame) -> DataFrame:
    """(source, line_key, crossed): 'up' where a line became frequent, 'down' where it no longer is."""
    up = after.join(before, ["source", "line_key"], "left_anti").withColumn("crossed", F.lit("up"))
    return up.unionByName(before.join(after, ["source", "line_key"], "left_anti").withColumn("crossed", F.lit("down")))


def _join(df: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    keys = keys.select(F.col("line_key").alias("__k"))
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return df.join(keys, F.col("line_key") == F.col("__k"), how)


def occurrences(rows: DataFrame, keys: DataFrame, min_chars: int = 25) -> DataFrame:
    """(id, file, source, line_pos, line_key, form) of every line of ``rows`` whose key is among ``keys``; positions from 1."""
    rows = rows.where(F.col("source").isNotNull())
    lines = rows.select("id", "file", "source", F.posexplode(F.transform(F.split(F.col("text"), "\n"), form)).alias("p", "form"))
    lines = lines.where(F.length("form") >= min_chars).withColumn("line_key", F.xxhash64("source", "form"))
    return _join(lines, keys).select("id", "file", "source", (F.col("p") + 1).alias("line_pos"), "line_key", "form")


def _lines(found: DataFrame, keys: DataFrame) -> DataFrame:
    """(source, form, rows, files) of the lines found, with the counts of ``keys``."""
    return found.select("source", "line_key", "form").distinct().join(keys, ["source", "line_key"]).select("source", "form", "rows", "files")


def removed_lines(rows: DataFrame, state: Counts | None = None, percent: int = 3, min_files: int = 5,
                  min_chars: int = 25) -> tuple[DataFrame, DataFrame]:
    """Lines to remove from ``rows`` (id, file, source, text), and those of the repeated lines that ``rows`` hold.

    ``state`` are counts kept from earlier merges that cover ``rows`` and perhaps others; without it they are built.
    """
    state = state or delta(rows, min_chars=min_chars)
    keys = cut(counted(state, percent, min_files))
    found = cut(occurrences(rows, keys, min_chars))
    return found.select("id", "line_pos").distinct(), _lines(found, keys)


def removed_by_parts(parts: list[DataFrame], percent: int = 3, min_files: int = 5, min_chars: int = 25) -> tuple[DataFrame, DataFrame]:
    """What :func:`removed_lines` gives for the union of ``parts``, merged one after another; all rows of an id are in one part.

    After a merge the new part and the earlier rows that hold a crossed line are rebuilt; what was found in other rows stays.
    """
    first, *rest = parts
    state = delta(first, min_chars=min_chars)
    state = Counts(cut(state.lines), cut(state.totals))
    keys = cut(counted(state, percent, min_files))
    found, seen = cut(occurrences(first, keys, min_chars)), first
    for part in rest:
        state = merge(state, delta(part, min_chars=min_chars))
        state = Counts(cut(state.lines), cut(state.totals))
        before, keys = keys, cut(counted(state, percent, min_files))
        crossed = cut(crossings(before.select("source", "line_key"), keys.select("source", "line_key")))
        again = affected(seen, crossed, min_chars)
        ids = cut(again.select("id").distinct())
        found = cut(found.join(F.broadcast(ids) if ids.count() <= BROADCAST_KEYS else ids, "id", "left_anti").unionByName(
            occurrences(again.unionByName(part), keys, min_chars)))
        seen = seen.unionByName(part)
    return found.select("id", "line_pos").distinct(), _lines(found, keys)


def strip_lines(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """``rows`` with every line in ``removed`` (id, line_pos) taken out of ``text``; other rows as they are."""
    gone = removed.groupBy(F.col("id").alias("__id")).agg(F.collect_set("line_pos").alias("__gone"))  # at most a row's lines
    kept = F.array_join(F.filter(F.split(F.col("text"), "\n"), lambda x, i: ~F.array_contains(F.col("__gone"), i + 1)), "\n")
    return rows.join(gone, F.col("id") == F.col("__id"), "left").withColumn(
        "text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)).drop("__id", "__gone")


def affected(rows: DataFrame, crossed: DataFrame, min_chars: int = 25) -> DataFrame:
    """The rows that hold a crossed line: those to rebuild after a merge."""
    ids = cut(occurrences(rows, crossed.select("source", "line_key").distinct(), min_chars).select(F.col("id").alias("__id")).distinct())
    if ids.count() <= BROADCAST_KEYS:
        ids = F.broadcast(ids)
    return rows.join(ids, F.col("id") == F.col("__id"), "left_semi")
