"""Structured Streaming: incremental ingest, windows over events, sessions with idle time."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperloom import config as C
from paperloom.session import shared_folder
from paperloom.sources.tables import last_wins


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, which all executors share."""
    return shared_folder(spark, f"{name}-{uuid.uuid4().hex}")


def file_stream(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of ``path`` as they appear, with the schema of ``like``."""
    r = spark.readStream.schema(like.schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():  # a stream reads folders
        r, path = r.option("pathGlobFilter", at.getName()), at.getParent().toString()
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).parquet(path)


def event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with zone; the stored one has none and is taken as UTC."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def ingest_stream(stream: DataFrame, target: str, keys: list[str], work: Callable[[DataFrame], DataFrame] = lambda x: x, order: str = "line_no",
                  compact: int = 16, **trigger: Any) -> StreamingQuery:
    """Upsert every micro-batch into the table at ``target``; of the rows of a key the one highest in ``order`` stays, whenever it came.

    A batch writes its own rows alone, one per key, to a folder of its number, so that one that is lost halfway and repeated leaves the table as if it
    had run once, and its cost goes by its own size. Readers take the newest row of each key over the folders. After every ``compact`` batches these are put together
    to one, which counts for all up to its number; older folders stay for readers that have begun. Failed inputs come again with a later batch by their own rows.
    """
    spark = stream.sparkSession

    def batch(df: DataFrame, no: int) -> None:
        newest(work(df), keys, order).write.mode("overwrite").parquet(f"{target}/deltas/version={no}")
        if compact and no % compact == compact - 1:
            read_versioned(spark, target, keys, order, upto=no).write.mode("overwrite").parquet(f"{target}/bases/version={no}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{target}/progress").trigger(**(trigger or {"availableNow": True})).start()


def newest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows of each key one with the highest order; only keys and order are shuffled, but for keys that have several."""
    if len(keys) == 1:
        return last_wins(rows, keys[0], order).dropDuplicates([keys[0], order])
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def read_versioned(spark: SparkSession, target: str, keys: list[str], order: str = "line_no", upto: int | None = None) -> DataFrame | None:
    """The table of :func:`ingest_stream` after its newest finished batch, or that of number ``upto``; None if there is none."""
    def done(kind: str) -> list[int]:
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{kind}")
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(root) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return [n for n in found if upto is None or n <= upto]

    base = max(done("bases"), default=-1)
    parts = [f"{target}/deltas/version={n}" for n in sorted(done("deltas")) if n > base] + ([f"{target}/bases/version={base}"] if base >= 0 else [])
    return newest(spark.read.parquet(*parts), keys, order) if parts else None


def windowed_counts(events: DataFrame, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) per window; on a stream with a watermark of ``late``."""
    e = event_time(events)
    if events.isStreaming:
        e = e.withWatermark("ts", late)
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(
        F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, idle: str = C.SESSION_IDLE, late: str = "1 hour") -> DataFrame:
    """(user_id, start, n): activity of a user without a pause of ``idle``; batch or streaming."""
    e = event_time(events)
    if events.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy("user_id", F.session_window("ts", idle).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        "user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def conversations(messages: DataFrame, idle_ms: int = 3_600_000, most: int = C.HISTORY_MESSAGES) -> DataFrame:
    """Keyed state of a stream of (conv_id, turn, role, text): the last messages, dropped after the idle time without any.

    Every batch gives the kept messages of each conversation that it touches, as (conv_id, place, turn, role, text).
    """
    fields = ["turn", "role", "text"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = pd.DataFrame(dict(zip(fields, state.get)) if state.exists else {f: [] for f in fields})
        kept = pd.concat([held, *(b[fields] for b in batches)]).drop_duplicates("turn", keep="last").sort_values("turn")
        if len(kept) > most:
            kept = kept.tail(most)
            if kept["role"].iloc[0] == "assistant":
                kept = kept.iloc[1:]
        state.update((kept["turn"].astype(int).tolist(), kept["role"].tolist(), [None if pd.isna(x) else x for x in kept["text"]]))
        state.setTimeoutDuration(idle_ms)
        yield kept.astype({"turn": "int64"}).assign(conv_id=key[0], place=range(1, len(kept) + 1))[["conv_id", "place", *fields]]

    return messages.groupBy("conv_id").applyInPandasWithState(
        step, "conv_id long, place int, turn long, role string, text string", "turns array<long>, roles array<string>, texts array<string>", "update", GroupStateTimeout.ProcessingTimeTimeout)


def run_once(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a streaming aggregate over all that is there and give its last result as a table in the shared folder."""
    spark = stream.sparkSession
    target = new_folder(spark, "stream")

    def batch(df: DataFrame, no: int) -> None:
        df.write.mode("overwrite").parquet(f"{target}/out")

    q = stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", f"{target}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{target}/out")
