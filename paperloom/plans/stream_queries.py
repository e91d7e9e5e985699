"""Queries over event time, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.plans.registry import core
from paperloom.sources.tables import table
from paperloom.streaming import streams as S

query = core.query

DAYS = "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL"


@query("tumbling_counts", DAYS)
def tumbling_counts(spark, d):
    return S.windowed_counts(table(spark, d, "events"), "1 day")


@query("sliding_counts", """SELECT start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL '6 hours', ts), time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours']) AS start FROM events) GROUP BY start, event_type""")
def sliding_counts(spark, d):
    return S.windowed_counts(table(spark, d, "events"), "12 hours", "6 hours")


@query("stream_counts", DAYS)
def stream_counts(spark, d):
    """The daily counts by a streaming query that reads the files and ends."""
    like = table(spark, d, "events")
    return S.run_once(S.windowed_counts(S.file_stream(spark, f"{d}/events.parquet", like), "1 day"))


SESSIONS = """WITH s AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '1 hour' THEN 0 ELSE 1 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 r AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM s) SELECT user_id, min(ts) AS start, count(*) AS n FROM r GROUP BY user_id, no"""


@query("conversation_sessions", SESSIONS)
def conversation_sessions(spark, d):
    return S.sessions(table(spark, d, "events"))


@query("stream_ingest", """SELECT split_part(id, '-', 1) AS file, count(*) AS chunks, max(line_no) AS last_line FROM (SELECT id, max(line_no) AS line_no FROM chunks WHERE id IS NOT NULL GROUP BY id) GROUP BY 1""")
def stream_ingest(spark, d):
    """Chunks upserted by a streaming query into a versioned table, then counted per file."""
    like = table(spark, d, "chunks").select("line_no", "id", "text")
    target = S.new_folder(spark, "ingest")
    S.ingest_stream(S.file_stream(spark, f"{d}/chunks.parquet", like, files_per_trigger=4).where("id IS NOT NULL"), target, ["id"]).awaitTermination()
    return S.read_versioned(spark, target, ["id"]).groupBy(F.substring_index("id", "-", 1).alias("file")).agg(F.count(F.lit(1)).alias("chunks"), F.max("line_no").alias("last_line"))
