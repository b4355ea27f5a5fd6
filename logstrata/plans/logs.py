"""The event table of the test data as log lines, in Spark and in SQL."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.session import table

SEGMENT_LINES, CHUNK_LINES = 1024, 256

LOGS_SQL = f"""logs as (
  select event_id seq, epoch_us(ts) // 1000 t, 'svc-' || (user_id % 8) s,
    case event_type when 'error' then 'E' when 'signup' then 'W' when 'view' then 'D' else 'I' end l,
    'User ' || user_id || ' did ' || event_type || ' props ' || props m,
    1 + event_id // {SEGMENT_LINES} segment_id, (event_id % {SEGMENT_LINES}) // {CHUNK_LINES} chunk_id
  from events)"""


def event_logs(spark: SparkSession, d: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """(segment_id, chunk_id, seq, t, s, l, m) of the events, or of those with start <= t <= end.

    The range is put on the stored column, so that it reaches the scan.
    """
    e = table(spark, d, "events")
    at = lambda ms: F.lit((datetime(1970, 1, 1) + timedelta(milliseconds=ms)).isoformat(" ")).cast("timestamp_ntz")
    if start is not None:
        e = e.filter(F.col("ts") >= at(start))
    if end is not None:
        e = e.filter(F.col("ts") < at(end + 1))
    kind = F.col("event_type")
    return e.select(
        (F.floor(F.col("event_id") / SEGMENT_LINES) + 1).alias("segment_id"),
        F.floor(F.col("event_id") % SEGMENT_LINES / CHUNK_LINES).alias("chunk_id"),
        F.col("event_id").alias("seq"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("t"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 8).cast("string")).alias("s"),
        F.when(kind == "error", "E").when(kind == "signup", "W").when(kind == "view", "D").otherwise("I").alias("l"),
        F.concat(F.lit("User "), F.col("user_id").cast("string"), F.lit(" did "), kind, F.lit(" props "), F.col("props")).alias("m"),
    )
