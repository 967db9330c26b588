"""T5 periodic ticks and T6 gap sessions, batch and streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.session import materialize
from gridlake.operators.sequence import epoch_micros, scan_lags, scan_max, time_bucket


def tick_counts(df: DataFrame, ts: str, every: str = "1 minute", group: Sequence[str] = ()) -> DataFrame:
    """T5: counts per tumbling window (``tick`` = window start).  Same expression in a
    streaming query after ``withWatermark``."""
    return (df.groupBy(F.window(ts, every).alias("_w"), *group)
            .agg(F.count(F.lit(1)).alias("n")).select(F.col("_w.start").alias("tick"), *group, "n"))


def tick_hit_ratio(accesses: DataFrame, ts: str, every: str = "1 minute") -> DataFrame:
    """T5 over T3 output: hits, accesses and hit ratio (0 when no access) per tick."""
    return (accesses.groupBy(F.window(ts, every).alias("_w"))
            .agg(F.count(F.lit(1)).alias("accesses"), F.count_if("hit").alias("hits"))
            .select(F.col("_w.start").alias("tick"), "accesses", "hits",
                    F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("accesses")), F.lit(0.0)).alias("hit_ratio")))


def gap_sessions(df: DataFrame, key: Sequence[str], ts: str, tiebreak: str, gap_seconds: int,
                 bucket_seconds: int = 86_400) -> DataFrame:
    """Each row with ``session_start``: a new session begins at a key's first row or after
    a gap of at least ``gap_seconds``.  Bucketed scans (see ``sequence``) keep a busy key
    parallel; the streaming form is ``session_window``."""
    key = list(key)
    order = [ts, tiebreak]
    d = df.withColumn("_us", epoch_micros(df, ts)).withColumn("_bucket", time_bucket(df, ts, bucket_seconds))
    d = scan_lags(d, key, order, "_bucket", "_us", 1)
    gap = F.col("_us") - F.col("_lag1")
    start = F.col("_lag1").isNull() | (gap >= gap_seconds * 1_000_000)
    d = materialize(d.withColumn("_start", start))  # read twice below: written once instead of recomputed
    start = F.col("_start")
    # timestamps grow along the order, so the latest start so far is the running max
    d = scan_max(d, key, order, "_bucket", {"session_start": (F.when(start, F.col(ts)), True)})
    return d.drop("_us", "_bucket", "_lag1", "_start")


def session_summary(sessions: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per session: key, first timestamp, number of rows."""
    return sessions.groupBy(*key, "session_start").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed(
        "session_start", "first_ts")


def stream_sessions(stream: DataFrame, key: Sequence[str], ts: str, gap: str, watermark: str) -> DataFrame:
    """T6 streaming: ``session_window`` after a watermark (event-time ``TIMESTAMP``)."""
    s = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", watermark)
    return (s.groupBy(*key, F.session_window("_ts", gap).alias("_s"))
            .agg(F.count(F.lit(1)).alias("n")).select(*key, F.col("_s.start").alias("first_ts"), "n"))
