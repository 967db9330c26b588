"""Hot-key tracking with a TTL that grows once a key is hot.

Rules (the reference's cache): the first access of a key is a miss (count 1, TTL ``ttl``);
an access within the TTL of the previous one is a hit (count + 1); when the count exceeds
``promote_after`` the TTL becomes ``hot_ttl`` (one promotion); an access after a longer gap
is a miss and starts over.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlake.session import materialize
from gridlake.operators.sequence import epoch_micros, scan_lags, scan_max, time_bucket

# Fixed values of the reference: TTL 5 min, 10 min once hot, hot after more than 3 accesses.
TTL_SECONDS = 300
HOT_TTL_SECONDS = 600
PROMOTE_AFTER = 3


def hot_key_accesses(df: DataFrame, key: Sequence[str], ts: str, tiebreak: str, ttl_seconds: int = TTL_SECONDS,
                     hot_ttl_seconds: int = HOT_TTL_SECONDS, promote_after: int = PROMOTE_AFTER,
                     bucket_seconds: int = 86_400) -> DataFrame:
    """Per access: ``hit`` and ``promotion`` flags, computed without a sequential loop.

    Closed form of the state machine (valid since ``hot_ttl >= ttl``): a gap > hot_ttl, or the
    first access, always starts a *segment*; within a segment the key locks in (becomes hot)
    at the first access preceded by ``promote_after`` consecutive gaps <= ttl; before that
    every gap > ttl is a miss, after it there is no miss until the segment ends.  That needs
    the previous ``promote_after`` timestamps (``scan_lags``) and two running maxima of the
    (ts, tiebreak) position (``scan_max``), all per (key, time bucket): a hot key is spread
    over many tasks.
    """
    if hot_ttl_seconds < ttl_seconds:
        raise ValueError("hot_ttl_seconds must be >= ttl_seconds")
    key = list(key)
    order = [ts, tiebreak]
    p = promote_after
    d = df.withColumn("_us", epoch_micros(df, ts)).withColumn("_bucket", time_bucket(df, ts, bucket_seconds))
    d = scan_lags(d, key, order, "_bucket", "_us", p)
    times = ["_us"] + [f"_lag{j}" for j in range(1, p + 1)]
    gaps = [F.col(times[j]) - F.col(times[j + 1]) for j in range(p)]  # gaps[0] is this access's gap
    short = [g.isNotNull() & (g <= ttl_seconds * 1_000_000) for g in gaps]
    run = short[0]
    for s_ in short[1:]:
        run = run & s_
    pos = F.struct(F.col(ts).alias("t"), F.col(tiebreak).alias("b"))
    d = (d.withColumn("_short", short[0]).withColumn("_run", run)
         .withColumn("_start", F.col("_lag1").isNull() | (gaps[0] > hot_ttl_seconds * 1_000_000)))
    d = materialize(d)  # the second scan reads this twice: written once instead of recomputed
    d = scan_max(d, key, order, "_bucket", {
        "_seg": (F.when(F.col("_start"), pos), True),
        "_run_before": (F.when(F.col("_run"), pos), False),
    })
    locked = F.coalesce(F.col("_run_before") >= F.col("_seg"), F.lit(False))
    miss = F.col("_start") | (~F.col("_short") & ~locked)
    drop = ["_us", "_bucket", "_short", "_run", "_start", "_seg", "_run_before"] + [f"_lag{j}" for j in range(1, p + 1)]
    return d.withColumn("hit", ~miss).withColumn("promotion", F.col("_run") & ~locked).drop(*drop)


def hot_key_stats(accesses: DataFrame, key: Sequence[str]) -> DataFrame:
    """Accesses, hits, misses, promotions and hit ratio (0 when no access) per key."""
    return (accesses.groupBy(*key)
            .agg(F.count(F.lit(1)).alias("accesses"), F.count_if("hit").alias("hits"),
                 F.count_if(~F.col("hit")).alias("misses"), F.count_if("promotion").alias("promotions"))
            .withColumn("hit_ratio", F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("accesses")), F.lit(0.0))))


STATE_SCHEMA = T.StructType([
    T.StructField("count", T.LongType()), T.StructField("ttl", T.LongType()), T.StructField("last", T.LongType()),
    T.StructField("accesses", T.LongType()), T.StructField("hits", T.LongType()), T.StructField("promotions", T.LongType()),
])


def _stream_state_fn(key_names, ttl_us, hot_ttl_us, promote_after):
    def fn(key, frames, state):
        if state.exists:
            count, ttl, last, acc, hits, promos = state.get
        else:
            count, ttl, last, acc, hits, promos = 0, ttl_us, None, 0, 0, 0
        # Arrow cuts a key's rows of a micro-batch into chunks in any order: two numbers a row are kept to sort them
        parts = [(p["_us"].to_numpy(), p["_tb"].to_numpy()) for p in frames if len(p)]
        times = []
        if parts:
            us, tb = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            times = us[np.lexsort((tb, us))].tolist()
        for t in times:
            acc += 1
            if last is None or t - last > ttl:
                count, ttl = 1, ttl_us
            else:
                hits += 1
                count += 1
                if count > promote_after and ttl == ttl_us:
                    ttl = hot_ttl_us
                    promos += 1
            last = t if last is None else max(last, t)  # a row of an earlier time than the last batch's is a hit
        state.update((count, ttl, last, acc, hits, promos))
        yield pd.DataFrame([list(key) + [acc, hits, acc - hits, promos]],
                           columns=[*key_names, "accesses", "hits", "misses", "promotions"])
    return fn


def hot_key_stream(stream: DataFrame, key: Sequence[str], ts: str, tiebreak: str, ttl_seconds: int = TTL_SECONDS,
                   hot_ttl_seconds: int = HOT_TTL_SECONDS, promote_after: int = PROMOTE_AFTER,
                   watermark: str = "10 minutes") -> DataFrame:
    """T3/T4 streaming form: ``applyInPandasWithState`` keeps (count, ttl, last access, totals)
    per key; rows later than the watermark are dropped (T4): Spark does so only for an event-time timeout, of which
    none is ever set, so that no state is removed.  A key expires by the gap to its next access, as in
    the batch form; its totals go on, so its six numbers stay in the state.  Emits running totals per key per
    micro-batch.  Within a micro-batch a key's rows are processed in (ts, tiebreak) order."""
    key = list(key)
    s = (stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", watermark)
         .withColumn("_us", F.unix_micros("_ts")).withColumn("_tb", F.col(tiebreak)))
    key_fields = [stream.schema[k] for k in key]
    out = T.StructType(key_fields + [T.StructField(n, T.LongType()) for n in ("accesses", "hits", "misses", "promotions")])
    from pyspark.sql.streaming.state import GroupStateTimeout

    fn = _stream_state_fn(key, ttl_seconds * 1_000_000, hot_ttl_seconds * 1_000_000, promote_after)
    return (s.select(*key, "_ts", "_us", "_tb").groupBy(*key)
            .applyInPandasWithState(fn, out, STATE_SCHEMA, "update", GroupStateTimeout.EventTimeTimeout))
