"""Ordered scans per key that stay parallel when one key holds a large share of all rows.

A key's rows are cut into time buckets; every scan is a window per (key, bucket), and what a
bucket needs from earlier buckets (the last few values, running maxima) comes from a small
per-(key, bucket) summary whose prefix is a window over that summary table.  Order-dependent
state machines (T3) and gap sessions (T6) are written on top of these two scans, so no key is
ever gathered into one task or one pandas frame.  Rows with a null key form a group of their own, and rows with a
null time are one bucket before all others (nulls sort first).  All windows of one scan share the
(key, bucket) hash partitioning, so the input is scanned and shuffled once (reused exchange).
"""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi join on columns of the same names in which nulls are equal; the left side's columns are kept.
    Windows and aggregates treat null keys as a group, so joining their results back must do so, too."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(renamed, cond, how).drop(*[f"_r_{c}" for c in on])


#: Rows that a join may send whole to every task: some 10 MB.
SMALL_ROWS = 100_000


def join_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of ``rows`` rows (or a bound of them) as a side of a join: sent whole when there are few, else sorted and merged.
    Spark's own choice goes by file sizes, which say little of what comes to the driver once compressed columns are
    unpacked or rows multiplied."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df.hint("merge")


def epoch_micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP (an instant) or TIMESTAMP_NTZ (a wall
    clock, read as UTC) column, without going through the session time zone, so gaps between
    wall-clock times do not depend on it (no daylight-saving jumps)."""
    t = F.col(ts)
    if df.schema[ts].dataType.typeName() == "timestamp_ntz":
        day = F.unix_date(F.to_date(t)).cast("bigint") * 86_400_000_000
        tod = (F.hour(t).cast("bigint") * 3600 + F.minute(t).cast("bigint") * 60) * 1_000_000
        return day + tod + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("bigint")
    return F.unix_micros(t)


def time_bucket(df: DataFrame, ts: str, seconds: int) -> Column:
    """Bucket number of a timestamp column (see :func:`epoch_micros`)."""
    return F.floor(epoch_micros(df, ts) / (seconds * 1_000_000)).cast("bigint")


def scan_lags(df: DataFrame, key: Sequence[str], order: Sequence[str], bucket: str, col: str, n: int) -> DataFrame:
    """Add ``_lag1`` … ``_lag{n}``: ``col`` of the 1st … n-th previous row of the same key in
    ``order`` (null before the key's first row), across bucket boundaries."""
    key, order = list(key), list(order)
    part = [*key, bucket]
    w = Window.partitionBy(*part).orderBy(*order)
    w_desc = Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in order])
    # each bucket's last n rows: at most n rows per bucket, a small table
    tail = (df.select(*part, *order, F.col(col).alias("_v"))
            .withColumn("_rd", F.row_number().over(w_desc)).filter(F.col("_rd") <= n))
    # in that table the rows just before a bucket's first tail row are the previous buckets' last rows
    wk = Window.partitionBy(*key).orderBy(*order)
    carry = (tail.withColumn("_carry", F.array(*[F.lag("_v", j).over(wk) for j in range(1, n + 1)]))
             .withColumn("_top", F.max("_rd").over(Window.partitionBy(*part)))
             .filter(F.col("_rd") == F.col("_top")).select(*part, "_carry"))
    out = null_safe_join(df, carry, part).withColumn("_pos", F.row_number().over(w))
    for j in range(1, n + 1):
        from_carry = F.get(F.col("_carry"), (F.lit(j) - F.col("_pos")).cast("int"))
        out = out.withColumn(f"_lag{j}", F.when(F.col("_pos") > j, F.lag(col, j).over(w)).otherwise(from_carry))
    return out.drop("_carry", "_pos")


def scan_max(df: DataFrame, key: Sequence[str], order: Sequence[str], bucket: str,
             values: dict[str, tuple[Column, bool]]) -> DataFrame:
    """Add running maxima per key in ``order``: ``name -> (expression, inclusive)`` gives the
    max of the expression over the rows up to this one (inclusive) or strictly before it."""
    key, order = list(key), list(order)
    part = [*key, bucket]
    tmp = {n: f"_x_{n}" for n in values}
    d = df.select("*", *[e.alias(tmp[n]) for n, (e, _) in values.items()])
    per = d.groupBy(*part).agg(*[F.max(tmp[n]).alias(f"_b_{n}") for n in values])
    wb = Window.partitionBy(*key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(*part, *[F.max(f"_b_{n}").over(wb).alias(f"_c_{n}") for n in values])
    out = null_safe_join(d, carry, part)
    for n, (_, inclusive) in values.items():
        frame = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        out = out.withColumn(n, F.greatest(F.col(f"_c_{n}"), F.max(tmp[n]).over(frame)))
    return out.drop(*tmp.values(), *[f"_c_{n}" for n in values])


def scan_sum(df: DataFrame, key: Sequence[str], order: Sequence[str], bucket: str,
             values: dict[str, tuple[Column, bool]]) -> DataFrame:
    """Add running sums per key in ``order``: ``name -> (expression, inclusive)`` gives the
    sum of the expression over the rows up to this one (inclusive) or strictly before it
    (0 for the first row).  Same bucket carry as :func:`scan_max`."""
    key, order = list(key), list(order)
    part = [*key, bucket]
    tmp = {n: f"_x_{n}" for n in values}
    d = df.select("*", *[e.alias(tmp[n]) for n, (e, _) in values.items()])
    per = d.groupBy(*part).agg(*[F.sum(tmp[n]).alias(f"_b_{n}") for n in values])
    wb = Window.partitionBy(*key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(*part, *[F.coalesce(F.sum(f"_b_{n}").over(wb), F.lit(0)).alias(f"_c_{n}") for n in values])
    out = null_safe_join(d, carry, part)
    for n, (_, inclusive) in values.items():
        frame = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        out = out.withColumn(n, F.col(f"_c_{n}") + F.coalesce(F.sum(tmp[n]).over(frame), F.lit(0)))
    return out.drop(*tmp.values(), *[f"_c_{n}" for n in values])
