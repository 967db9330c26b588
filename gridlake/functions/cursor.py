"""Opaque paging cursors: URL-safe base64 of a JSON struct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the reference: cursor format version and maximum age.
CURSOR_VERSION = 1
MAX_AGE_SECONDS = 24 * 60 * 60

WINDOW_TYPE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("start_row", "end_row", "start_col", "end_col")])
CURSOR_TYPE = T.StructType([
    T.StructField("chunk_id", T.StringType()),
    T.StructField("offset", T.LongType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("checksum", T.StringType()),
    T.StructField("ts", T.LongType()),
    T.StructField("window", WINDOW_TYPE),
])


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def encode_cursor(chunk_id, offset, checksum, ts, window=None, version=CURSOR_VERSION) -> Column:
    """cursor text; ``ts`` is epoch seconds, ``window`` an optional struct (dropped when null)."""
    w = _c(window) if window is not None else F.lit(None).cast(WINDOW_TYPE)
    s = F.struct(_c(chunk_id).cast("string").alias("chunk_id"), _c(offset).cast("bigint").alias("offset"),
                 F.lit(version).cast("int").alias("version") if isinstance(version, int) else _c(version).cast("int").alias("version"),
                 _c(checksum).cast("string").alias("checksum"), _c(ts).cast("bigint").alias("ts"), w.alias("window"))
    return F.translate(F.base64(F.encode(F.to_json(s), "UTF-8")), "+/", "-_")


def decode_cursor(cursor, now_seconds, expected_version: int = CURSOR_VERSION) -> Column:
    """struct(cursor fields…, error).  ``error`` is null for a valid cursor, else one of
    'empty', 'format', 'version', 'expired' (checked in that order); never raises."""
    c = _c(cursor)
    raw = F.try_to_binary(F.translate(c, "-_", "+/"), F.lit("base64"))
    data = F.from_json(F.decode(raw, "UTF-8"), CURSOR_TYPE)
    error = (F.when(c.isNull() | (c == ""), "empty")
             .when(raw.isNull() | data.isNull() | data["version"].isNull(), "format")
             .when(data["version"] != expected_version, "version")
             .when(_c(now_seconds) - data["ts"] > MAX_AGE_SECONDS, "expired"))
    return F.struct(*[data[f.name].alias(f.name) for f in CURSOR_TYPE.fields], error.alias("error"))


def checksum_matches(decoded, expected) -> Column:
    """the decoded cursor is valid and carries the expected checksum."""
    d = _c(decoded)
    return d["error"].isNull() & (d["checksum"] == _c(expected))
