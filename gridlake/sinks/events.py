"""Cells exported as ordered JSON event lines.

Every event is ``{"type": …, "data": {…}}``; a ``seq`` struct orders the lines.  Rows are
rebuilt as ragged string arrays (interior blanks ``""``, rows without cells ``[]``) and
grouped into batches of a fixed number of rows, so every ``collect_list`` is bounded by the
batch size or by a row's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions.a1 import idiv
from gridlake.operators.sequence import null_safe_join


#: Fields of the event lines.
EVENT_SCHEMA = "type STRING, data STRING, sheet_index INT, sheet_name STRING, chunk_id STRING"


def envelope(kind: str | Column, data: Column | None = None, **top: Column) -> Column:
    """K3: an event as JSON text: ``{"data": …, "type": …}`` or, for events without a data
    object, ``type`` beside top-level fields.  Keys are in sorted order, as the reference's
    JSON encoder writes maps."""
    k = F.lit(kind) if isinstance(kind, str) else kind
    fields = dict(top)
    if data is not None:
        fields["data"] = data
    fields["type"] = k
    return F.to_json(F.struct(*[fields[n].alias(n) for n in sorted(fields)]))


def _row_lengths(cells: DataFrame) -> DataFrame:
    return cells.groupBy("workbook", "sheet", "sheet_idx", "row").agg(F.max("col").alias("_len"))


def _row_arrays(cells: DataFrame, first_col: int = 1, last_col: int | None = None) -> DataFrame:
    """One row per (workbook, sheet, row): the row's values from ``first_col`` to
    ``last_col`` (1-based), clipped to the row's full ragged length; interior blanks are ""."""
    per_row = cells.groupBy("workbook", "sheet", "sheet_idx", "row").agg(
        F.map_from_entries(F.collect_list(F.struct("col", F.coalesce("value", F.lit(""))))).alias("_m"),
        F.max("col").alias("_len"))
    end = F.col("_len") if last_col is None else F.least(F.col("_len"), F.lit(last_col))
    vals = F.transform(F.sequence(F.lit(first_col), end), lambda c: F.coalesce(F.try_element_at("_m", c), F.lit("")))
    return per_row.filter(end >= first_col).select("workbook", "sheet", "sheet_idx", "row", vals.alias("values"))


def _batched(rows: DataFrame, extent: DataFrame, size: int, empty_row: Column) -> DataFrame:
    """Batches of ``size`` rows from ``_first`` to ``_last`` (1-based, inclusive) per sheet of
    ``extent``; a batch whose rows have no cells is still emitted (rows ``empty_row``)."""
    key = ["workbook", "sheet", "sheet_idx"]
    got = (rows.join(extent.select(*key, "_first"), key)
           .withColumn("batch", idiv(F.col("row") - F.col("_first"), size))
           .groupBy(*key, "batch").agg(F.map_from_entries(F.collect_list(F.struct("row", "values"))).alias("_rows")))
    every = extent.select(*key, *[c for c in extent.columns if c not in key],
                          F.explode(F.sequence(F.lit(0).cast("bigint"), idiv(F.col("_last") - F.col("_first"), size))).alias("batch"))
    b = every.join(got, [*key, "batch"], "left")
    start = F.col("_first") + F.col("batch") * size
    end = F.least(start + size - 1, F.col("_last"))
    dense = F.transform(F.sequence(start, end), lambda r: F.coalesce(F.try_element_at("_rows", r), empty_row))
    return b.select("*", start.alias("_start"), dense.alias("rows")).drop("_rows")


def row_batch_events(cells: DataFrame, batch_rows: int = 100, chunk_size: int | None = None,
                     sheets: DataFrame | None = None) -> DataFrame:
    """K1: per chunk of sheets: ``metadata`` (chunk_id, sheets_range, streaming), then per
    sheet ``sheet_start`` (sheet_index, sheet_name, total_rows), ``rows`` batches (0-based
    ``start_row``) and ``sheet_complete``; then ``complete`` (chunk_id).  Without
    ``chunk_size`` a workbook is one chunk.  With ``sheets`` (workbook, sheet, sheet_idx), a sheet without cells
    has its start (0 rows) and end, too.  Columns: workbook, seq, line."""
    key = ["workbook", "sheet", "sheet_idx"]
    rows = _row_arrays(cells)
    extent = cells.groupBy(*key).agg(F.max("row").alias("_last")).withColumn("_first", F.lit(1).cast("bigint"))
    if sheets is not None:
        none = null_safe_join(sheets.select(*key).distinct(), extent.select(*key), key, "left_anti")
        extent = extent.unionByName(none.select(*key, F.lit(0).cast("bigint").alias("_last"), F.lit(1).cast("bigint").alias("_first")))
    top = extent.groupBy("workbook").agg(F.max("sheet_idx").alias("_max_idx"))
    chunk = idiv("sheet_idx", chunk_size) if chunk_size else F.lit(0).cast("bigint")
    extent = extent.join(top, "workbook").withColumn("chunk", chunk)
    first = F.col("chunk") * chunk_size if chunk_size else F.lit(0).cast("bigint")
    last = (F.least(F.col("chunk") * chunk_size + chunk_size - 1, F.col("_max_idx")) if chunk_size
            else F.col("_max_idx").cast("bigint"))
    chunks = extent.select("workbook", "chunk", first.alias("_a"), last.alias("_b")).distinct()
    chunk_id = F.concat_ws("_", F.lit("chunk"), F.col("_a"), F.col("_b"))
    batches = _batched(rows, extent.filter("_last > 0"), batch_rows, F.array().cast("array<string>"))
    seq = lambda p, s_, i: F.struct(F.col("chunk").alias("c"), F.lit(p).alias("p"), s_.cast("bigint").alias("s"),
                                    i.cast("bigint").alias("i"))
    meta = chunks.select("workbook", seq(0, F.lit(0), F.lit(0)).alias("seq"), envelope("metadata", F.struct(
        chunk_id.alias("chunk_id"), F.array("_a", "_b").alias("sheets_range"), F.lit(True).alias("streaming"))).alias("line"))
    idx, name = F.col("sheet_idx").alias("sheet_index"), F.col("sheet").alias("sheet_name")
    start = extent.select("workbook", seq(1, F.col("sheet_idx"), F.lit(-1)).alias("seq"), envelope("sheet_start", F.struct(
        idx, name, F.col("_last").alias("total_rows"))).alias("line"))
    data = batches.select("workbook", seq(1, F.col("sheet_idx"), F.col("batch")).alias("seq"), envelope("rows", F.struct(
        "rows", idx, name, (F.col("_start") - 1).alias("start_row"))).alias("line"))
    done = extent.select("workbook", seq(1, F.col("sheet_idx"), F.lit(1 << 40)).alias("seq"),
                         envelope("sheet_complete", sheet_index=F.col("sheet_idx"), sheet_name=F.col("sheet")).alias("line"))
    end = chunks.select("workbook", seq(2, F.lit(0), F.lit(0)).alias("seq"),
                        envelope("complete", chunk_id=chunk_id).alias("line"))
    return meta.unionByName(start).unionByName(data).unionByName(done).unionByName(end)


def window_events(cells: DataFrame, sheet: str, start_row: int, end_row: int, start_col: int, end_col: int,
                  batch_rows: int = 50) -> DataFrame:
    """K2: ``window_start`` (sheet_name, window, rows), ``window_data`` batches of
    ``batch_rows`` rows (``start_row`` = offset in the window + window start, 0-based) and
    ``window_complete``.  Window coordinates are 0-based and inclusive; each row is clipped
    to its own length, and a row with nothing in the window is ``null``, like the reference."""
    sc = cells.filter(F.col("sheet") == sheet)
    in_rows = sc.filter(F.col("row").between(start_row + 1, end_row + 1))
    rows = _row_arrays(in_rows, start_col + 1, end_col + 1)
    last = sc.groupBy("workbook", "sheet", "sheet_idx").agg(F.max("row").alias("_n"))
    extent = (last.withColumn("_first", F.lit(start_row + 1).cast("bigint"))
              .withColumn("_last", F.least(F.lit(end_row + 1), F.col("_n"))).filter(F.col("_last") >= F.col("_first")))
    batches = _batched(rows, extent, batch_rows, F.lit(None).cast("array<string>"))
    n_rows = extent.select("workbook", (F.col("_last") - F.col("_first") + 1).alias("rows"))
    window = F.struct(F.lit(start_row).alias("start_row"), F.lit(end_row).alias("end_row"),
                      F.lit(start_col).alias("start_col"), F.lit(end_col).alias("end_col"))
    seq = lambda a, i: F.struct(F.lit(a).alias("p"), i.cast("bigint").alias("i"))
    head = n_rows.select("workbook", seq(0, F.lit(0)).alias("seq"), envelope("window_start", F.struct(
        "rows", F.lit(sheet).alias("sheet_name"), window.alias("window"))).alias("line"))
    data = batches.select("workbook", seq(1, F.col("batch")).alias("seq"), envelope("window_data", F.struct(
        "rows", (F.col("_start") - 1).alias("start_row"))).alias("line"))
    tail = n_rows.select("workbook", seq(2, F.lit(0)).alias("seq"), envelope("window_complete").alias("line"))
    return head.unionByName(data).unionByName(tail)


def write_events(events: DataFrame, path: str, compression: str = "none", files: int | None = None) -> None:
    """Write event lines in ``seq`` order: range partitions by seq, sorted within each, so
    reading the part files in name order replays the events in order."""
    n = files or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = events.repartitionByRange(n, "workbook", "seq").sortWithinPartitions("workbook", "seq")
    ordered.select("line").write.mode("overwrite").option("compression", compression).text(path)


def read_events(spark, path: str) -> DataFrame:
    """K6: read an export back (gzip and other codecs are decoded by file extension), with a fixed schema, so in
    one pass: ``data`` is an event's data object as JSON text."""
    return spark.read.schema(EVENT_SCHEMA).json(path)
