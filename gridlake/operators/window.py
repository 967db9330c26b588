"""Sheet windows, sheet-range chunks, row batches and the wide extract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.functions.a1 import idiv
from gridlake.functions.values import parse_money


def read_window(cells: DataFrame, start_row: int, end_row: int, start_col: int, end_col: int,
                sheet: str | None = None) -> DataFrame:
    """Cells of a 0-based, inclusive window (the reference's ``Window``), optionally of one sheet.

    Plain filters on ``row`` and ``col`` themselves, with shifted constants, so they reach the scan: on a ``cells`` table sorted by (sheet, row)
    they prune Parquet row groups.  Clipping to the ragged row length is implicit: absent cells
    are not rows.
    """
    out = cells.filter(F.col("row").between(start_row + 1, end_row + 1) & F.col("col").between(start_col + 1, end_col + 1))
    return out if sheet is None else out.filter(F.col("sheet") == sheet)


def sheet_range(cells: DataFrame, first: int, last: int) -> DataFrame:
    """Cells of the sheets whose ordinal is in ``[first, last]``."""
    return cells.filter(F.col("sheet_idx").between(first, last))


def row_batches(cells: DataFrame, batch_rows: int = 100, offset: int = 0) -> DataFrame:
    """Batch number and 0-based ``start_row`` of each cell, batches of ``batch_rows`` rows.
    ``offset`` shifts the first row (the window export numbers from the window's start)."""
    b = idiv(F.col("row") - 1 - offset, batch_rows)
    return cells.withColumn("batch", b).withColumn("start_row", b * batch_rows + offset)


def extract_sheet(cells: DataFrame, max_rows: int = 1000, max_cols: int = 21, money_mode: str = "strict") -> DataFrame:
    """The reference's financial extract in long form: first ``max_rows`` rows and first
    ``max_cols`` columns (21: the reference keeps column indexes 0..20), numbers parsed with
    F6; rows with no cell are simply absent (P10)."""
    return (cells.filter((F.col("row") <= max_rows) & (F.col("col") <= max_cols))
            .withColumn("money", parse_money("value", money_mode)))


def extract_wide(cells: DataFrame, max_rows: int = 1000, max_cols: int = 21, parse_money_values: bool = False) -> DataFrame:
    """S7 wide view: one row per sheet row, columns ``c1..c{max_cols}`` (a fixed pivot list,
    so Spark needs no extra job to find the distinct columns).  Values are the cell texts, or
    with ``parse_money_values`` the F6 numbers (text where a value is not a number)."""
    cols = list(range(1, max_cols + 1))
    v = F.coalesce(F.col("money").cast("string"), F.col("value")) if parse_money_values else F.col("value")
    return (extract_sheet(cells, max_rows, max_cols).groupBy("workbook", "sheet", "row")
            .pivot("col", cols).agg(F.first(v))
            .select("workbook", "sheet", "row", *[F.col(str(c)).alias(f"c{c}") for c in cols]))
