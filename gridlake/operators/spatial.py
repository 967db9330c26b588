"""Stored spatial index: cells along a space-filling curve, rectangles as a few key ranges.

A sheet's rows and columns are each scaled to BITS bits by the powers of two that hold them (``row_bits``,
``col_bits``: the sheet's shape), and the two numbers' bits are interleaved: the key of a Z-order curve that halves the
sheet in rows and columns by turns, whatever its proportions.  A table sorted by (workbook, sheet, zkey) keeps cells
that are near in both directions in the same row groups, so a rectangle reads few of them: a tall one of one column as
well as a wide one of one row, where a table sorted by rows would read every row group for the tall one.

A rectangle is cut into at most ``max_ranges`` ranges of keys per shape (not per sheet: all sheets of a shape share
them, and there are at most some hundred shapes).  The ranges reach the Parquet scan as filters; the exact test of row
and column follows.  The reference's quad-tree has fixed bounds and drops cells beyond; this has none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.operators.search import in_rect
from gridlake.operators.sequence import null_safe_join

#: Bits per direction of the curve: cells of a sheet of up to 2**20 rows and columns have keys of their own.
BITS = 20
#: The masks that spread a number's bits to every second place (shift, mask).
_SPREAD = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333),
           (1, 0x5555555555555555)]


def _spread(x: Column) -> Column:
    for by, mask in _SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, by)).bitwiseAND(F.lit(mask))
    return x


def _bits(n: Column) -> Column:
    """Bits that hold the numbers 0 .. n - 1."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1))).cast("int")


def z_key(row: Column, col: Column, row_bits: Column, col_bits: Column) -> Column:
    """Key of a 1-based cell in a sheet whose rows and columns need so many bits."""
    scaled = lambda x, bits: F.call_function("shiftright", F.shiftleft((x - 1).cast("bigint"), BITS), bits)
    return F.shiftleft(_spread(scaled(row, row_bits)), 1).bitwiseOR(_spread(scaled(col, col_bits)))


def sheet_shapes(cells: DataFrame) -> DataFrame:
    """Per sheet: its last row and column and the bits that hold them; one partial aggregate."""
    last = cells.groupBy("workbook", "sheet").agg(F.max("row").alias("n_rows"), F.max("col").alias("n_cols"))
    return last.select("*", _bits(F.col("n_rows")).alias("row_bits"), _bits(F.col("n_cols")).alias("col_bits"))


def with_z_key(cells: DataFrame, shapes: DataFrame) -> DataFrame:
    """``cells`` with row_bits, col_bits and zkey."""
    sized = null_safe_join(cells, shapes.select("workbook", "sheet", "row_bits", "col_bits"), ["workbook", "sheet"])
    return sized.withColumn("zkey", z_key(F.col("row"), F.col("col"), F.col("row_bits"), F.col("col_bits")))


def write_spatial(cells: DataFrame, path: str, mode: str = "overwrite", files: int | None = None,
                  row_group_bytes: int | None = None) -> None:
    """K5: the cells by (workbook, sheet, zkey) under ``path/spatial`` and the sheets' shapes under
    ``path/shapes``.  The range partitioning ends with the cell, so one large sheet is cut over many files."""
    spark = cells.sparkSession
    sheet_shapes(cells).write.mode(mode).parquet(f"{path}/shapes")
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["workbook", "sheet", "zkey", "row", "col"]
    out = (with_z_key(cells, spark.read.parquet(f"{path}/shapes")).repartitionByRange(n, *order)
           .sortWithinPartitions(*order).write.mode(mode))
    if row_group_bytes:
        out = out.option("parquet.block.size", row_group_bytes)
    out.parquet(f"{path}/spatial")


def _interval(first: int, end: int, bits: int) -> tuple[int, int]:
    """Scaled positions, inclusive, of the 0-based places ``first`` to ``end - 1`` on a side of so many bits."""
    end = min(end, 1 << bits)
    first = max(first, 0)
    return ((first << BITS) >> bits, ((end - 1) << BITS) >> bits) if first < end else (0, -1)


def key_ranges(rows: tuple[int, int], cols: tuple[int, int], max_ranges: int) -> list[tuple[int, int]]:
    """At most ``max_ranges`` ranges of keys, inclusive, that hold all of the scaled rectangle: the curve's squares are
    halved until they lie within it or there are too many; then the remaining squares are taken whole."""
    if rows[0] > rows[1] or cols[0] > cols[1]:
        return []
    whole: list[tuple[int, int]] = []
    open_ = [(0, 0, 0)]  # row, column, level of a square
    for level in range(BITS + 1):
        size, found = 1 << (BITS - level), []
        for r, c, _ in open_:
            if r > rows[1] or r + size <= rows[0] or c > cols[1] or c + size <= cols[0]:
                continue
            if rows[0] <= r and r + size - 1 <= rows[1] and cols[0] <= c and c + size - 1 <= cols[1]:
                whole.append((r, c, level))
            else:
                found.append((r, c, level))
        half = size // 2
        open_ = found
        if not found or level == BITS or len(whole) + 4 * len(found) > max_ranges:
            break
        open_ = [(r + y, c + x, level + 1) for r, c, _ in found for y in (0, half) for x in (0, half)]
    out: list[tuple[int, int]] = []
    for r, c, level in sorted(whole + open_, key=lambda q: _interleave(q[0], q[1])):
        first = _interleave(r, c)
        last = first + (1 << 2 * (BITS - level)) - 1
        if out and out[-1][1] + 1 == first:
            out[-1] = (out[-1][0], last)
        else:
            out.append((first, last))
    return out


def _interleave(r: int, c: int) -> int:
    return sum((r >> k & 1) << 2 * k + 1 | (c >> k & 1) << 2 * k for k in range(BITS))


def rect_filter(shapes: list[tuple[int, int]], x: int, y: int, w: int, h: int, max_ranges: int = 64) -> Column:
    """The scan filter of a rectangle, 0-based and half open, over stored cells of the given shapes."""
    found = []
    for row_bits, col_bits in shapes:
        ranges = key_ranges(_interval(y, y + h, row_bits), _interval(x, x + w, col_bits), max(4, max_ranges // len(shapes)))
        keys = [F.col("zkey").between(a, b) for a, b in ranges]
        if keys:
            found.append((F.col("row_bits") == row_bits) & (F.col("col_bits") == col_bits) & reduce(Column.__or__, keys))
    return reduce(Column.__or__, found, F.lit(False)) & in_rect("col", "row", x + 1, y + 1, w, h)


def search_rect_stored(spark, path: str, x: int, y: int, w: int, h: int, workbook: str | None = None,
                       sheet: str | None = None, max_ranges: int = 64) -> DataFrame:
    """P7 on a stored index: the cells in a rectangle of 0-based coordinates, of all sheets or of one.

    The distinct shapes, at most BITS squared and a few in practice, come to the driver; everything else is a filter of the scan.
    """
    shapes, cells = spark.read.parquet(f"{path}/shapes"), spark.read.parquet(f"{path}/spatial")
    for name, value in (("workbook", workbook), ("sheet", sheet)):
        if value is not None:
            shapes, cells = shapes.filter(F.col(name) == value), cells.filter(F.col(name) == value)
    sizes = sorted((r["row_bits"], r["col_bits"]) for r in shapes.select("row_bits", "col_bits").distinct().collect())
    return cells.filter(rect_filter(sizes, x, y, w, h, max_ranges)).drop("row_bits", "col_bits", "zkey")
