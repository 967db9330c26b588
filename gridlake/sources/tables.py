"""S9 table-as-sheet adapter and W1 distributed row numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions.a1 import cell_ref
from gridlake.functions.values import cell_kind, parse_number
from gridlake.schema import CELL_COLUMNS
from gridlake.session import write_table


def number_rows(df: DataFrame, order_cols: Sequence[str], row_col: str = "row", partitions: int | None = None) -> DataFrame:
    """1-based row numbers in ``order_cols`` order without an un-partitioned window.

    ``order_cols`` together must be unique (equal rows are numbered in any order) and may be of any type with an
    order; nulls come first.  Rows are range-partitioned by *all* order columns, so a first key that holds half of the
    rows is spread by the others, sorted, and written to the shared folder with their partition and place in it: a lost
    executor cannot move a row.  A row's number is its place plus the rows of the partitions before, from a table of one
    count per partition (as many rows as ``partitions``, by default ``spark.sql.shuffle.partitions``, so its broadcast
    has that bound).
    """
    cols = [F.col(c) for c in order_cols]
    ranged = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    # the id holds the partition above 33 bits of place
    placed = write_table(ranged.sortWithinPartitions(*cols).withColumn("_id", F.monotonically_increasing_id()), "rows")
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg((F.max(place) + 1).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (placed.join(F.broadcast(offsets), part == F.col("_part"))
            .withColumn(row_col, (F.col("_offset") + place + 1).cast("bigint")).drop("_id", "_part", "_offset"))


def decimal_text(c) -> Column:
    """A double as spreadsheet text with two decimals (``73.0`` -> ``73.00``)."""
    return to_decimal(c).cast("string")


def to_decimal(c) -> Column:
    """A double as a two-decimal number (its cell text is ``73.00``, its ``num`` 73.0)."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("decimal(18,2)")


def _letters(n: int) -> str:
    s = ""
    while n:
        n, r = divmod(n - 1, 26)
        s = chr(65 + r) + s
    return s


def with_cell_fields(cells: DataFrame) -> DataFrame:
    """Add ``ref``, ``num`` and ``kind`` (and a null ``formula``) where absent to (…, row, col, value)."""
    if "formula" not in cells.columns:
        cells = cells.withColumn("formula", F.lit(None).cast("string"))
    if "ref" not in cells.columns:
        cells = cells.withColumn("ref", cell_ref("col", "row"))
    if "num" not in cells.columns:
        cells = cells.withColumn("num", parse_number("value"))
    return cells.withColumn("kind", cell_kind("value", "num", "formula"))


def table_to_cells(df: DataFrame, sheet: str, key: str | Sequence[str], columns: Sequence[Column],
                   sheet_idx: int = 0, workbook: str = "tables") -> DataFrame:
    """A table as one sheet of the ``cells`` model.

    Row = rank by ``key`` (W1); column i (1-based) = ``columns[i-1]`` as text; null and empty
    texts are absent cells, as in a workbook.  A numeric column's ``num`` is the value itself
    (no text round trip); a text column's is parsed (F7).  The column letters are constants of
    the plan.  One ``inline`` of an array of (col, ref prefix, value, num) structs, no shuffle
    beyond the numbering's bucket sort.
    """
    keys = [key] if isinstance(key, str) else list(key)
    vals = [c.alias(f"_v{i + 1}") for i, c in enumerate(columns)]
    numbered = number_rows(df.select(*[F.col(k) for k in keys], *vals), keys)
    types = dict(numbered.dtypes)
    structs = []
    for i in range(len(vals)):
        v = F.col(f"_v{i + 1}")
        text = v.cast("string")
        numeric = types[f"_v{i + 1}"].startswith(("int", "bigint", "smallint", "tinyint", "double", "float", "decimal"))
        num = v.cast("double") if numeric else parse_number(text)
        structs.append(F.struct(F.lit(i + 1).alias("col"), F.lit(_letters(i + 1)).alias("_letters"),
                                text.alias("value"), num.alias("num")))
    cells = (numbered.select(F.lit(workbook).alias("workbook"), F.lit(sheet).alias("sheet"),
                             F.lit(sheet_idx).cast("int").alias("sheet_idx"), "row", F.inline(F.array(*structs)))
             .filter(F.col("value").isNotNull() & (F.col("value") != ""))
             .withColumn("ref", F.concat("_letters", F.col("row").cast("string"))).drop("_letters"))
    return with_cell_fields(cells).select(*CELL_COLUMNS)
