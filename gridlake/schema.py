"""Canonical schemas shared by the library."""

from pyspark.sql import types as T

CELLS_SCHEMA = T.StructType(
    [
        T.StructField("workbook", T.StringType()),
        T.StructField("sheet", T.StringType()),
        T.StructField("sheet_idx", T.IntegerType()),
        T.StructField("row", T.LongType()),
        T.StructField("col", T.IntegerType()),
        T.StructField("ref", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("num", T.DoubleType()),
        T.StructField("formula", T.StringType()),
        T.StructField("kind", T.StringType()),
    ]
)
CELL_COLUMNS = [f.name for f in CELLS_SCHEMA.fields]

# A cell location: the key of every index table and search result.
LOCATION = ["workbook", "sheet", "row", "col"]

# A change to one cell (batch or streaming source S8).
DELTA_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("event_ts", T.TimestampType()),
        T.StructField("workbook", T.StringType()),
        T.StructField("sheet", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("old_value", T.StringType()),
        T.StructField("new_value", T.StringType()),
        T.StructField("affected_cells", T.IntegerType()),
    ]
)
