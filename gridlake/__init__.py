"""gridlake: analytics over very many spreadsheet grids, expressed as Spark DataFrame work.

A workbook (or any table) becomes a long ``cells`` DataFrame with one row per non-empty cell::

    workbook STRING, sheet STRING, sheet_idx INT, row BIGINT, col INT, ref STRING,
    value STRING, num DOUBLE, formula STRING, kind STRING

Every public function takes and returns DataFrames or Columns; nothing is collected to the
driver except a single query string's tokens or a couple of scalar bounds.
"""

from gridlake.schema import CELL_COLUMNS, CELLS_SCHEMA, LOCATION

__all__ = ["CELL_COLUMNS", "CELLS_SCHEMA", "LOCATION"]
