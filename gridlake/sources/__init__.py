"""Sources: workbook files (binaryFile), any table as a sheet, delta files."""
