"""Workbooks written from cells, and read back through the data source."""

from pyspark.sql import functions as F
from xlsx_fixtures import write_xlsx

from gridlake.sinks.workbooks import write_workbooks
from gridlake.sources import datasource as ds
from gridlake.sources import workbook as wbk
from gridlake.sources.tables import with_cell_fields

CELL = "workbook string, sheet string, sheet_idx int, row long, col int, value string, formula string"
KEY = ["sheet", "sheet_idx", "row", "col", "value", "num", "formula", "kind"]


def books(spark, n_rows=30):
    odd = ["plain", "  two  blanks ", "<&>\"'", "é日本\U0001f600", "line\nbreak", "1.50", "-7", "=not", "bad\x02char"]
    rows = [(f"B/{b} %é", f"S {s}'<", s, r, c, odd[(r + c) % len(odd)], "SUM(A1:B2)&\"<\"" if (r + c) % 5 == 0 else None)
            for b in range(3) for s in range(4) for r in range(1, n_rows, 2) for c in (1, 3, 28)]
    rows += [("B/0 %é", "only formulas", 4, 9, 2, None, "A1+1")]
    return with_cell_fields(spark.createDataFrame(rows, CELL))


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*KEY).collect()), key=str)


def test_workbooks_round_trip(spark, tmp_path):
    cells = books(spark)
    out = write_workbooks(cells, str(tmp_path / "x y"))
    assert sorted(r["workbook"] for r in out.collect()) == ["B/0 %é", "B/1 %é", "B/2 %é"]
    assert len(list((tmp_path / "x y").glob("*.xlsx"))) == 3 and not list((tmp_path / "x y" / "_unfinished").iterdir())
    raw = spark.read.format(ds.register(spark)).load(str(tmp_path / "x y"))
    want = cells.withColumn("value", F.translate("value", "\x02", "�"))
    assert rows_of(wbk.cells_of(raw)) == rows_of(want)
    assert rows_of(wbk.read_cells(wbk.workbook_files(spark, str(tmp_path / "x y")))) == rows_of(want)


def test_partitions_are_planned_by_bytes(spark, tmp_path):
    write_workbooks(books(spark, 300), str(tmp_path / "b")).count()
    sizes = sorted(f.stat().st_size for f in (tmp_path / "b").glob("*.xlsx"))
    plan = lambda split: ds.WorkbookReader({"path": str(tmp_path / "b"), "splitBytes": str(split)}).partitions()
    assert len(plan(1 << 30)) == 1 and len(plan(1 << 30)[0].files) == 3
    cut = plan(sizes[0] // 3)
    assert len(cut) == sum(-(-s // (sizes[0] // 3)) for s in sizes)
    read = spark.read.format(ds.register(spark))
    whole = rows_of(wbk.cells_of(read.load(str(tmp_path / "b"))))
    parts = read.option("splitBytes", sizes[0] // 3).load(str(tmp_path / "b"))
    assert parts.rdd.getNumPartitions() == len(cut) and rows_of(wbk.cells_of(parts)) == whole
    small = read.option("maxFileSize", 10).load(str(tmp_path / "b"))
    assert small.count() == 0


def test_filters_are_pushed(spark, tmp_path):
    write_workbooks(books(spark), str(tmp_path / "b")).count()
    df = spark.read.format(ds.register(spark)).load(str(tmp_path / "b"))
    got = df.filter((F.col("row") >= 5) & (F.col("row") < 11) & F.col("sheet").isin("S 1'<", "S 2'<") & (F.col("sheet_idx") == 2))
    want = books(spark).filter("row >= 5 and row < 11 and sheet_idx = 2")
    assert got.count() == want.count() > 0
    assert df.filter("row = 7 and sheet_idx > 3").count() == 0 and df.filter("sheet = 'nowhere'").count() == 0
    assert df.filter("row > 4 and value = '-7'").count() == books(spark).filter("row > 4 and value = '-7'").count()
    w = ds.Wanted()
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThan

    assert all(map(w.take, [GreaterThan(("row",), 4), LessThan(("row",), 9), In(("sheet",), ("a", "b")), EqualTo(("sheet",), "b"), EqualTo(("sheet_idx",), 2)]))
    assert not any(map(w.take, [IsNotNull(("row",)), In(("row",), (1,)), EqualTo(("value",), "x"), EqualTo(("a", "row"), 1)]))
    assert (w.low, w.high, w.sheets) == ({"row": 5, "sheet_idx": 2}, {"row": 8, "sheet_idx": 2}, {"b"})


def test_bad_files_are_error_rows(spark, tmp_path):
    write_xlsx(tmp_path / "good.xlsx", [("S", {(1, 1): "a", (2, 1): 5})])
    (tmp_path / "bad.xlsx").write_bytes(b"no zip at all")
    (tmp_path / "notes.txt").write_text("x")
    df = spark.read.format(ds.register(spark)).load(str(tmp_path))
    assert sorted(r["value"] for r in wbk.cells_of(df).collect()) == ["5", "a"]
    (bad,) = df.filter("error is not null").collect()
    assert bad["workbook"].endswith("bad.xlsx") and bad["error"]
    one = spark.read.format(ds.NAME).load(str(tmp_path / "good.xlsx"))
    assert one.count() == 2


def test_sheet_groups_share_partitions(spark, tmp_path):
    write_workbooks(books(spark), str(tmp_path / "b")).count()
    files = wbk.workbook_files(spark, str(tmp_path / "b"))
    raw = wbk.read_raw(files, target_bytes=1)
    cores = spark.sparkContext.defaultParallelism
    assert raw.rdd.getNumPartitions() == min(13, 4 * cores)
    assert rows_of(wbk.cells_of(raw)) == rows_of(wbk.cells_of(wbk.read_raw(files)))
