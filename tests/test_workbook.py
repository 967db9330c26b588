"""Workbook source (S1-S4) and workbook-level profiles on hand-made .xlsx files."""

import hashlib

import pytest
from pyspark.sql import functions as F

import xlsx_fixtures as fx
from gridlake.operators import links, profile
from gridlake.sources import workbook as wbk


@pytest.fixture(scope="module")
def books(tmp_path_factory):
    d = tmp_path_factory.mktemp("books")
    paths = {
        "tiny": fx.write_xlsx(d / "tiny.xlsx", fx.tiny()),
        "kinds": fx.write_xlsx(d / "kinds.xlsx", fx.kinds()),
        "kpi_a": fx.write_xlsx(d / "kpi_a.xlsx", fx.kpi(["1 234,56", "1 234,56", "12abc", "-3", None])),
        "many": fx.write_xlsx(d / "many.xlsx", fx.many()),
        "formulas": fx.write_xlsx(d / "formulas.xlsx", fx.formulas()),
        "dense": fx.write_xlsx(d / "dense.xlsx", fx.dense()),
    }
    (d / "bad.xlsx").write_bytes(open(paths["tiny"], "rb").read()[:100])
    paths["bad"] = str(d / "bad.xlsx")
    return d, paths


@pytest.fixture(scope="module")
def cells(spark, books):
    d, _ = books
    files = wbk.workbook_files(spark, str(d))
    return wbk.read_cells(files, target_bytes=2048).cache()


def book(cells, paths, name):
    return cells.filter(F.col("workbook").endswith("/" + name + ".xlsx"))


def test_tiny_profile(cells, books):
    _, paths = books
    c = book(cells, paths, "tiny")
    rows = {(r["row"], r["col"]): r for r in c.collect()}
    assert set(rows) == {(1, 1), (1, 3), (3, 1)}
    assert rows[(1, 3)]["formula"] == "A1*2" and rows[(1, 3)]["kind"] == "formula"
    assert rows[(3, 1)]["value"] == "hello" and rows[(3, 1)]["ref"] == "A3"
    p = profile.sheet_profile(c).first()
    assert (p["n_rows"], p["n_cols"], p["nonempty"], p["has_formulas"]) == (3, 3, 3, True)
    assert abs(p["density"] - 3 / 9) < 1e-12
    ch = profile.sheet_chunks(c).first()
    assert ch["size_bytes"] == 4 * 50 and ch["chunk_id"] == "chunk_0_0"


def test_kinds(cells, books):
    _, paths = books
    got = {r["ref"]: (r["value"], r["kind"]) for r in book(cells, paths, "kinds").collect()}
    assert got["A1"] == ("shared", "text")
    assert got["B1"] == ("inline text", "text")
    assert got["C1"] == ("rich", "text")
    assert got["D1"] == ("TRUE", "text")
    assert got["E1"] == ("#DIV/0!", "text")
    assert got["F1"] == ("2024-01-01", "date")
    assert got["A2"] == ("2.5", "number")
    assert "G1" not in got and "H1" not in got  # empty string and styled empty cell are absent


def test_money_extract(cells, books):
    from gridlake.operators.window import extract_sheet

    _, paths = books
    c = book(cells, paths, "kpi_a").filter((F.col("col") == 2) & (F.col("row") > 1))
    strict = {r["row"]: r["money"] for r in extract_sheet(c).collect()}
    prefix = {r["row"]: r["money"] for r in extract_sheet(c, money_mode="prefix").collect()}
    assert strict == {2: 1234.56, 3: 1234.56, 4: None, 5: -3.0}
    assert prefix[4] == 12.0


def test_many_sheets_chunks_and_patterns(cells, books):
    _, paths = books
    c = book(cells, paths, "many")
    chunks = sorted((r["first_sheet"], r["last_sheet"]) for r in profile.sheet_chunks(c, 50).collect())
    assert chunks == [(0, 49), (50, 99), (100, 119)]
    pats = profile.naming_patterns(profile.sheets(c)).first()["patterns"]
    assert pats == sorted(["underscore_separated", "space_separated", "starts_with_number", "contains_year"])
    groups = profile.structural_groups(profile.sheets(c)).first()["n_groups"]
    assert groups == 1 + 1 + 30 + 30  # "2024", "Total", every "_x{i}" and " y{i}" keeps its whole name


def test_formulas_links_cycle_class(spark, cells, books):
    _, paths = books
    c = book(cells, paths, "formulas")
    cls = profile.formula_complexity(c).first()
    assert cls["n_formulas"] == 10 and cls["n_complex"] == 4 and cls["cls"] == "complex"
    ln = links.formula_links(c.filter(F.col("formula").isNotNull()))
    refs = {(r["ref"], r["target_sheet"], r["target_row"], r["target_col"]) for r in ln.collect()}
    assert ("D4", None, None, None) not in refs
    assert ("B4", "Calc", 10, None) not in refs  # LOG10( is a function, not a cell
    assert ("A5", "Data", 2, 2) in refs and ("A3", "Missing", 3, 3) in refs
    assert links.dangling_links(ln, c).select("target_sheet").distinct().collect()[0][0] == "Missing"
    edges = ln.filter(F.col("target_end_row").isNull() & (F.col("target_sheet") == F.col("sheet"))).select(
        F.col("ref").alias("src"), F.concat(F.lit("@"), F.col("target_row"), F.lit(":"), F.col("target_col")).alias("dst"))
    named = c.select("ref", F.concat(F.lit("@"), F.col("row"), F.lit(":"), F.col("col")).alias("dst"))
    e2 = edges.join(named.withColumnRenamed("ref", "dst_ref"), "dst").select("src", F.col("dst_ref").alias("dst"))
    core = {r["node"] for r in links.cyclic_core(e2).collect()}
    assert core == {"A1", "B1"}


def test_dense_hot_zones_skip_last_window(cells, books):
    _, paths = books
    z = profile.hot_zones(book(cells, paths, "dense")).collect()
    assert {r["first_row"] for r in z} == {1, 11}  # start rows 0 and 10 only (D14)
    z_all = profile.hot_zones(book(cells, paths, "dense"), include_tail=True).collect()
    assert {r["first_row"] for r in z_all} == {1, 11, 21}


def test_bad_file_is_an_error_row(spark, books):
    d, paths = books
    files = wbk.workbook_files(spark, str(d))
    errs = wbk.workbook_errors(wbk.sheet_listing(files)).collect()
    assert [r["path"].split("/")[-1] for r in errs] == ["bad.xlsx"]


def test_metadata_and_size_filter(spark, books):
    d, paths = books
    files = wbk.workbook_files(spark, str(d))
    listing = wbk.sheet_listing(files)
    cells = wbk.read_cells(files, listing)
    meta = {r["workbook"].split("/")[-1]: r for r in wbk.workbook_metadata(files, cells, listing).collect()}
    raw = open(paths["many"], "rb").read()
    assert meta["many.xlsx"]["checksum"] == hashlib.sha256(raw).hexdigest()
    assert meta["many.xlsx"]["sheets_count"] == 120
    assert meta["many.xlsx"]["complexity_score"] == 10.0  # capped
    assert meta["many.xlsx"]["memory_estimate"] == 1024 * 1024 + 120 * 500 * 1024
    small = wbk.workbook_files(spark, str(d), max_file_size=len(raw) - 1)
    assert "many.xlsx" not in {r["path"].split("/")[-1] for r in small.select("path").collect()}


def test_fast_and_fallback_parsers_agree():
    import io
    import zipfile

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    fast_xml = (f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c>'
                '<c r="B1" s="1" t="str"><f t="shared" si="0" ref="B1:B2">A1&amp;"x"</f><v>ax</v></c></row>'
                '<row r="2"><c r="A2"><v>2</v></c><c r="B2" t="str"><f t="shared" si="0"/><v>2x</v></c>'
                '<c r="C2" t="inlineStr"><is><t>a &lt; b</t></is></c></row></sheetData></worksheet>')
    # same cells written with t before r and rows/cells without coordinates: the fallback path
    slow_xml = (f'<worksheet xmlns="{main}"><sheetData><row><c t="s" r="A1"><v>0</v></c>'
                '<c t="str" s="1" r="B1"><f t="shared" si="0" ref="B1:B2">A1&amp;"x"</f><v>ax</v></c></row>'
                '<row><c><v>2</v></c><c t="str"><f t="shared" si="0"/><v>2x</v></c>'
                '<c t="inlineStr"><is><t>a &lt; b</t></is></c></row></sheetData></worksheet>')
    frames = []
    for xml in (fast_xml, slow_xml):
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            z.writestr("s.xml", xml)
        with zipfile.ZipFile(buf) as z:
            df = __import__("pandas").concat(list(wbk.parse_sheet_frames(z, "s.xml", ["hello"], set()))).astype(object)
            frames.append(sorted(tuple(None if x != x else x for x in r) for r in df.values.tolist()))
    assert frames[0] == frames[1]
    got = {(r[0], r[1]): (r[2], r[3]) for r in frames[0]}
    assert got[(1, 1)] == ("hello", None)
    assert got[(2, 2)] == ("2x", 'A2&"x"')  # a shared formula's dependent gets the master's text, moved
    assert got[(2, 3)] == ("a < b", None)


def test_chunks_count_empty_sheets(spark, tmp_path):
    p = fx.write_xlsx(tmp_path / "gaps.xlsx", [("a", {(1, 1): 1}), ("b", {}), ("c", {(1, 1): 1, (1, 2): 2}), ("d", {})])
    files = wbk.workbook_files(spark, str(tmp_path))
    listing = wbk.sheet_listing(files)
    cells = wbk.read_cells(files, listing)
    sheets = listing.select(F.col("path").alias("workbook"), "sheet", "sheet_idx")
    got = sorted((r["chunk_id"], r["size_bytes"]) for r in profile.sheet_chunks(cells, 2, sheets=sheets).collect())
    assert got == [("chunk_0_1", 50), ("chunk_2_3", 100)]
    without = sorted(r["chunk_id"] for r in profile.sheet_chunks(cells, 2).collect())
    assert without == ["chunk_0_0", "chunk_2_2"]


def test_profile_lists_empty_sheets(spark, tmp_path):
    p = fx.write_xlsx(tmp_path / "gaps.xlsx", [("a", {(1, 1): 1}), ("b", {})])
    files = wbk.workbook_files(spark, str(tmp_path))
    listing = wbk.sheet_listing(files)
    sheets = listing.select(F.col("path").alias("workbook"), "sheet", "sheet_idx")
    got = {r["sheet"]: (r["n_rows"], r["n_cols"], r["density"], r["has_formulas"])
           for r in profile.sheet_profile(wbk.read_cells(files, listing), sheets).collect()}
    assert got == {"a": (1, 1, 1.0, False), "b": (0, 0, 0.0, False)}


def test_one_call_compositions(spark, books):
    from gridlake.plans import workbooks as wb

    d, _ = books
    a = wb.analyse_files(spark, str(d), chunk_size=50, now_seconds=1_700_000_000)
    many = a["chunks"].filter(F.col("workbook").endswith("many.xlsx")).orderBy("first_sheet").collect()
    assert [r["chunk_id"] for r in many] == ["chunk_0_49", "chunk_50_99", "chunk_100_119"]
    assert many[0]["next_chunk"] == "chunk_50_99" and many[0]["cursor"]
    assert [r["path"].split("/")[-1] for r in a["errors"].collect()] == ["bad.xlsx"]
    assert a["tokens"].select("optimal_chunk_tokens").distinct().collect()[0][0] == 144000
    nav = wb.build_navigation(a["cells"], a["sheets"], window_size=100)
    assert nav["profiles"].count() == a["sheets"].count()
    q = wb.query_cells(a["cells"], text="hello", lo=1, hi=3, max_results=10, context=True)
    locs = {r["location"] for r in q["hits"].collect()}
    assert "Sheet1!A3" in locs and "Sheet1!A1" in locs
    known = a["metadata"].filter(F.col("workbook").endswith("many.xlsx")).select("workbook", "checksum")
    nav = wb.build_navigation(a["cells"], a["sheets"], window_size=100, metadata=a["metadata"], known=known, now_seconds=1_700_000_000)
    rows = {r["workbook"].split("/")[-1]: r for r in nav["control"].collect()}
    assert rows["many.xlsx"]["checksum_match"] and rows["many.xlsx"]["ttl"] == 600 and rows["many.xlsx"]["next_cursor"]
    assert all(not r["checksum_match"] and r["ttl"] == 300 and r["next_cursor"] is None for n, r in rows.items() if n != "many.xlsx")
    assert rows["many.xlsx"]["used"] > 100 and rows["many.xlsx"]["remaining"] == 180_000 - rows["many.xlsx"]["used"]


def test_query_pages_and_budget(spark):
    from gridlake.plans import workbooks as wb
    from gridlake.sources.tables import with_cell_fields

    rows = [("w", "S", 0, r, c, f"v{r}" if c == 1 else str(r * c)) for r in range(1, 21) for c in (1, 2, 3)]
    cells = with_cell_fields(spark.createDataFrame(rows, "workbook string, sheet string, sheet_idx int, row long, col int, value string"))
    seen, after = [], None
    while True:
        hits = wb.query_cells(cells, lo=10, hi=31, exact="v3", rect=(0, 17, 1, 9), max_results=7, after=after)["hits"].orderBy("row", "col").collect()
        seen += [(r["row"], r["col"]) for r in hits]
        if not hits or not hits[-1]["has_more"]:
            break
        after = {c: hits[-1][c] for c in ("workbook", "sheet", "row", "col")}
    assert seen == sorted((r, c) for _, _, _, r, c, v in rows if v == "v3" or (c > 1 and 10 <= r * c < 31) or (c == 1 and r >= 18))
    few = wb.query_cells(cells, rect=(0, 0, 1, 99), max_results=50, max_tokens=5)["hits"].collect()
    assert [r["tokens_used"] for r in few] == [1, 2, 3, 4, 5] and all(r["has_more"] for r in few)
    assert wb.query_cells(cells, rect=(0, 0, 1, 2), max_tokens=0)["hits"].count() == 1


def sheet_xml(body, prefix="", ns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"):
    p = f"{prefix}:" if prefix else ""
    return f'<{p}worksheet xmlns{":" + prefix if prefix else ""}="{ns}"><{p}sheetData>{body}</{p}sheetData></{p}worksheet>'


def raw_workbook(path, parts, sheets=("s1",), ns="http://schemas.openxmlformats.org/spreadsheetml/2006/main",
                 rel="http://schemas.openxmlformats.org/officeDocument/2006/relationships", props=""):
    import zipfile

    names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
    rels = "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}">{props}<sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        for name, text in parts.items():
            z.writestr(name, text)


def read_all(spark, folder, **kw):
    files = wbk.workbook_files(spark, str(folder), **kw)
    listing = wbk.sheet_listing(files)
    raw = wbk.read_raw(files, listing)
    cells = {(r["workbook"].rpartition("/")[2], r["sheet"], r["ref"]): (r["value"], r["formula"]) for r in wbk.cells_of(raw).collect()}
    errors = {(r["path"].rpartition("/")[2], r["sheet"]): r["error"] for r in wbk.workbook_errors(listing, raw).collect()}
    return cells, errors, listing


def test_prefixed_and_strict_namespaces_paths_and_folders(spark, tmp_path):
    row = '<{0}row r="1"><{0}c r="A1"><{0}v>7</{0}v></{0}c><{0}c r="B1" t="inlineStr"><{0}is><{0}t>a &lt;x: b</{0}t></{0}is></{0}c></{0}row>'
    part = "xl/worksheets/sheet1.xml"
    strict, strict_rel = "http://purl.oclc.org/ooxml/spreadsheetml/main", "http://purl.oclc.org/ooxml/officeDocument/relationships"
    (tmp_path / "sub dir").mkdir()
    raw_workbook(tmp_path / "a b 100%.xlsx", {part: sheet_xml(row.format(""))})
    raw_workbook(tmp_path / "bilan_\u00e9t\u00e9.XLSX", {part: sheet_xml(row.format("x:"), "x")})
    raw_workbook(tmp_path / "sub dir" / "strict.xlsm", {part: sheet_xml(row.format(""), ns=strict)}, ns=strict, rel=strict_rel)
    cells, errors, _ = read_all(spark, tmp_path)
    assert not errors
    for name in ("a b 100%.xlsx", "bilan_\u00e9t\u00e9.XLSX", "strict.xlsm"):
        assert cells[name, "s1", "A1"] == ("7", None) and cells[name, "s1", "B1"] == ("a <x: b", None)


def test_every_listed_sheet_is_parsed_empty_or_an_error(spark, tmp_path):
    good = sheet_xml('<row r="1"><c r="A1"><v>1</v></c></row>')
    raw_workbook(tmp_path / "m.xlsx", {
        "xl/worksheets/sheet1.xml": good, "xl/worksheets/sheet2.xml": sheet_xml(""),
        "xl/worksheets/sheet3.xml": sheet_xml('<row r="1"><c t="n" r="A1"><v>1</v></row>'),
        "xl/worksheets/sheet5.xml": good.replace("</sheetData></worksheet>", "<row r='2'><c r='A2'><v>5</v>"),
    }, sheets=("good", "empty", "broken", "absent", "cut"))
    (tmp_path / "no.xlsx").write_bytes(b"not a zip")
    cells, errors, listing = read_all(spark, tmp_path)
    assert set(errors) == {("m.xlsx", "broken"), ("m.xlsx", "absent"), ("m.xlsx", "cut"), ("no.xlsx", None)}
    assert {k[1] for k in cells} == {"good", "cut"}  # what stands before the fault is kept
    listed = {r["sheet"] for r in listing.filter("error is null").collect()}
    assert listed == {"good", "empty", "broken", "absent", "cut"}
    big = wbk.oversized_files(spark, str(tmp_path), 20).collect()
    assert [r["path"].rpartition("/")[2] for r in big] == ["m.xlsx"] and "over the limit" in big[0]["error"]


def test_shared_formulas_move_across_both_parsers(spark, tmp_path):
    body = ('<row r="1"><c r="B1"><f t="shared" ref="B1:B3" si="0">A1+$A$1+SUM(A:A)+Other!C1&amp;"A1"</f><v>1</v></c></row>'
            '<row r="2"><c r="B2"><f t="shared" si="0"/><v>1</v></c></row>'
            '<row r="3"><c t="n" r="C3"><f t="shared" si="0"/><v>1</v></c></row>')
    raw_workbook(tmp_path / "f.xlsx", {"xl/worksheets/sheet1.xml": sheet_xml(body)})
    cells, errors, _ = read_all(spark, tmp_path)
    assert not errors
    assert cells["f.xlsx", "s1", "B2"][1] == 'A2+$A$1+SUM(A:A)+Other!C2&"A1"'
    assert cells["f.xlsx", "s1", "C3"][1] == 'B3+$A$1+SUM(B:B)+Other!D3&"A1"'


def test_shift_formula():
    from gridlake.functions.shift import shift_formula

    assert shift_formula("LOG10(A1)+a$2+$B3+'It''s A1'!B2+[1]Ext!C1+T1_x+1:2", 1, 1) == "LOG10(B2)+B$2+$B4+'It''s A1'!C3+[1]Ext!D2+T1_x+2:3"
    assert shift_formula("A1+B2", -1, 0) == "#REF!+B1"
    assert shift_formula("XFD1", 0, 1) == "#REF!"


def test_date_systems():
    assert wbk.serial_to_iso(1) == "1900-01-01" and wbk.serial_to_iso(59) == "1900-02-28"
    assert wbk.serial_to_iso(60) == "1900-02-29" and wbk.serial_to_iso(61) == "1900-03-01"
    assert wbk.serial_to_iso(45292.5) == "2024-01-01 12:00:00" and wbk.serial_to_iso(0, True) == "1904-01-01"


def test_a_storage_error_is_raised_not_skipped(tmp_path):
    import pyarrow as pa

    task = pa.RecordBatch.from_pylist([{"path": str(tmp_path / "gone.xlsx"), "sheets": [{"sheet_idx": 0, "sheet": "s", "part": "p"}]}])
    with pytest.raises(OSError):
        list(wbk._parse_fn(10)(iter([task])))
