"""Event exports (K1-K3, K6), budgeted export (K4) and the persisted index (K5)."""

import gzip
import json
from pathlib import Path

from pyspark.sql import functions as F

from gridlake.operators import index as ix
from gridlake.sinks import events, export


def _cells(spark):
    rows = [("wb", "S", 0, 1, 1, "a"), ("wb", "S", 0, 1, 3, "c"), ("wb", "S", 0, 3, 2, "x"),
            ("wb", "S", 0, 250, 1, "last"), ("wb", "T", 1, 1, 1, "t")]
    return spark.createDataFrame(rows, "workbook string, sheet string, sheet_idx int, row long, col int, value string")


def _read_lines(path):
    out = []
    for f in sorted(Path(path).glob("part-*")):
        data = gzip.decompress(f.read_bytes()) if f.suffix == ".gz" else f.read_bytes()
        out += [json.loads(x) for x in data.decode().splitlines() if x]
    return out


def test_row_batch_events_order_and_content(spark, tmp_path):
    ev = events.row_batch_events(_cells(spark), batch_rows=100)
    events.write_events(ev, str(tmp_path / "ev"), compression="gzip", files=3)
    lines = _read_lines(tmp_path / "ev")
    kinds = [x["type"] for x in lines]
    assert kinds == ["metadata", "sheet_start", "rows", "rows", "rows", "sheet_complete",
                     "sheet_start", "rows", "sheet_complete", "complete"]
    assert lines[0]["data"] == {"chunk_id": "chunk_0_1", "sheets_range": [0, 1], "streaming": True}
    assert lines[1]["data"] == {"sheet_index": 0, "sheet_name": "S", "total_rows": 250}
    first = lines[2]["data"]
    assert first["start_row"] == 0 and first["sheet_name"] == "S" and first["sheet_index"] == 0
    assert first["rows"][0] == ["a", "", "c"] and first["rows"][1] == [] and first["rows"][2] == ["", "x"]
    assert len(first["rows"]) == 100 and lines[3]["data"]["start_row"] == 100 and lines[3]["data"]["rows"] == [[]] * 100
    assert lines[4]["data"]["rows"][-1] == ["last"] and len(lines[4]["data"]["rows"]) == 50
    assert lines[5] == {"sheet_index": 0, "sheet_name": "S", "type": "sheet_complete"}
    assert lines[-1] == {"chunk_id": "chunk_0_1", "type": "complete"}
    raw = gzip.decompress(sorted(Path(tmp_path / "ev").glob("part-*"))[0].read_bytes()).decode().splitlines()[0]
    assert raw.startswith('{"data":{"chunk_id"')  # sorted keys, as the reference writes maps
    back = events.read_events(spark, str(tmp_path / "ev"))  # K6: gzip decoded by extension
    assert back.count() == len(lines)
    chunked = events.row_batch_events(_cells(spark), batch_rows=100, chunk_size=1)
    metas = sorted(json.loads(r["line"])["data"]["chunk_id"] for r in chunked.collect() if '"metadata"' in r["line"])
    assert metas == ["chunk_0_0", "chunk_1_1"]


def test_window_events(spark):
    ev = events.window_events(_cells(spark), "S", 0, 4, 1, 2, batch_rows=2)
    got = sorted((r["seq"]["p"], r["seq"]["i"], r["line"]) for r in ev.collect())
    parsed = [json.loads(x[2]) for x in got]
    assert [p["type"] for p in parsed] == ["window_start", "window_data", "window_data", "window_data", "window_complete"]
    assert parsed[0]["data"] == {"rows": 5, "sheet_name": "S",
                                 "window": {"start_row": 0, "end_row": 4, "start_col": 1, "end_col": 2}}
    assert parsed[1]["data"] == {"rows": [["", "c"], None], "start_row": 0}
    assert parsed[2]["data"] == {"rows": [["x"], None], "start_row": 2}
    assert parsed[4] == {"type": "window_complete"}


def test_envelope(spark):
    line = spark.range(1).select(events.envelope("error", F.struct(F.lit("boom").alias("message")))).first()[0]
    assert line == '{"data":{"message":"boom"},"type":"error"}'


def test_budgeted_export(spark, tmp_path):
    items = spark.createDataFrame([(1, "a" * 100), (2, "b " * 1800), (3, "c" * 5000)], "id int, text string")
    plan = {r["id"]: (r["tokens"], r["method"], len(r["payload"])) for r in export.plan_export(items, "text", 1000).collect()}
    assert plan[1] == (25, "none", 100)
    assert plan[2][1] == "brotli-4"
    assert plan[3][1] == "brotli-11-truncated" and plan[3][2] == 2800 + len("... [truncated]")
    export.write_budgeted(items, "text", 1000, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out/none")).count() == 1
    assert spark.read.text(str(tmp_path / "out/gzip")).count() == 2
    assert any(p.suffix == ".gz" for p in (tmp_path / "out/gzip").glob("part-*"))


def test_persisted_index_prunes(spark, tmp_path):
    cells = spark.createDataFrame(
        [("wb", "S", 0, r, c, f"word{r % 50} col{c}", float(r * c)) for r in range(1, 400) for c in range(1, 4)],
        "workbook string, sheet string, sheet_idx int, row long, col int, value string, num double")
    cells = cells.withColumn("ref", F.lit(None).cast("string")).withColumn("formula", F.lit(None).cast("string")) \
                 .withColumn("kind", F.lit("text"))
    ix.write_index(cells, str(tmp_path / "idx"), files_per_table=4)
    t = ix.read_index(spark, str(tmp_path / "idx"))
    hits = t["postings"].filter(F.col("token") == "word7")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(token,word7)" in plan
    assert hits.count() == 8 * 3
    assert t["numeric_index"].filter((F.col("num") >= 10) & (F.col("num") < 20)).count() == \
        cells.filter((F.col("num") >= 10) & (F.col("num") < 20)).count()


def test_fetch_cells_page(spark, tmp_path):
    from gridlake.operators import search as sr

    cells = spark.createDataFrame([("wb", "S", r, c, f"v{r}_{c}") for r in range(1, 300) for c in range(1, 4)],
                                  "workbook string, sheet string, row long, col int, value string")
    cells.sortWithinPartitions("workbook", "sheet", "row", "col").write.parquet(str(tmp_path / "c"))
    t = spark.read.parquet(str(tmp_path / "c"))
    page = t.filter(F.col("value").endswith("_2")).select("workbook", "sheet", "row", "col")
    got = sr.fetch_cells(t, sr.top_hits(page, 5))
    assert sorted(r["value"] for r in got.collect()) == [f"v{r}_2" for r in range(1, 6)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "In(row, [1,2,3,4,5])" in plan and "EqualTo(sheet,S)" in plan
