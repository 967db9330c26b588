"""Null keys, uneven keys, wide shapes, changed formulas, odd names: rows that the driver tables do not hold."""

import json
import random
import re

from pyspark.sql import functions as F

from gridlake.functions.values import tokenize
from gridlake.operators import budget as bo
from gridlake.operators import compare as cm
from gridlake.operators import index as ix
from gridlake.operators import links as lk
from gridlake.operators import search as sr
from gridlake.operators import window as wn
from gridlake.sinks import events as evs
from gridlake.sinks import export as xp
from gridlake.sources.tables import number_rows, with_cell_fields
from gridlake.streaming import deltas as dl
from gridlake.streaming import hotkeys
from gridlake.streaming import metrics as mt


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return df._jdf.queryExecution().executedPlan().toString()


def cells_of(spark, rows):
    """(workbook, sheet, sheet_idx, row, col, value, formula) rows as cells."""
    df = spark.createDataFrame(rows, "workbook string, sheet string, sheet_idx int, row long, col int, value string, formula string")
    return with_cell_fields(df).select("workbook", "sheet", "sheet_idx", "row", "col", "ref", "value", "num", "formula", "kind")


def test_row_numbers_with_null_keys_and_uneven_keys(spark):
    keys = [None, None, 5, 2 ** 50, 2 ** 53 + 1, 2 ** 53, -3] + list(range(100, 700))
    rows = [(k, i) for i, k in enumerate(keys)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k long, i int")
    got = [(r["k"], r["i"]) for r in number_rows(df, ["k", "i"], partitions=50).orderBy("row").collect()]
    assert got == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    none = spark.createDataFrame([(None, 2), (None, 1)], "k long, i int")
    assert [(r["row"], r["i"]) for r in number_rows(none, ["k", "i"]).orderBy("row").collect()] == [(1, 1), (2, 2)]
    assert number_rows(df.limit(0), ["k", "i"]).collect() == []


def test_null_keys_and_times_are_kept(spark):
    rows = [(k, None if i % 7 == 0 else f"2024-01-0{1 + i % 3} 00:{i:02d}:00", i) for i in range(40) for k in (None, "a")]
    df = spark.createDataFrame(rows, "k string, t string, i int").withColumn("ts", F.to_timestamp("t"))
    acc = hotkeys.hot_key_accesses(df, ["k"], "ts", "i")
    assert acc.count() == len(rows)
    s = {r["k"]: (r["accesses"], r["hits"]) for r in hotkeys.hot_key_stats(acc, ["k"]).collect()}
    assert s[None] == s["a"] and s["a"][0] == 40
    assert mt.gap_sessions(df.filter("ts is not null"), ["k"], "ts", "i", 600).count() == df.filter("ts is not null").count()
    items = spark.createDataFrame([(None, 1, "x" * 40), (None, 2, "y" * 40), ("g", 1, "x" * 40), ("g", None, "n" * 8)], "g string, p int, text string")
    r = bo.running_budget(items.withColumn("tok", F.lit(10)), ["g"], ["p"], "tok", 15)
    assert {(x["g"], x["p"]): (x["cum_tokens"], x["kept"]) for x in r.collect()} == {
        (None, 1): (10, True), (None, 2): (20, False), ("g", None): (10, True), ("g", 1): (20, False)}
    t = bo.truncate_items(items, ["g"], ["p"], "text", 10).collect()
    assert sorted((x["g"] or "", x["pos"], x["text"]) for x in t) == [
        ("", 0, "x" * 40), ("", 1, "... [truncated]"), ("g", 0, "n" * 8), ("g", 1, "x" * 32 + "... [truncated]")]


def test_priority_field_that_does_not_fit_comes_again_and_is_cut(spark):
    rows = [("m", "metadata", "m" * 100), ("m", "index", "i" * 8), ("m", "alpha", "a" * 12), ("m", "zeta", "z"), (None, "b", "bb")]
    df = spark.createDataFrame(rows, "g string, field string, value string")
    got = {(r["g"], r["field"]): r["value"] for r in bo.truncate_fields(df, ["g"], target=10).collect()}
    assert got == {("m", "index"): "i" * 8, ("m", "alpha"): "a" * 12, ("m", "metadata"): "m" * 20 + "... [truncated]", ("m", "_truncated"): "true",
                   (None, "b"): "bb", (None, "_truncated"): "true"}
    full = spark.createDataFrame([("m", "a", "a" * 40), ("m", "b", "b" * 4)], "g string, field string, value string")
    got = {r["field"]: r["value"] for r in bo.truncate_fields(full, ["g"], target=10).collect()}
    assert got == {"a": "a" * 40, "b": "... [truncated]", "_truncated": "true"}


def test_window_filters_reach_the_scan(spark, tmp_path):
    c = cells_of(spark, [("wb", s, 0, r, k, f"{r}", None) for s in ("A", "B") for r in range(1, 200) for k in range(1, 6)])
    c.write.parquet(str(tmp_path / "c"))
    t = spark.read.parquet(str(tmp_path / "c"))
    for df in (wn.read_window(t, 10, 59, 1, 3, sheet="A"), sr.search_rect(t, 1, 10, 3, 50)):
        pushed = re.search(r"PushedFilters: \[(.*?)\]", plan(df)) or re.search(r"PushedFilters: (.*)", plan(df))
        assert "GreaterThanOrEqual(row" in plan(df) and "GreaterThanOrEqual(col" in plan(df), pushed and pushed[0]
    assert wn.read_window(t, 10, 59, 1, 3, sheet="A").count() == 50 * 3
    assert sr.search_rect(t, 1, 10, 3, 50).count() == 2 * 50 * 3
    events = evs.window_events(t, "A", 10, 59, 1, 3)
    assert "GreaterThanOrEqual(row" in plan(events)


def test_very_wide_ranges_and_rectangles(spark):
    rng = random.Random(2)
    values = [(rng.choice([rng.random() * 10, 1e12 * rng.random(), 5.0]),) for _ in range(400)]
    ranges = [(k, *sorted((1e12 * rng.random() ** 8, 1e12 * rng.random() ** 8))) for k in range(40)] + [(90, 0.0, 1e12), (91, 5.0, 5.0), (92, 7.0, 3.0),
                                                                                                      (93, None, 4.0)]
    r = spark.createDataFrame(ranges, "id int, lo double, hi double")
    v = spark.createDataFrame(values, "x double")
    for li in (True, False):
        for hi in (True, False):
            want = {k: sum((a <= x if li else a < x) and (x <= b if hi else x < b) for (x,) in values) for k, a, b in ranges if a is not None}
            want = {k: n for k, n in want.items() if n}
            assert {x["id"]: x["n"] for x in sr.range_count(r, v, ["id"], "lo", "hi", "x", li, hi).collect()} == want
            pairs = sr.range_join(r, v, "lo", "hi", "x", 1.0, li, hi).groupBy("id").count()
            assert {x["id"]: x["count"] for x in pairs.collect()} == want
    c = cells_of(spark, [("wb", s, 0, r, k, "v", None) for s in "AB" for r in (1, 15, 90, 5_000, 10 ** 9) for k in (1, 3, 16_000)])
    rects = spark.createDataFrame([(1, 0, 0, 10 ** 5, 2 * 10 ** 9), (2, 2, 10, 1, 5), (3, 0, 0, 3, 100), (4, 0, 5, 0, 5)], "q int, x long, y long, w long, h long")
    got = {x["q"]: x["count"] for x in sr.rect_join(rects, c).groupBy("q").count().collect()}
    assert got == {1: 30, 2: 2, 3: 2 * 3 * 2}
    assert {x["q"]: x["count"] for x in sr.rect_join(rects, c, same_sheet=False, salts=1).groupBy("q").count().collect()} == got


def test_range_count_grows_with_its_input_not_with_pairs(spark):
    v = spark.range(20_000).select(F.col("id").cast("double").alias("x"))
    r = spark.range(2_000).select("id", F.lit(0.0).alias("lo"), (F.col("id") * 10.0).alias("hi"))
    df = sr.range_count(r, v, ["id"], "lo", "hi", "x")
    assert "CartesianProduct" not in plan(df) and "BroadcastNestedLoop" not in plan(df)
    assert df.agg(F.sum("n")).first()[0] == sum(10 * k for k in range(2_000))


def test_deltas_with_null_values_and_flags(spark):
    base = spark.createDataFrame([(1, "a", None), (2, "b", "c"), (None, "n", "n")], "k int, x string, y string")
    d = spark.createDataFrame([(1, 1, None, "new", None), (2, 2, None, None, None), (None, 3, "m", None, None), (3, 4, "q", "q", True)],
                              "k int, seq int, x string, y string, gone boolean")
    out = cm.apply_deltas(base, d, ["k"], ["seq"], ["x", "y"], "gone")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, None, "new"), (None, "m", None)], key=str)


def delta(seq, sheet, kind, location, new, affected=None):
    return dict(seq=seq, event_ts=f"2024-01-01T00:00:{seq:02d}Z", workbook="wb", sheet=sheet, type=kind, location=location, old_value=None,
                new_value=new, affected_cells=affected)


def test_store_with_odd_sheet_names_formulas_and_indexes(spark, tmp_path):
    cells = cells_of(spark, [("wb", s, i, 1, 1, "1", None) for i, s in enumerate(["01", "02", "2023", "plain"])] + [
        ("wb", "01", 0, 2, 1, "10", "A1*10")])
    root, src = str(tmp_path / "store"), tmp_path / "d.json"
    dl.init_store(cells, root)
    lines = [delta(1, "01", "cell_update", "01!A1", "99"), delta(2, None, "cell_update", "2023!A1", "word here"),
             delta(3, "01", "cell_update", "plain!B7", "elsewhere"), delta(4, "01", "formula_change", "01!A1", "B1+1"),
             delta(5, "01", "formula_change", "01!A2", "A1*20"), delta(6, "02", "cell_update", "nowhere", "x"),
             delta(7, "01", "bulk_change", "", None, 600), delta(8, "01", "bulk_change", "", None, 600), delta(9, "02", "bulk_change", "", None, 1001)]
    src.write_text("\n".join(map(json.dumps, lines)))
    for _ in range(2):  # a replayed batch leaves the same store
        dl.apply_batch(dl.read_deltas(spark, str(src)), 0, root)
        now = dl.current_cells(spark, root)
        got = {(r["sheet"], r["ref"]): (r["value"], r["formula"], r["num"], r["sheet_idx"]) for r in now.collect()}
        assert got == {("01", "A1"): ("99", "B1+1", 99.0, 0), ("01", "A2"): ("10", "A1*20", 10.0, 0), ("02", "A1"): ("1", None, 1.0, 1),
                       ("2023", "A1"): ("word here", None, None, 2), ("plain", "A1"): ("1", None, 1.0, 3), ("plain", "B7"): ("elsewhere", None, None, 3)}
        rows = lambda df: sorted(map(str, df.collect()))
        assert rows(dl.current_postings(spark, root)) == rows(ix.build_postings(now))
        assert rows(dl.current_numeric(spark, root)) == rows(ix.build_numeric_index(now))
        assert [r["location"] for r in spark.read.parquet(f"{root}/bad_deltas").collect()] == ["nowhere"]
        impact = {r["sheet"]: (r["affected"], r["action"]) for r in spark.read.parquet(f"{root}/rebuild_requests").collect()}
        assert impact == {"01": (1200, "incremental"), "02": (1001, "rebuild")}
    small = str(tmp_path / "compact")
    dl.compact_store(spark, root, small)
    assert rows(dl.current_cells(spark, small)) == rows(now)
    src.write_text(json.dumps(delta(10, "02", "cell_update", "02!A1", "")))
    dl.apply_batch(dl.read_deltas(spark, str(src)), 1, small)
    assert {r["sheet"] for r in dl.current_cells(spark, small).collect()} == {"01", "2023", "plain"}


def test_hot_key_stream_in_any_order_and_over_expiry(spark, tmp_path):
    rng = random.Random(4)
    t, rows = 0, []
    for i in range(300):
        t += rng.choice([1, 100, 290, 500, 700, 5_000])
        rows.append((rng.choice(["a", "b"]), t, i))
    src = tmp_path / "src"
    src.mkdir()
    schema = "k string, s long, i long"
    for n, part in enumerate((rows[:150], rows[150:])):  # each file newest first
        (src / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("k", "s", "i"), r, strict=True))) for r in reversed(part)))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        with_ts = lambda df: df.withColumn("ts", F.timestamp_seconds("s"))
        stream = with_ts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src)))
        q = (hotkeys.hot_key_stream(stream, ["k"], "ts", "i", watermark="30 days").writeStream.format("memory").queryName("hot_any")
             .outputMode("update").start())
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    last = spark.table("hot_any").groupBy("k").agg(F.max(F.struct("accesses", "hits", "promotions")).alias("m"))
    got = {r["k"]: tuple(r["m"]) for r in last.collect()}
    acc = hotkeys.hot_key_accesses(with_ts(spark.createDataFrame(rows, schema)), ["k"], "ts", "i")
    assert got == {r["k"]: (r["accesses"], r["hits"], r["promotions"]) for r in hotkeys.hot_key_stats(acc, ["k"]).collect()}


def test_links_of_odd_sheet_names_books_texts_and_columns(spark):
    f = "Données!A1+[1]Ext!B2+'O''Brien'!C3+\"Gone!D4\"+SUM(E:E)+'[b.xlsx]S x'!$F$6+LOG10(G7)+H8:I9"
    df = spark.createDataFrame([("wb", "own", f)], "workbook string, sheet string, formula string")
    got = [(r["target_book"], r["target_sheet"], r["target_row"], r["target_col"], r["target_end_row"], r["target_end_col"])
           for r in lk.formula_links(df).collect()]
    assert got == [(None, "Données", 1, 1, None, None), ("1", "Ext", 2, 2, None, None), (None, "O'Brien", 3, 3, None, None),
                   (None, "own", None, 5, None, 5), ("b.xlsx", "S x", 6, 6, None, None), (None, "own", 7, 7, None, None), (None, "own", 8, 8, 9, 9)]
    c = cells_of(spark, [("wb", "own", 0, 1, 1, "v", None), ("wb", "O'Brien", 1, 3, 3, "v", None)])
    gone = {(r["target_sheet"], r["target_row"]) for r in lk.dangling_links(lk.formula_links(df), c).collect()}
    assert gone == {("Données", 1), ("own", 7)}


def test_words_are_split_at_unicode_spaces(spark):
    text = "prix total HT　net fin the"
    df = spark.createDataFrame([(text,)], "t string").select(tokenize("t").alias("w"))
    assert df.first()["w"] == ["prix", "total", "net", "fin"] == sr.query_tokens(spark, text)


def test_events_of_empty_sheets_and_read_back(spark, tmp_path):
    c = cells_of(spark, [("wb", "full", 0, 1, 1, "v", None)])
    sheets = spark.createDataFrame([("wb", "full", 0), ("wb", "empty", 1)], "workbook string, sheet string, sheet_idx int")
    out = evs.row_batch_events(c, sheets=sheets)
    evs.write_events(out, str(tmp_path / "e"), files=2)
    back = evs.read_events(spark, str(tmp_path / "e"))
    assert back.schema.simpleString() == "struct<type:string,data:string,sheet_index:int,sheet_name:string,chunk_id:string>"
    starts = {json.loads(r["data"])["sheet_name"]: json.loads(r["data"])["total_rows"] for r in back.filter("type = 'sheet_start'").collect()}
    assert starts == {"full": 1, "empty": 0}
    assert {r["sheet_name"] for r in back.filter("type = 'sheet_complete'").collect()} == {"full", "empty"}


def test_budgeted_export_gives_every_item_back(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    xp.write_budgeted(docs, "text", 1000, str(tmp_path / "x"), ["doc_id"])
    back = xp.read_budgeted(spark, str(tmp_path / "x"), "doc_id BIGINT")
    want = {r["doc_id"]: (r["method"], r["payload"]) for r in xp.plan_export(docs, "text", 1000).collect()}
    assert {r["doc_id"]: (r["method"], r["payload"]) for r in back.collect()} == want and back.count() == docs.count()
