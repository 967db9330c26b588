"""Structured Streaming forms: delta store (T1, T2), hot keys (T3, T4), sessions."""

import json
import shutil
from pathlib import Path

from pyspark.sql import functions as F

from gridlake.plans.grid import load
from gridlake.sources.tables import table_to_cells
from gridlake.streaming import deltas as dl
from gridlake.streaming import hotkeys, metrics


def _base_cells(spark, sf_dir):
    return table_to_cells(load(spark, sf_dir, "nation"), "nation", "n_nationkey",
                          [F.col("n_name"), F.col("n_regionkey")], 1, "wb")


def _delta_lines():
    ts = "2024-01-01T00:00:{:02d}Z"
    rows = [
        (2, ts.format(2), "nation", "cell_update", "nation!A1", "NATION_0", "second"),
        (1, ts.format(1), "nation", "cell_update", "nation!A1", "NATION_0", "first"),   # out of order: loses
        (3, ts.format(3), "nation", "cell_update", "nation!B2", "1", ""),                # delete
        (4, ts.format(4), "nation", "cell_update", "not a location", None, "x"),         # malformed: ignored
        (5, ts.format(5), "nation", "cell_update", "nation!C30", None, "new cell"),
        (6, ts.format(6), "nation", "sheet_add", "", None, None),
    ]
    out = [dict(seq=s, event_ts=t, workbook="wb", sheet=sh, type=ty, location=loc, old_value=o, new_value=n,
                affected_cells=None) for s, t, sh, ty, loc, o, n in rows]
    out.append(dict(seq=7, event_ts=ts.format(7), workbook="wb", sheet="nation", type="bulk_change", location="",
                    old_value=None, new_value=None, affected_cells=1001))
    return out


def _check_state(cells):
    got = {(r["row"], r["col"]): r["value"] for r in cells.collect()}
    assert got[(1, 1)] == "second"
    assert (2, 2) not in got
    assert got[(30, 3)] == "new cell"
    assert got[(3, 1)] == "NATION_2"


def test_delta_stream_is_idempotent(spark, sf_dir, tmp_path):
    root, src = str(tmp_path / "store"), tmp_path / "deltas"
    src.mkdir()
    (src / "d1.json").write_text("\n".join(json.dumps(x) for x in _delta_lines()))
    dl.init_store(_base_cells(spark, sf_dir), root)
    q = dl.start_updates(dl.stream_deltas(spark, str(src)), root, str(tmp_path / "ckpt"), {"availableNow": True})
    q.awaitTermination(120)
    cur = dl.current_cells(spark, root)
    _check_state(cur)
    before = sorted(map(tuple, cur.collect()))
    # replay micro-batch 0 (as after a crash before the checkpoint commit): same store
    dl.apply_batch(dl.read_deltas(spark, str(src)), 0, root)
    assert sorted(map(tuple, dl.current_cells(spark, root).collect())) == before
    rebuild = spark.read.parquet(f"{root}/rebuild_requests").collect()
    assert [(r["affected"], r["action"]) for r in rebuild] == [(1001, "rebuild")]
    assert spark.read.parquet(f"{root}/pending_sheets").count() == 1
    # the untouched base version is still what an older reader sees
    assert dl.current_cells(spark, root, as_of=0).filter((F.col("row") == 1) & (F.col("col") == 1)).first()["value"] == "NATION_0"


def _events_dir(sf_dir, tmp_path):
    d = tmp_path / "events_src"
    d.mkdir()
    shutil.copy(Path(sf_dir) / "events.parquet", d / "events.parquet")
    return str(d)


def test_hot_key_stream_matches_batch(spark, sf_dir, tmp_path):
    ev = load(spark, sf_dir, "events")
    stream = spark.readStream.schema(ev.schema).parquet(_events_dir(sf_dir, tmp_path))
    out = hotkeys.hot_key_stream(stream, ["event_type"], "ts", "event_id", 600, 1200, 3, watermark="1 day")
    q = out.writeStream.format("memory").queryName("hot_stream").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    got = {r["event_type"]: (r["accesses"], r["hits"], r["promotions"]) for r in spark.table("hot_stream").collect()}
    acc = hotkeys.hot_key_accesses(ev, ["event_type"], "ts", "event_id", 600, 1200, 3)
    want = {r["event_type"]: (r["accesses"], r["hits"], r["promotions"]) for r in hotkeys.hot_key_stats(acc, ["event_type"]).collect()}
    assert got == want


def test_hot_key_stream_drops_late_rows_and_keeps_totals(spark, tmp_path):
    src = tmp_path / "late_src"
    src.mkdir()
    stream = spark.readStream.schema("k string, ts timestamp, id long").json(str(src))
    out = hotkeys.hot_key_stream(stream, ["k"], "ts", "id", 300, 600, 3, watermark="10 minutes")
    q = out.writeStream.format("memory").queryName("late_stream").outputMode("update").start()
    at = "2024-01-01T{}Z".format
    batches = [[("a", at("10:00:00"), 1), ("b", at("10:00:00"), 2)], [("a", at("12:00:00"), 3)],
               # a's first row is behind the watermark of 11:50, its second is not; all rows of c are behind it
               [("a", at("11:00:00"), 4), ("a", at("11:55:00"), 5), ("c", at("11:49:59"), 6), ("b", at("12:00:00"), 7)]]
    try:
        for n, rows in enumerate(batches):
            (tmp_path / f"b{n}").write_text("\n".join(json.dumps(dict(zip(("k", "ts", "id"), r, strict=True))) for r in rows))
            shutil.move(tmp_path / f"b{n}", src / f"b{n}.json")
            q.processAllAvailable()
    finally:
        q.stop()
    last = {}
    for r in spark.table("late_stream").collect():
        last[r["k"]] = max(last.get(r["k"], (0, 0, 0)), (r["accesses"], r["hits"], r["misses"]))
    assert last == {"a": (3, 1, 2), "b": (2, 0, 2)}


def test_session_stream_matches_batch(spark, sf_dir, tmp_path):
    ev = load(spark, sf_dir, "events")
    stream = spark.readStream.schema(ev.schema).parquet(_events_dir(sf_dir, tmp_path))
    out = metrics.stream_sessions(stream, ["user_id"], "ts", "5 hours", "0 seconds")
    q = out.writeStream.format("memory").queryName("sess_stream").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["user_id"], r["first_ts"].replace(tzinfo=None), r["n"]) for r in spark.table("sess_stream").collect())
    sessions = metrics.gap_sessions(ev.select("user_id", "ts", "event_id"), ["user_id"], "ts", "event_id", 5 * 3600)
    per = sessions.groupBy("user_id", "session_start").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    max_ts = ev.agg(F.max("ts")).first()[0]
    rows = per.collect()
    closed = sorted((r["user_id"], r["session_start"], r["n"]) for r in rows
                    if r["last"].timestamp() + 5 * 3600 <= max_ts.timestamp())
    every = {(r["user_id"], r["session_start"], r["n"]) for r in rows}
    assert got and set(got) <= every       # append mode emits only closed sessions, all of them correct
    assert set(closed) <= set(got)         # every session closed by the watermark was emitted
