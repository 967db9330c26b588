"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each builds its input from the driver tables (whole tables, whole texts) and applies library
operators; ``gridlake.plans.oracles`` holds the DuckDB SQL of the same result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.functions import budget as bg
from gridlake.functions.a1 import col_letters, parse_location
from gridlake.functions.cursor import checksum_matches, decode_cursor, encode_cursor
from gridlake.functions.values import is_text, parse_money
from gridlake.functions.values import sanitise as sanitise_text
from gridlake.operators import budget as bo
from gridlake.operators import compare as cm
from gridlake.operators import dependencies as dp
from gridlake.operators import index as ix
from gridlake.operators import links as lk
from gridlake.operators import paging as pg
from gridlake.operators import profile as pf
from gridlake.operators import search as sr
from gridlake.operators import spatial as sp
from gridlake.operators import window as wn
from gridlake.plans.grid import formula_cells, grid_cells, load
from gridlake.schema import DELTA_SCHEMA
from gridlake.sinks import events as evs
from gridlake.sinks import export as xp
from gridlake.sinks import workbooks as wbs
from gridlake.session import checkpoint_dir, write_table
from gridlake.sources import datasource as ds
from gridlake.sources import workbook as wbk
from gridlake.sources.tables import decimal_text, number_rows, with_cell_fields
from gridlake.streaming import deltas as dl
from gridlake.streaming import hotkeys as hk
from gridlake.streaming import metrics as mt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def cells_scan(spark, d):
    return grid_cells(spark, d).select("sheet", "row", "col", "ref", "value")


@query
def a1_encode(spark, d):
    return load(spark, d, "part").select((F.col("p_partkey") + 1).alias("n"),
                                         col_letters(F.col("p_partkey") + 1).alias("name"))


@query
def postings(spark, d):
    p = ix.build_postings(load(spark, d, "documents"), "text", ["doc_id"])
    return ix.token_stats(p, ["doc_id"]).withColumnRenamed("token", "tok")


@query
def text_search(spark, d):
    cells = grid_cells(spark, d)
    hits = sr.search_text(ix.build_postings(cells), "cold widget")
    return sr.top_hits(hits.join(cells, ["workbook", "sheet", "row", "col"]), 20,
                       ["sheet", "row", "col"]).select("sheet", "row", "col", "value")


@query
def batch_text_search(spark, d):
    docs = ix.build_postings(load(spark, d, "documents"), "text", ["doc_id"])
    items = load(spark, d, "benchmark")
    return sr.batch_text_search(items, docs, "item_id", "text", ["doc_id"])


# ---------------------------------------------------------------- windows and profiles


@query
def window_scan(spark, d):
    return wn.read_window(grid_cells(spark, d), 10, 59, 1, 3, sheet="part").select("row", "col", "value")


@query
def chunk_scan(spark, d):
    cells = wn.row_batches(wn.sheet_range(grid_cells(spark, d), 1, 3), 100)
    return cells.groupBy("sheet", "batch", "start_row").agg(F.count(F.lit(1)).alias("n_cells"))


@query
def sheet_profile(spark, d):
    p = pf.sheet_profile(grid_cells(spark, d))
    return p.select("sheet", "n_rows", "n_cols", "nonempty", F.round("density", 6).alias("density"), "footprint")


@query
def sheet_chunks(spark, d):
    return pf.sheet_chunks(grid_cells(spark, d), chunk_size=2).select("chunk_id", "size_bytes", "streaming")


@query
def sheet_zones(spark, d):
    return pf.sheet_zones(pf.sheet_profile(grid_cells(spark, d))).select("sheet", "zone_id", "rng", "compressed")


@query
def nav_pages(spark, d):
    p = pg.sheet_pages(pf.sheets(grid_cells(spark, d)), window_size=2)
    return p.select("sheet", F.col("page").cast("int").alias("page"), "next_sheet", "prev_sheet")


@query
def key_points(spark, d):
    return pf.key_points(grid_cells(spark, d)).select("sheet", "ref", "role")


@query
def hot_zones(spark, d):
    z = pf.hot_zones(grid_cells(spark, d))
    return z.select("sheet", "first_row", "first_col", F.round("density", 6).alias("density"))


@query
def value_types(spark, d):
    return pf.value_types(grid_cells(spark, d)).select("sheet", "n_number", "n_text", "n_empty")


@query
def column_stats(spark, d):
    s = pf.column_stats(grid_cells(spark, d))
    return s.select("sheet", "col", "n", "lo", "hi", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


@query
def outliers(spark, d):
    li = load(spark, d, "lineitem")
    return pf.outliers(li, ["l_returnflag"], "l_extendedprice", 1.7).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


# ---------------------------------------------------------------- search

@query
def exact_gate(spark, d):
    probes = load(spark, d, "region").select(F.concat(F.lit("NATION_"), F.col("r_regionkey")).alias("value"))
    return sr.exact_gate(grid_cells(spark, d), probes).select("sheet", "row", "col")


@query
def numeric_range(spark, d):
    return sr.search_numeric(grid_cells(spark, d), 10, 20).select("sheet", "row", "col", "num")


@query
def numeric_last_wins(spark, d):
    n = ix.build_numeric_index(grid_cells(spark, d), dedupe="last")
    return n.select("sheet", "num", "row", F.col("col").cast("bigint").alias("col"))


@query
def range_batch(spark, d):
    part = load(spark, d, "part").select(
        "p_partkey", (F.col("p_retailprice") * F.col("p_size")).alias("lo"),
        (F.col("p_retailprice") * (F.col("p_size") + 1)).alias("hi"))
    return sr.range_count(part, load(spark, d, "lineitem"), ["p_partkey"], "lo", "hi", "l_extendedprice")


@query
def rect_search(spark, d):
    return sr.search_rect(grid_cells(spark, d), 1, 5, 2, 10).select("sheet", "row", "col", "value")


@query
def rect_batch(spark, d):
    k = F.col("r_regionkey")
    rects = load(spark, d, "region").select(k.alias("q"), F.lit(0).alias("x"), (k * 7).alias("y"),
                                             (k + 1).alias("w"), F.lit(30).alias("h"))
    pairs = sr.rect_join(rects, grid_cells(spark, d))
    return pairs.groupBy("q", "sheet").agg(F.count(F.lit(1)).alias("n"))


@query
def sheet_match(spark, d):
    return sr.scan_sheets(grid_cells(spark, d), "Io", max_sheets=10, max_rows=50).select(
        "sheet", "sheet_idx", "truncated", "n")


@query
def wildcard(spark, d):
    return sr.search_wildcard(grid_cells(spark, d), "c*d w?dget").select("sheet", "row", "col", "value")


@query
def hit_context(spark, d):
    cells = grid_cells(spark, d)
    hits = cells.filter((F.col("sheet") == "part") & (F.col("value") == "Brand#17")).select(
        "workbook", "sheet", "row", "col")
    return sr.hit_context(hits, cells, 1).select("sheet", "row", "col", "heading", "nearby")


@query
def hybrid_union(spark, d):
    cells = grid_cells(spark, d)
    u = sr.union_hits(sr.search_numeric(cells, 10, 20), cells.filter(F.col("sheet") == "nation"))
    return u.select("sheet", "row", "col")


# ---------------------------------------------------------------- values and names

@query
def money_parse(spark, d):
    o = load(spark, d, "orders")
    s = F.regexp_replace(o["o_totalprice"].cast("decimal(18,2)").cast("string"), "[.]", ",")
    text = F.concat(F.substring(s, 1, 1), F.lit(" "), F.substring(s, 2, 1 << 20))
    text = F.when(o["o_orderkey"] % 9 == 0, F.concat(F.lit("abc"), text)).otherwise(text)
    return o.select("o_orderkey", parse_money(text).alias("num"))


def _pattern_names(spark, d):
    c = F.col
    nm = (F.when(c("p_size") == 1, F.concat_ws("_", c("p_size"), c("p_brand")))
          .when(c("p_size") == 2, F.lit("y2024")).when(c("p_size") == 3, c("p_brand")).otherwise(c("p_name")))
    return load(spark, d, "part").select("p_size", nm.alias("nm"))


@query
def name_patterns(spark, d):
    return pf.naming_patterns(_pattern_names(spark, d), ["p_size"], "nm").select(
        "p_size", "underscore", "space", "digit", "has_year")


@query
def name_groups(spark, d):
    p = load(spark, d, "part").withColumn("g", F.floor(F.col("p_partkey") / 10).cast("bigint"))
    return pf.structural_groups(p, ["g"], "p_name")


@query
def formula_class(spark, d):
    li = load(spark, d, "lineitem")
    f = F.when(F.col("l_returnflag") == "R", "A1+1").when(F.col("l_returnflag") == "A", "IF(A1,1,2)")
    cells = li.select("l_orderkey", f.alias("formula"))
    return pf.formula_complexity(cells, ["l_orderkey"], sample_sheets=None, sample=None).select("l_orderkey", "cls")


# ---------------------------------------------------------------- changes and links


@query
def checksum_change(spark, d):
    docs = load(spark, d, "documents")
    k = F.col("doc_id")
    current = docs.select("doc_id", F.sha2("text", 256).alias("checksum"))
    known = docs.filter(k % 10 != 0).select(
        "doc_id", F.when(k % 10 == 1, F.lit("stale")).otherwise(F.sha2("text", 256)).alias("checksum"))
    return cm.changed_checksums(current, known, ["doc_id"]).select("doc_id", "checksum", "changed")


@query
def validated_lookup(spark, d):
    docs = load(spark, d, "documents")
    requests = docs.select("doc_id", F.lit(100).alias("now"),
                           F.when(F.col("lang") == "en", F.lit("")).otherwise(F.sha2("text", 256)).alias("expected_checksum"))
    entries = docs.join(load(spark, d, "labels"), "doc_id").select(
        "doc_id", F.when(F.col("quality") == 1, F.sha2("text", 256)).otherwise(F.lit("stale")).alias("checksum"),
        F.col("n_chars").alias("expires_at"))
    return cm.validated_lookup(requests, entries, ["doc_id"]).select("doc_id")


@query
def sheet_compare(spark, d):
    ev = load(spark, d, "events")
    side = lambda t: ev.filter(F.col("event_type") == t).groupBy("user_id").agg(F.sum("value").alias("v"))
    c = cm.compare_sheets(side("click"), side("view"), "user_id", "v")
    return c.select("user_id", *[F.round(x, 2).alias(x) for x in ("v_a", "v_b", "diff")])


def _order_cells(df):
    cols = [F.col("o_custkey"), F.col("o_orderstatus"), decimal_text("o_totalprice"),
            F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderpriority")]
    pairs = F.array(*[F.struct(F.lit(i + 1).alias("col"), c.cast("string").alias("value")) for i, c in enumerate(cols)])
    cells = df.select(F.lit("tables").alias("workbook"), F.lit("orders").alias("sheet"), F.lit(0).alias("sheet_idx"),
                      (F.col("o_orderkey") + 1).alias("row"), F.inline(pairs))
    return with_cell_fields(cells.filter(F.col("value").isNotNull()))


@query
def snapshot_diff(spark, d):
    o = load(spark, d, "orders")
    k = F.col("o_orderkey")
    old = o.filter((k % 17 != 0) | (k % 11 == 0) | (k % 13 == 0))
    new = o.filter(k % 11 != 0).withColumn(
        "o_orderstatus", F.when(k % 13 == 0, F.concat("o_orderstatus", F.lit("*"))).otherwise(F.col("o_orderstatus")))
    diff = cm.diff_snapshots(_order_cells(old), _order_cells(new))
    return diff.select((F.col("row") - 1).alias("o_orderkey"), "change").distinct()


@query
def delta_apply(spark, d):
    ev = load(spark, d, "events")
    key = ["user_id", "event_type"]
    base = ev.groupBy(*key).agg(F.min_by("value", F.struct("ts", "event_id")).alias("value"))
    out = cm.apply_deltas(base, ev, key, ["ts", "event_id"], ["value"])
    return out.select("user_id", F.col("event_type").alias("cell"), "value")


@query
def bulk_impact(spark, d):
    return cm.bulk_impact(load(spark, d, "events"), ["user_id"], None, threshold=70)


@query
def formula_links(spark, d):
    li = load(spark, d, "lineitem")
    f = (F.when(F.col("l_quantity") < 10, F.concat(F.lit("part!B"), F.col("l_partkey") + 1, F.lit("*2")))
         .otherwise(F.concat(F.lit("A"), F.col("l_linenumber"), F.lit("*2"))))
    df = li.select("l_orderkey", "l_linenumber", "l_partkey", F.lit("lineitem").alias("sheet"), f.alias("formula"))
    return lk.formula_links(df).select("l_orderkey", "l_linenumber", "l_partkey", "target_sheet", "target_row", "target_col")


@query
def cyclic_core(spark, d):
    p = load(spark, d, "part")
    edges = p.select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * 2 + 1) % p.count()).alias("dst"))
    return lk.cyclic_core(edges)


@query
def sheet_similarity(spark, d):
    p = load(spark, d, "part").select("p_brand", F.concat_ws("/", "p_type", F.col("p_size") % 8).alias("t"))
    s = lk.similar_sets(p, "p_brand", "t", 0.4)
    return s.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


# ---------------------------------------------------------------- budgets, cursors, pages


@query
def token_totals(spark, d):
    return bo.token_totals(load(spark, d, "documents"), ["source"], "text")


@query
def budget_columns(spark, d):
    docs = load(spark, d, "documents")
    m = F.col("doc_id") % 4
    model = (F.when(m == 0, "sonnet-4").when(m == 1, "sonnet-4-beta").when(m == 2, "opus-4-1")
             .otherwise("an-unknown-model"))
    t = bg.with_model_limits(docs.select("doc_id", bg.estimate_tokens("text").alias("tok"), model.alias("model")))
    limit = F.lit(1000)
    track = bg.token_tracking("tok", limit)
    return t.select("doc_id", "tok", track["remaining"].alias("remaining"), bg.over_limit("tok", limit).alias("over"),
                    bg.ladder_a("tok", limit).alias("ladder_a"), bg.ladder_b("tok", limit).alias("ladder_b"),
                    bg.estimate_compressed("tok", "gzip").alias("est_gzip"), bg.chunks_needed("tok", limit).alias("n_chunks"),
                    "safe_buffer", bg.optimal_chunk_tokens("safe_buffer").alias("optimal"))


@query
def truncate_text(spark, d):
    return load(spark, d, "documents").select("doc_id", bg.truncate_text("text", 100).alias("out"))


@query
def running_budget(spark, d):
    conv = load(spark, d, "conversations").withColumn("tok", bg.estimate_tokens("text"))
    r = bo.running_budget(conv, ["conv_id"], ["turn"], "tok", 200)
    return r.groupBy("conv_id").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))


NOW_SECONDS = 1_706_745_600  # 2024-02-01 00:00:00 UTC, the cursor checks' "now"


@query
def cursor_roundtrip(spark, d):
    docs = load(spark, d, "documents")
    k = F.col("doc_id")
    ts = F.lit(NOW_SECONDS) - F.when(k % 7 == 0, 25 * 3600).otherwise(3600)
    version = F.when(k % 10 == 0, 2).otherwise(1)
    enc = docs.select("doc_id", encode_cursor(F.concat(F.lit("chunk_"), k), "n_chars", F.sha2("text", 256), ts,
                                              version=version).alias("cursor"))
    dec = enc.select("doc_id", decode_cursor("cursor", F.lit(NOW_SECONDS)).alias("c"))
    return dec.select("doc_id", "c.chunk_id", F.col("c.offset").alias("offset_"), "c.version", "c.error")


@query
def page_two(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    order = [("o_totalprice", False), ("o_orderkey", True)]
    cursor = pg.last_key(pg.keyset_page(o, order, 100), order)
    return pg.keyset_page(o, order, 100, after=cursor)


@query
def query_tags(spark, d):
    b = load(spark, d, "benchmark")
    m = F.col("item_id") % 4
    q = F.concat(F.lower("text"), F.when(m == 0, " SUM(x)").when(m == 1, " COUNT(x)").when(m == 2, " sum(x)").otherwise(""))
    tags = bo.query_tags(q, F.length("text"), high_volume=200)
    return b.select("item_id", F.array_contains(tags, "high_volume_query").alias("high_volume"),
                    F.array_contains(tags, "aggregation_query").alias("aggregation"))


@query
def response_profile(spark, d):
    docs = load(spark, d, "documents")
    m = F.col("doc_id") % 3
    model = F.when(m == 0, "sonnet-4-beta").when(m == 1, "sonnet-4").otherwise("opus-4-1")
    prof = F.broadcast(bg.response_profiles(spark))  # fixed three rows
    t = docs.select("doc_id", "text", bg.model_family(model).alias("family")).join(prof, "family")
    cc = bg.cache_control(F.sha2("text", 256), F.col("doc_id") % 2 == 0)
    return t.select("doc_id", "max_results", "window_rows", cc["ttl"].alias("ttl"), cc["cache_key"].alias("cache_key"))


@query
def sanitise(spark, d):
    docs = load(spark, d, "documents")
    t = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("="), F.col("lang"))).otherwise(F.col("lang"))
    return docs.select("doc_id", sanitise_text(t).alias("out"))


# ---------------------------------------------------------------- time: hot keys, ticks, sessions


@query
def hot_keys(spark, d):
    ev = load(spark, d, "events").select(F.col("event_type").alias("k"), "ts", "event_id")
    acc = hk.hot_key_accesses(ev, ["k"], "ts", "event_id", ttl_seconds=600, hot_ttl_seconds=1200, promote_after=3)
    s = hk.hot_key_stats(acc, ["k"])
    return s.select("k", "accesses", "hits", "promotions", F.round("hit_ratio", 6).alias("hit_ratio"))


@query
def tick_metrics(spark, d):
    return mt.tick_counts(load(spark, d, "events"), "ts", "1 minute")


@query
def key_sessions(spark, d):
    ev = load(spark, d, "events").select("user_id", "ts", "event_id")
    return mt.session_summary(mt.gap_sessions(ev, ["user_id"], "ts", "event_id", 5 * 3600), ["user_id"])


# ---------------------------------------------------------------- index upkeep, navigation, exports


@query
def index_stats(spark, d):
    cells = grid_cells(spark, d)
    s = ix.index_stats(cells, ix.build_postings(cells), ix.build_numeric_index(cells))
    return s.select("numeric_items", "distinct_tokens", "spatial_points")


@query
def spatial_tiles(spark, d):
    t = ix.spatial_tiles(grid_cells(spark, d))
    return t.groupBy("sheet", "tile_row", "tile_col").agg(F.count(F.lit(1)).alias("n"))


@query
def postings_update(spark, d):
    """The nation sheet's names are rewritten (lower case + suffix); the postings are
    updated incrementally; the result must equal postings rebuilt from the new cells."""
    cells = grid_cells(spark, d)
    touched = cells.filter((F.col("sheet") == "nation") & (F.col("col") == 1))
    new_vals = touched.withColumn("value", F.concat(F.lower("value"), F.lit(" updated")))
    new_cells = cells.join(touched.select("workbook", "sheet", "row", "col"), ["workbook", "sheet", "row", "col"],
                           "left_anti").unionByName(new_vals)
    upd = cm.update_postings(ix.build_postings(cells), new_cells, touched)
    return ix.token_stats(upd).select("token", "tf", "df")


@query
def nav_page(spark, d):
    p = pg.nav_page(pf.sheets(grid_cells(spark, d)), offset=1, window_size=2)
    return p.select("sheet", "sheet_idx", "total_pages")


@query
def chunk_cursors(spark, d):
    c = pg.chunk_cursors(pf.sheet_chunks(grid_cells(spark, d), chunk_size=2))
    return c.select("chunk_id", "next_chunk", "prev_chunk", "remaining", "eta_seconds")


def _event_fields(ev):
    j = F.col("line")
    sheet = F.coalesce(F.get_json_object(j, "$.data.sheet_name"), F.get_json_object(j, "$.sheet_name"))
    return ev.select(F.get_json_object(j, "$.type").alias("type"), sheet.alias("sheet"),
                     F.get_json_object(j, "$.data.start_row").cast("bigint").alias("start_row"),
                     F.json_array_length(F.get_json_object(j, "$.data.rows")).cast("bigint").alias("n_rows"),
                     F.get_json_object(j, "$.data.rows[0]").alias("first_row"))


@query
def row_events(spark, d):
    return _event_fields(evs.row_batch_events(grid_cells(spark, d), 100))


@query
def window_events(spark, d):
    return _event_fields(evs.window_events(grid_cells(spark, d), "customer", 0, 149, 0, 1, 50))


@query
def export_plan(spark, d):
    p = xp.plan_export(load(spark, d, "documents"), "text", 1000)
    return p.select("doc_id", "tokens", "method", F.length("payload").cast("bigint").alias("payload_chars"))


@query
def truncate_items(spark, d):
    t = bo.truncate_items(load(spark, d, "conversations"), ["conv_id"], ["turn"], "text", 200)
    return t.select("conv_id", "pos", "is_summary", F.length("text").cast("bigint").alias("chars"), "_truncated_items",
                    "_total_items")


@query
def tick_hit_ratio(spark, d):
    ev = load(spark, d, "events").select(F.col("event_type").alias("k"), "ts", "event_id")
    acc = hk.hot_key_accesses(ev, ["k"], "ts", "event_id", ttl_seconds=600, hot_ttl_seconds=1200, promote_after=3)
    r = mt.tick_hit_ratio(acc, "ts", "1 hour")
    return r.select("tick", "accesses", "hits", F.round("hit_ratio", 6).alias("hit_ratio"))


@query
def text_and_range(spark, d):
    cells = grid_cells(spark, d)
    words = sr.search_text(ix.build_postings(cells), "economy")
    return sr.intersect_hits(words, sr.search_rect(cells, 2, 0, 1, 1 << 40)).select("sheet", "row", "col")


@query
def wide_extract(spark, d):
    w = wn.extract_wide(grid_cells(spark, d).filter(F.col("sheet") == "part"), max_rows=1000, max_cols=21)
    return w.select("row", "c1", "c2", "c3", "c4", "c5", "c6", "c21")


@query
def truncate_fields(spark, d):
    """each document as a map of five fields (three priority fields, one of them at times too long), cut to
    300 tokens."""
    docs = load(spark, d, "documents")
    pairs = F.array(F.struct(F.lit("metadata").alias("field"), F.concat_ws(" ", "lang", "source").alias("value")),
                    F.struct(F.lit("index").alias("field"), F.col("doc_id").cast("string").alias("value")),
                    F.struct(F.lit("summary").alias("field"), F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.col("lang")).alias("value")),
                    F.struct(F.lit("n_chars").alias("field"), F.col("n_chars").cast("string").alias("value")),
                    F.struct(F.lit("text").alias("field"), F.col("text").alias("value")))
    fields = docs.select("doc_id", F.inline(pairs))
    t = bo.truncate_fields(fields, ["doc_id"], "field", "value", target=300)
    return t.select("doc_id", "field", F.length("value").cast("bigint").alias("chars"), "_original_size", "_included_fields")


# ---------------------------------------------------------------- null keys, changes of numbers and formulas, predicates


@query
def null_key_budget(spark, d):
    c = load(spark, d, "conversations")
    rows = c.select(F.when(c["conv_id"] % 5 != 0, c["conv_id"] % 7).alias("g"), (c["conv_id"] * 1000 + c["turn"]).alias("pos"),
                    bg.estimate_tokens("text").alias("tok"))
    r = bo.running_budget(rows, ["g"], ["pos"], "tok", 2000)
    return r.groupBy("g").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"),
                              F.max("cum_tokens").cast("bigint").alias("total"))


@query
def null_key_sessions(spark, d):
    ev = load(spark, d, "events").select(F.when(F.col("user_id") % 4 != 0, F.col("user_id")).alias("u"), "ts", "event_id")
    return mt.session_summary(mt.gap_sessions(ev, ["u"], "ts", "event_id", 300), ["u"])


@query
def null_key_rows(spark, d):
    o = load(spark, d, "orders").select(F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey")).alias("key"), "o_orderkey")
    return number_rows(o, ["key", "o_orderkey"]).select("o_orderkey", "row")


def _changed_orders(spark, d):
    """Orders as cells, and a change or two of some: every third gets a formula, every fifteenth of those a value
    before it, every seventh a last value (at times empty)."""
    o = load(spark, d, "orders")
    k = F.col("o_orderkey")
    cells = with_cell_fields(o.select(
        F.lit("tables").alias("workbook"), F.lit("orders").alias("sheet"), F.lit(0).alias("sheet_idx"), k.alias("row"), F.lit(1).alias("col"),
        F.col("o_custkey").cast("string").alias("value"), F.when(k % 2 == 0, "A1+1").alias("formula")))
    change = lambda n, when, kind, new: F.when(when, F.struct(F.lit(n).cast("bigint").alias("seq"), F.lit(kind).alias("type"), new.alias("new_value")))
    changes = F.array(change(1, (k % 3 == 0) & (k % 5 == 0), "cell_update", F.lit("42")),
                      change(2, k % 3 == 0, "formula_change", F.concat(F.lit("B"), k + 1, F.lit("*2"))),
                      change(3, k % 7 == 0, "cell_update", F.when(k % 14 == 0, "").otherwise(F.concat(F.lit("x"), F.col("o_custkey")))))
    deltas = o.select(k, F.inline(F.filter(changes, lambda c: c.isNotNull()))).select(
        "seq", F.lit(None).cast("timestamp").alias("event_ts"), F.lit("tables").alias("workbook"), F.lit(None).cast("string").alias("sheet"),
        "type", F.concat(F.lit("orders!A"), "o_orderkey").alias("location"), F.lit(None).cast("string").alias("old_value"), "new_value",
        F.lit(None).cast("int").alias("affected_cells")).filter(~F.col("location").endswith("!A0"))
    return cells.filter("row > 0"), deltas


@query
def cell_changes(spark, d):
    cells, deltas = _changed_orders(spark, d)
    return cm.apply_cell_deltas(cells, deltas).select(F.col("row").alias("k"), F.col("value").alias("v"), F.col("formula").alias("f"))


@query
def numeric_update(spark, d):
    cells, deltas = _changed_orders(spark, d)
    new = cm.apply_cell_deltas(cells, deltas)
    n = cm.update_numeric(ix.build_numeric_index(cells), new, cm.cell_deltas(deltas))
    return n.select(F.col("row").alias("k"), "num")


@query
def bulk_rebuilds(spark, d):
    return cm.bulk_impact(load(spark, d, "lineitem"), ["l_suppkey"], "l_partkey", threshold=150)


@query
def numeric_compare(spark, d):
    n = sr.search_numeric(grid_cells(spark, d), ordered=True)
    return n.select("sheet", "row", "col", "num", sr.compare("num", ">=", 20).alias("ge"), sr.compare("num", "<>", 7).alias("ne"),
                    sr.compare("num", "between", 3, 9).alias("between_"))


@query
def text_cells(spark, d):
    return grid_cells(spark, d).filter(is_text("value")).groupBy("sheet").agg(F.count(F.lit(1)).alias("n"))


@query
def locations(spark, d):
    c = sr.with_location_text(grid_cells(spark, d).select("sheet", "ref"))
    return c.select("location", parse_location("location").alias("p")).select("location", "p.sheet", "p.row", "p.col")


@query
def rects_overlap(spark, d):
    p = load(spark, d, "part").select("p_brand", "p_type", "p_partkey", F.col("p_size").alias("x"), (F.col("p_partkey") % 40).alias("y"),
                                      F.lit(5).alias("w"), F.lit(9).alias("h"))
    pairs = sr.rects_join(p, p, ["p_brand", "p_type"], tile_w=5, tile_h=9)
    return pairs.filter("p_partkey < r_p_partkey").select(F.col("p_partkey").alias("a"), F.col("r_p_partkey").alias("b"))


@query
def dangling_links(spark, d):
    """Every third line of an order refers to a sheet that is not there, the others to a part's brand cell (blank for
    every third)."""
    li = load(spark, d, "lineitem")
    parts = load(spark, d, "part").select(
        F.lit("tables").alias("workbook"), F.lit("Brands \u00e9t\u00e9").alias("sheet"), (F.col("p_partkey") + 1).alias("row"), F.lit(2).alias("col"))
    f = (F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("'Brands \u00e9t\u00e9'!$B$"), F.col("l_partkey") + 1, F.lit('&"Gone!A1"')))
         .otherwise(F.concat(F.lit("Gone!A1+[2]Other!B"), "l_partkey")))
    df = li.select("l_orderkey", "l_linenumber", "l_partkey", F.lit("tables").alias("workbook"), F.lit("lineitem").alias("sheet"), f.alias("formula"))
    gone = lk.dangling_links(lk.formula_links(df), parts.filter((F.col("row") - 1) % 3 != 0))
    return gone.select("l_orderkey", "l_linenumber", "l_partkey")


@query
def export_roundtrip(spark, d):
    """K4: the budgeted export written and read back; cut items have no checksum here."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/export-{uuid.uuid4().hex[:12]}"
    xp.write_budgeted(load(spark, d, "documents"), "text", 1000, path, ["doc_id"])
    back = xp.read_budgeted(spark, path, "doc_id BIGINT")
    whole = F.col("method") != "brotli-11-truncated"
    return back.select("doc_id", "codec", F.when(whole, F.sha2("payload", 256)).alias("checksum"))


# ---------------------------------------------------------------- spatial index, dependencies, formats, sketches


@query
def spatial_rect(spark, d):
    """Three rectangles (tall, wide, square) over the stored spatial index of all sheets."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/spatial-{uuid.uuid4().hex[:12]}"
    sp.write_spatial(grid_cells(spark, d), path)
    rects = {"tall": (1, 20, 1, 1 << 40), "wide": (0, 7, 100, 2), "square": (2, 10, 2, 30)}
    found = [sp.search_rect_stored(spark, path, *r).select(F.lit(q).alias("q"), "sheet", "row", "col", "value") for q, r in rects.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query
def range_cycles(spark, d):
    """Cells on cycles that run through ranges, each with the first cell of its cycle."""
    c = dp.formula_cycles(formula_cells(spark, d))
    return c.select("sheet", "row", "col", "cycle_sheet", "cycle_row", "cycle_col")


@query
def cell_readers(spark, d):
    """Per cell, the formulas that read it, alone or within a range."""
    cells = formula_cells(spark, d)
    r = dp.readers(cells, write_table(dp.reference_blocks(lk.formula_links(dp.formula_cells(cells))), "references"))
    return r.groupBy("sheet", "row", "col").agg(F.count(F.lit(1)).alias("n"))


@query
def hit_parts(spark, d):
    """Headings, neighbours, own formulas and reading formulas of the size cells that hold 7."""
    cells = formula_cells(spark, d)
    hits = cells.filter((F.col("col") == 2) & (F.col("value") == "7"))
    return dp.hit_parts(hits, cells).drop("workbook")


@query
def downstream_impact(spark, d):
    """What a change of the size cells that hold 7 reaches, with depth."""
    cells = formula_cells(spark, d)
    found = dp.downstream(cells, cells.filter((F.col("col") == 2) & (F.col("value") == "7")))
    return found.select("sheet", "row", "col", "depth")


@query
def rebuild_plan(spark, d):
    """Per sheet, what that change reaches and whether the sheet is to be rebuilt."""
    cells = formula_cells(spark, d)
    found = dp.downstream(cells, cells.filter((F.col("col") == 2) & (F.col("value") == "7")), max_depth=2)
    return dp.rebuild_plan(found, 250).drop("workbook")


@query
def column_masks(spark, d):
    m = pf.column_masks(grid_cells(spark, d), k=4)
    return m.select("sheet", "col", "level", "mask", "n", F.round("share", 6).alias("share"))


@query
def merged_stats(spark, d):
    """Statistics of three parts of each sheet, merged from their sketches."""
    cells = grid_cells(spark, d)
    parts = [pf.column_sketches(cells.filter(F.col("row") % 3 == k)) for k in range(3)]
    s = pf.sketch_stats(pf.merge_sketches(*parts))
    return s.select("sheet", "col", "n", "lo", "hi", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


@query
def exact_range_counts(spark, d):
    """Ranges of ids above 2**53, where neighbours share a double."""
    far = lambda c, by=0: (F.col(c) + F.lit((1 << 53) + by)).alias(f"x{by}")
    ranges = load(spark, d, "part").select("p_partkey", far("p_partkey"), far("p_partkey", 2))
    orders = load(spark, d, "orders").select(far("o_custkey"))
    return sr.range_count(ranges, orders, ["p_partkey"], "x0", "x2", "x0")


# ---------------------------------------------------------------- sources, stores and streams end to end


def _fresh(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _books(spark, d):
    """The sheets of formulas written as workbooks, one of two sheets (the last may have one)."""
    cells = formula_cells(spark, d).withColumn("workbook", F.concat(F.lit("Book "), F.floor(F.col("sheet_idx") / 2)))
    folder = _fresh(spark, "books")
    wbs.write_workbooks(cells, folder).count()
    return folder


@query
def workbook_source(spark, d):
    """Workbooks written from a table and read back through the data source, with pushed filters."""
    raw = spark.read.format(ds.register(spark)).option("splitBytes", 20_000).load(_books(spark, d))
    wanted = raw.filter((F.col("row") > 100) & F.col("sheet").isin("calc0", "calc1", "calc3"))
    return wbk.cells_of(wanted).select("sheet", "row", "col", "value", "num", "formula")


@query
def workbook_facts(spark, d):
    """Sheets, complexity and memory estimate per workbook; no file is over the limit."""
    files = wbk.workbook_files(spark, _books(spark, d), max_file_size=1 << 30)
    listing = wbk.sheet_listing(files)
    m = wbk.workbook_metadata(files, wbk.read_cells(files, listing), listing)
    return m.select(F.regexp_extract(F.url_decode("workbook"), r"([^/]*)\.xlsx$", 1).alias("workbook"), F.length("checksum").alias("digits"),
                    "sheets_count", F.round("complexity_score", 6).alias("complexity"), "memory_estimate")


@query
def delta_store(spark, d):
    """The changes of the orders as JSON files, streamed into the store of cells; its state afterwards."""
    cells, deltas = _changed_orders(spark, d)
    root, feed = _fresh(spark, "store"), _fresh(spark, "feed")
    dl.init_store(cells, root)
    deltas.select(*[F.col(f.name).cast(f.dataType) for f in DELTA_SCHEMA.fields]).write.json(feed)
    dl.start_updates(dl.stream_deltas(spark, feed), root, f"{root}/checkpoint", {"availableNow": True}).awaitTermination()
    return dl.current_cells(spark, root).select(F.col("row").alias("k"), F.col("value").alias("v"), F.col("formula").alias("f"))


@query
def hot_key_totals(spark, d):
    """The events streamed through the state of hot keys; the last totals of each key."""
    feed, out = _fresh(spark, "events"), _fresh(spark, "totals")
    load(spark, d, "events").select(F.col("event_type").alias("k"), "ts", "event_id").write.parquet(feed)
    stream = spark.readStream.schema(spark.read.parquet(feed).schema).parquet(feed)
    totals = hk.hot_key_stream(stream, ["k"], "ts", "event_id", ttl_seconds=600, hot_ttl_seconds=1200, promote_after=3)
    (totals.writeStream.outputMode("update").foreachBatch(lambda df, b: df.write.mode("overwrite").parquet(f"{out}/batch={b}"))
     .option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination())
    last = spark.read.parquet(out).groupBy("k").agg(F.max(F.struct("batch", "accesses", "hits", "promotions")).alias("t"))
    return last.select("k", "t.accesses", "t.hits", "t.promotions")


@query
def event_readback(spark, d):
    """K6: the row events written as gzip text and read back."""
    path = _fresh(spark, "row-events")
    evs.write_events(evs.row_batch_events(grid_cells(spark, d), 100), path, compression="gzip")
    return evs.read_events(spark, path).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query
def stored_index(spark, d):
    """K5: the stored index of the grid: an AND search of tokens, a number range and a rectangle over its tables."""
    path = _fresh(spark, "index")
    ix.write_index(grid_cells(spark, d), path, files_per_table=4)
    t = ix.read_index(spark, path)
    words = sr.search_text(t["postings"], "cold widget").select(F.lit("text").alias("q"), "sheet", "row", "col")
    numbers = sr.search_numeric(t["numeric_index"], 10, 20).select(F.lit("range").alias("q"), "sheet", "row", "col")
    rect = sp.search_rect_stored(spark, path, 1, 5, 2, 10).select(F.lit("rect").alias("q"), "sheet", "row", "col")
    return words.unionByName(numbers).unionByName(rect)


@query
def has_more(spark, d):
    """The first page of orders by price, probed and by the reference's rule."""
    o = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    order = [("o_totalprice", False), ("o_orderkey", True)]
    probe = pg.with_has_more(o, order, 50).select("o_orderkey", F.col("has_more").alias("probe"))
    return probe.join(pg.with_has_more(o, order, 50, "at_least").select("o_orderkey", F.col("has_more").alias("at_least")), "o_orderkey")


@query
def formula_sample(spark, d):
    """The formula class of each workbook from the corner of its first sheets alone, and from all cells."""
    cells = formula_cells(spark, d).withColumn("workbook", F.concat(F.lit("b"), F.col("sheet_idx") % 2))
    part = pf.formula_complexity(cells, sample_sheets=2, sample=600).select("workbook", F.col("n_formulas").alias("sampled"), F.col("cls").alias("sampled_class"))
    return part.join(pf.formula_complexity(cells, sample_sheets=None, sample=None).select("workbook", "n_formulas", "cls"), "workbook")


@query
def cursor_checks(spark, d):
    """whether a cursor carries the checksum that its reader expects."""
    docs = load(spark, d, "documents")
    enc = docs.select("doc_id", encode_cursor(F.concat(F.lit("chunk_"), "doc_id"), "n_chars", F.sha2("text", 256), F.lit(NOW_SECONDS)).alias("cursor"),
                      F.sha2(F.when(F.col("doc_id") % 3 == 0, F.lit("other")).otherwise(F.col("text")), 256).alias("expected"))
    return enc.select("doc_id", checksum_matches(decode_cursor("cursor", F.lit(NOW_SECONDS)), F.col("expected")).alias("ok"))


@query
def json_token_counts(spark, d):
    """tokens of a number's JSON text."""
    return load(spark, d, "documents").select("doc_id", bg.json_tokens("n_chars").alias("tokens"))
