"""One-call compositions mirroring the reference's three data calls over many workbooks:
analyse files, build the navigation map, query the cells.  Each returns named DataFrames
built from the operators; the cells are parsed once and written to the shared folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlake.functions.budget import cache_control, estimate_tokens, optimal_chunk_tokens, token_tracking, with_model_limits
from gridlake.functions.cursor import encode_cursor
from gridlake.operators import compare as cm
from gridlake.operators import dependencies as dp
from gridlake.operators import index as ix
from gridlake.operators import paging as pg
from gridlake.operators import profile as pf
from gridlake.operators import search as sr
from gridlake.schema import LOCATION
from gridlake.session import write_table
from gridlake.sources import workbook as wbk


def analyse_files(spark: SparkSession, paths: str | Sequence[str], chunk_size: int = 50, stream_mode: bool = True,
                  model: str = "sonnet-4", max_file_size: int | None = None, now_seconds: int | None = None) -> dict:
    """analyse_file for many workbooks: metadata (S1, A2, A4), chunks with cursors (A3, W5,
    W8, F22), naming patterns and groups (A5, A6), formula classes (A7), per-sheet value types
    (A8), token settings (F12, F13), the parsed ``cells`` and the unreadable files."""
    files = wbk.workbook_files(spark, paths, max_file_size)
    listing = wbk.sheet_listing(files)
    listing = write_table(listing, "listing")
    raw = write_table(wbk.read_raw(files, listing), "raw_cells", ["workbook", "sheet", "row", "col"])
    cells = wbk.cells_of(raw)
    errors = wbk.workbook_errors(listing, raw)
    if max_file_size is not None:
        errors = errors.unionByName(wbk.oversized_files(spark, paths, max_file_size))
    sheets = listing.filter(F.col("error").isNull()).select(F.col("path").alias("workbook"), "sheet", "sheet_idx")
    metadata = wbk.workbook_metadata(files, cells, listing)
    now = F.lit(now_seconds) if now_seconds is not None else F.unix_timestamp(F.current_timestamp())
    chunks = pg.chunk_cursors(pf.sheet_chunks(cells, chunk_size, stream_mode, sheets)).join(
        metadata.select("workbook", "checksum"), "workbook", "left")
    chunks = chunks.withColumn("cursor", encode_cursor("chunk_id", "first_sheet", "checksum", now))
    tokens = with_model_limits(metadata.select("workbook", F.lit(model).alias("model")))
    tokens = tokens.withColumn("optimal_chunk_tokens", optimal_chunk_tokens("safe_buffer"))
    return {
        "cells": cells, "sheets": sheets, "metadata": metadata, "chunks": chunks,
        "patterns": pf.naming_patterns(sheets), "groups": pf.structural_groups(sheets),
        "formulas": pf.formula_complexity(cells), "value_types": pf.value_types(cells),
        "tokens": tokens, "errors": errors,
    }


def build_navigation(cells: DataFrame, sheets: DataFrame | None = None, window_size: int = 1000, offset: int = 0,
                     index_path: str | None = None, metadata: DataFrame | None = None, known: DataFrame | None = None,
                     model: str = "sonnet-4", now_seconds: int | None = None) -> dict:
    """build_navigation_map: per-sheet profiles (A1), zones (W3), key points (L7), hot zones
    (A13), the requested page of sheets (W6) and index statistics (A9); with ``index_path``
    the search index is written there (K5).

    With ``metadata`` (workbook, checksum of :func:`analyse_files`) also ``control``, a row per workbook: whether the
    checksum is the one in ``known`` (workbook, checksum; J4), the cache's time to live and key (F28), the cursor of the
    next page of sheets or null (F22), and the tokens of the page's profiles as JSON against the model's buffer (F29)."""
    sheets = pf.sheets(cells).select(*pf.SHEET) if sheets is None else sheets
    profiles = pf.sheet_profile(cells, sheets)
    postings, numeric = ix.build_postings(cells), ix.build_numeric_index(cells)
    if index_path:
        ix.write_index(cells, index_path)
    page = pg.nav_page(sheets, offset, window_size)
    out = {
        "profiles": profiles, "zones": pf.sheet_zones(profiles), "key_points": pf.key_points(cells),
        "hot_zones": pf.hot_zones(cells), "page": page, "index_stats": ix.index_stats(cells, postings, numeric),
    }
    if metadata is not None:
        out["control"] = _control(page, sheets, profiles, metadata, known, offset + window_size, model, now_seconds)
    return out


def _control(page: DataFrame, sheets: DataFrame, profiles: DataFrame, metadata: DataFrame, known: DataFrame | None, next_sheet: int,
             model: str, now_seconds: int | None) -> DataFrame:
    books = metadata.select("workbook", "checksum")
    known = books.limit(0) if known is None else known
    books = cm.changed_checksums(books, known, ["workbook"]).withColumn("checksum_match", ~F.col("changed")).drop("changed")
    total = sheets.groupBy("workbook").agg(F.count(F.lit(1)).alias("_n"))
    shown = profiles.join(page.select("workbook", "sheet"), ["workbook", "sheet"], "left_semi")
    used = shown.groupBy("workbook").agg(F.sum(estimate_tokens(F.to_json(F.struct(*shown.columns)))).alias("_used"))
    rows = books.join(total, "workbook", "left").join(used, "workbook", "left").fillna(0, ["_n", "_used"])
    rows = with_model_limits(rows.withColumn("model", F.lit(model)))
    now = F.lit(now_seconds) if now_seconds is not None else F.unix_timestamp(F.current_timestamp())
    cache, tokens = cache_control("checksum", "checksum_match"), token_tracking("_used", "safe_buffer")
    cursor = encode_cursor(F.concat(F.lit("nav_"), F.lit(next_sheet)), F.lit(next_sheet), "checksum", now)
    return rows.select("workbook", "checksum", "checksum_match", *[c.alias(n) for n, c in cache.items()],
                       F.when(F.col("_n") > next_sheet, cursor).alias("next_cursor"), *[c.alias(n) for n, c in tokens.items()])


def query_cells(cells: DataFrame, text: str | None = None, postings: DataFrame | None = None, lo=None, hi=None,
                pattern: str | None = None, sheet_query: str | None = None, max_results: int = 100,
                max_rows_per_sheet: int = 1000, max_sheets: int = 10, context: bool = False,
                exact: str | None = None, rect: tuple | None = None, after: dict | None = None,
                max_tokens: int | None = None) -> dict:
    """query_data: the typed searches (J1 text, P6 exact value, P4 numeric, P3 wildcard, P7 rectangle, P2 sheet names),
    united without duplicates (U1), capped in a total order (L1), with an optional context
    (P12: headings, neighbours and formulas) and the result statistics (A14).

    ``after``, a location, gives the page behind it (L4); ``has_more`` of each hit says whether there is another page
    (L5), whose ``after`` is the last hit's location.  With ``max_tokens`` a page ends before its values' tokens, each
    hit's own included, pass the budget (W7); the rest comes with the next page."""
    parts = []
    if text is not None:
        parts.append(sr.search_text(postings if postings is not None else ix.build_postings(cells), text))
    if exact is not None:
        parts.append(cells.filter(F.col("value") == exact))
    if lo is not None or hi is not None:
        parts.append(sr.search_numeric(cells, lo, hi))
    if pattern is not None:
        parts.append(sr.search_wildcard(cells, pattern))
    if rect is not None:
        parts.append(sr.search_rect(cells, *rect))
    out = {}
    if sheet_query is not None:
        out["sheets"] = sr.scan_sheets(cells, sheet_query, max_sheets, max_rows_per_sheet)
    if parts:
        hits = sr.union_hits(*parts)
        order = [(c, True) for c in LOCATION]
        if after is not None:
            hits = hits.filter(pg.after_key(order, after))
        page = pg.with_has_more(hits.join(cells, LOCATION), order, max_results)
        if max_tokens is not None:
            # over a page's rows, so one small window
            w = Window.partitionBy(F.lit(0)).orderBy(*LOCATION)
            used = F.sum(estimate_tokens(F.coalesce("value", F.lit("")))).over(w)
            whole = Window.partitionBy(F.lit(0))
            page = page.withColumn("tokens_used", used).withColumn("_kept", (F.col("tokens_used") <= max_tokens) | (F.row_number().over(w) == 1))
            page = page.withColumn("has_more", F.col("has_more") | F.bool_or(~F.col("_kept")).over(whole)).filter("_kept").drop("_kept")
        out["hits"] = sr.with_location_text(page)
        out["statistics"] = pf.column_stats(page)
        if context:
            at = page.select(*LOCATION)
            out["context"] = sr.hit_context(at, cells)
            out["context_parts"] = dp.hit_parts(at, cells)
    return out
