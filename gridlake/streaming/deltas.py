"""Cell changes from delta files, applied in batch or by Structured Streaming.

Store layout under ``root`` (a shared folder), merge-on-read by sheet version::

    cells/batch_id=N/                      new cells of the sheets touched by batch N
    postings/, numeric/batch_id=N/         the index tables of those sheets
    bad_deltas/batch_id=N/                 changes whose location cannot be read
    manifest/batch_id=N/                   (workbook, sheet) touched by batch N (the commit)
    pending_sheets/batch_id=N/             sheet_add deltas waiting for a sheet (T2)
    rebuild_requests/batch_id=N/           bulk changes over the threshold (T2, A19)

Batch 0 is the initial snapshot.  The current cells of a sheet are those of the highest
batch in the manifest that touched it.  Batch N reads the state as of batch N-1 and
overwrites only its own ``batch_id=N`` folders, so a replayed micro-batch writes the same
files again: the update is idempotent.  Only touched sheets are read and rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.operators.compare import BULK_REBUILD_CELLS, apply_cell_deltas, bad_deltas, bulk_impact, cell_deltas
from gridlake.operators.index import build_numeric_index, build_postings
from gridlake.operators.sequence import null_safe_join
from gridlake.schema import CELL_COLUMNS, CELLS_SCHEMA, DELTA_SCHEMA


def read_deltas(spark: SparkSession, path: str) -> DataFrame:
    """S8 (batch): JSON-lines delta files with the fixed delta schema (no inference)."""
    return spark.read.schema(DELTA_SCHEMA).json(path)


def stream_deltas(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """S8 (streaming): the same files as a stream."""
    r = spark.readStream.schema(DELTA_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(path)


def _fields(schema) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)


_SHEET = ["workbook", "sheet"]
_VERSIONED = "batch_id BIGINT"
#: Tables kept by sheet version, and how each comes from the cells of the touched sheets.
_TABLES = {
    "cells": (_fields(CELLS_SCHEMA), lambda cells: cells.select(*CELL_COLUMNS)),
    "postings": ("token STRING, workbook STRING, sheet STRING, row BIGINT, col INT, tf BIGINT", build_postings),
    "numeric": ("workbook STRING, sheet STRING, num DOUBLE, row BIGINT, col INT", build_numeric_index),
}


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def _read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A versioned table with its schema given, so that names like ``01`` stay text."""
    ddl = "workbook STRING, sheet STRING" if table == "manifest" else _TABLES[table][0]
    return spark.read.schema(f"{ddl}, {_VERSIONED}").parquet(f"{root}/{table}")


def _write_sheets(cells: DataFrame, root: str, version: int) -> None:
    """A version's cells (clustered by sheet), and the index tables built from the written cells."""
    at = lambda table: f"{root}/{table}/batch_id={version}"
    _write(_TABLES["cells"][1](cells).sortWithinPartitions(*_SHEET, "row", "col"), at("cells"))
    stored = cells.sparkSession.read.schema(CELLS_SCHEMA).parquet(at("cells"))
    for table in ("postings", "numeric"):
        _write(_TABLES[table][1](stored), at(table))


def init_store(cells: DataFrame, root: str, version: int = 0) -> None:
    """Write the initial snapshot as batch 0 (cells and index tables, then the manifest that commits it)."""
    _write_sheets(cells, root, version)
    _write(cells.select(*_SHEET).distinct(), f"{root}/manifest/batch_id={version}")


def _current(spark: SparkSession, root: str, table: str, as_of: int | None) -> DataFrame:
    manifest, rows = _read(spark, root, "manifest"), _read(spark, root, table)
    if as_of is not None:  # on both: a batch that is written again must not be read meanwhile
        manifest, rows = manifest.filter(F.col("batch_id") <= as_of), rows.filter(F.col("batch_id") <= as_of)
    latest = manifest.groupBy(*_SHEET).agg(F.max("batch_id").alias("batch_id"))
    return null_safe_join(rows, latest, [*_SHEET, "batch_id"], "left_semi").drop("batch_id")


def current_cells(spark: SparkSession, root: str, as_of: int | None = None) -> DataFrame:
    """The cells as of batch ``as_of`` (default: latest): per sheet, the version of the last
    batch that touched it (a sheet whose last version is empty has no cells)."""
    return _current(spark, root, "cells", as_of).select(*CELL_COLUMNS)


def current_postings(spark: SparkSession, root: str, as_of: int | None = None) -> DataFrame:
    """The postings that belong to :func:`current_cells`."""
    return _current(spark, root, "postings", as_of)


def current_numeric(spark: SparkSession, root: str, as_of: int | None = None) -> DataFrame:
    """The numeric index that belongs to :func:`current_cells`."""
    return _current(spark, root, "numeric", as_of)


def compact_store(spark: SparkSession, root: str, target: str) -> None:
    """A new store at ``target`` whose only version holds the current state, under the latest version's number, so
    that later batches go on from it: the old versions and their listing stay behind in ``root``."""
    latest = _read(spark, root, "manifest").agg(F.max("batch_id")).first()[0]
    init_store(current_cells(spark, root), target, latest)


def apply_batch(deltas: DataFrame, batch_id: int, root: str, bulk_threshold: int = BULK_REBUILD_CELLS) -> None:
    """T1 + T2 for one micro-batch (the ``foreachBatch`` body); ``batch_id`` >= 0 becomes
    store version ``batch_id + 1``."""
    spark = deltas.sparkSession
    version = batch_id + 1
    # four writes read this micro-batch: keep it for the batch (recomputable from the source
    # offsets if an executor is lost), drop it afterwards
    deltas = deltas.persist()
    try:
        _apply(spark, deltas, version, root, bulk_threshold)
    finally:
        deltas.unpersist()


def _apply(spark: SparkSession, deltas: DataFrame, version: int, root: str, bulk_threshold: int) -> None:
    bad = bad_deltas(deltas)
    # from here on a change's sheet is the one its location names
    updates = cell_deltas(deltas).filter(~F.col("bad_location") & F.col("type").isin("cell_update", "formula_change"))
    touched = updates.select(*_SHEET).distinct()
    before = null_safe_join(current_cells(spark, root, as_of=version - 1), touched, _SHEET, "left_semi")
    _write_sheets(apply_cell_deltas(before, updates.select(*deltas.columns)), root, version)
    _write(deltas.filter(F.col("type") == "sheet_add"), f"{root}/pending_sheets/batch_id={version}")
    _write(bad, f"{root}/bad_deltas/batch_id={version}")
    bulk = deltas.filter(F.col("type") == "bulk_change")
    _write(bulk_impact(bulk, _SHEET, "affected_cells", bulk_threshold), f"{root}/rebuild_requests/batch_id={version}")
    _write(touched, f"{root}/manifest/batch_id={version}")  # last: this commits the version


def start_updates(stream: DataFrame, root: str, checkpoint: str, trigger: dict | None = None):
    """T1 streaming: apply each micro-batch with :func:`apply_batch`; ``checkpoint`` must be
    a shared folder.  Returns the running ``StreamingQuery``."""
    w = stream.writeStream.foreachBatch(lambda df, bid: apply_batch(df, bid, root)).option("checkpointLocation", checkpoint)
    if trigger:
        w = w.trigger(**trigger)
    return w.start()
