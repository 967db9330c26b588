"""Workbooks as a Spark data source: ``spark.read.format("gridlake_workbook").load(folder)``.

The rows are those of :func:`gridlake.sources.workbook.read_raw` (``cells_of`` makes them cells).  The driver lists
files and their sizes, as Spark's own file sources do, and opens none.  Small files are put together until a
partition has about ``splitBytes`` (compressed); a larger one becomes several partitions, each of which takes the
sheets that begin in its share of the file's compressed bytes, so many small sheets are one task and a large one is
its own.  Filters on ``sheet``, ``sheet_idx`` and ``row`` are pushed into the reader (with
``spark.sql.python.filterPushdown.enabled``): sheets that cannot match are not inflated, and reading a sheet ends after
its last wanted row.

Options: ``path``, ``splitBytes`` (8 MB), ``maxFileSize`` (P9: larger files are left out).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In,
                                    InputPartition, LessThan, LessThanOrEqual)

from gridlake.sources import workbook as wbk
from gridlake.sources.files import open_path

NAME = "gridlake_workbook"
SPLIT_BYTES = 8 << 20


@dataclass
class Share(InputPartition):
    """Files, each with the share of it that is read: (path, share, shares)."""

    files: list[tuple[str, int, int]]

    def __init__(self, files):
        super().__init__(files)
        self.files = files


@dataclass
class Wanted:
    """What the pushed filters leave: sheet names and ordinals (None: any) and the first and last row and ordinal."""

    sheets: set | None = None
    low: dict[str, int] = field(default_factory=lambda: {"row": 1, "sheet_idx": 0})
    high: dict[str, int] = field(default_factory=lambda: {"row": 1 << 62, "sheet_idx": 1 << 62})

    def take(self, f) -> bool:
        """Takes a filter in; False if it is not of the kinds that are understood."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if name == "sheet" and isinstance(f, (EqualTo, In)):
            names = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.sheets = names if self.sheets is None else self.sheets & names
            return True
        if name not in self.low or isinstance(f, In) or not isinstance(getattr(f, "value", None), int):
            return False
        v = f.value
        if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
            self.low[name] = max(self.low[name], v + isinstance(f, GreaterThan))
        if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
            self.high[name] = min(self.high[name], v - isinstance(f, LessThan))
        return isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))

    def sheet(self, ordinal: int, name: str) -> bool:
        return (self.sheets is None or name in self.sheets) and self.low["sheet_idx"] <= ordinal <= self.high["sheet_idx"]


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.most = int(options["maxFileSize"]) if "maxFileSize" in options else None
        self.wanted = Wanted()

    def pushFilters(self, filters) -> Iterator:
        return (f for f in filters if not self.wanted.take(f))

    def partitions(self) -> list[Share]:
        fs, inner = open_path(self.path)
        prefix = self.path[:len(self.path) - len(inner)] if self.path.endswith(inner) else ""
        info = fs.get_file_info(inner)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(inner, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.lower().endswith((".xlsx", ".xlsm"))
                       and not f.base_name.startswith(("_", ".")) and (self.most is None or f.size <= self.most))
        out: list[Share] = []
        small: list[tuple[str, int, int]] = []
        held = 0
        for path, size in files:
            shares = math.ceil(size / self.split)
            if shares > 1:
                out += [Share([(prefix + path, k, shares)]) for k in range(shares)]
                continue
            if small and held + size > self.split:
                out.append(Share(small))
                small, held = [], 0
            small.append((prefix + path, 0, 1))
            held += size
        return out + [Share(small)] if small or not out else out

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        for path, share, shares in partition.files:
            try:
                with wbk.open_zip(path) as zf:
                    yield from self._sheets(path, zf, share, shares)
            except wbk.DAMAGE as e:
                if share == 0:
                    yield _batch(path, None, None, None, wbk.reason(e))

    def _sheets(self, path: str, zf, share: int, shares: int) -> Iterator[pa.RecordBatch]:
        packed = {i.filename: i.compress_size for i in zf.infolist()}
        sheets = wbk.list_sheets(zf)
        total, before, own = sum(packed.get(part, 0) for _, _, part, _ in sheets) or 1, 0, []
        for ordinal, name, part, _ in sheets:
            if before * shares // total == share and self.wanted.sheet(ordinal, name):
                own.append((ordinal, name, part))
            before += packed.get(part, 0)
        if not own:
            return
        strings, dates = wbk.strings_of(path, zf), wbk.date_styles(zf)
        low, high = self.wanted.low["row"], self.wanted.high["row"]
        for ordinal, name, part in own:
            try:
                for batch in wbk.parse_sheet_batches(zf, part, strings, dates):
                    rows = batch.column(0)
                    kept = batch if low <= 1 and rows[-1].as_py() <= high else batch.filter(pc.and_(pc.greater_equal(rows, low), pc.less_equal(rows, high)))
                    if kept.num_rows:
                        yield _batch(path, name, ordinal, kept)
                    if rows[-1].as_py() >= high:
                        break
            except wbk.DAMAGE as e:
                yield _batch(path, name, ordinal, None, wbk.reason(e))


def _batch(path: str, sheet: str | None, ordinal: int | None, cells: pa.RecordBatch | None, error: str | None = None) -> pa.RecordBatch:
    n = cells.num_rows if cells is not None else 1
    fixed = {"workbook": pa.scalar(path, pa.string()), "sheet": pa.scalar(sheet, pa.string()),
             "sheet_idx": pa.scalar(ordinal, pa.int32()), "error": pa.scalar(error, pa.string())}
    names = [f.name for f in wbk.RAW_CELLS_SCHEMA.fields]
    return pa.RecordBatch.from_arrays([pa.repeat(fixed[x], n) if x in fixed else cells.column(x) if cells is not None
                                       else pa.nulls(1, wbk.OUT_KINDS[x]) for x in names], names=names)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        return wbk.RAW_CELLS_SCHEMA

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options)


def register(spark: SparkSession) -> str:
    """Makes the format known to a session, with filter pushdown, and returns its name."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkbookSource)
    return NAME
