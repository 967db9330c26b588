"""Workbooks (.xlsx/.xlsm zips) -> sheet list, ``cells`` and file metadata.

Spark lists the files with the ``binaryFile`` source; the only Python is the XML parse of
a sheet part, run by ``mapInArrow`` over chunks of whole rows (a compiled regex pass decoded
with Arrow kernels, ElementTree for chunks the regex does not fully cover), so a sheet is
never held whole.  A big workbook is split into groups of sheets of about
``target_bytes`` of sheet XML, each group its own task, so one huge workbook does not become
one task (the zip bytes travel once per group, not once per sheet).
"""

from __future__ import annotations

import datetime as dt
import html
import posixpath
import re
import zipfile
import zlib
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlake.functions.a1 import cell_ref
from gridlake.functions.shift import shift_formula
from gridlake.functions.values import cell_kind, parse_number
from gridlake.operators.profile import complexity_score
from gridlake.schema import CELL_COLUMNS
from gridlake.session import write_table
from gridlake.sources.files import open_path
from gridlake.sources.tables import number_rows

# Element names are matched in any namespace ("{*}name"), so transitional and strict workbooks, and
# any namespace prefix, read alike.

# Fixed values (ECMA-376 built-in number formats that show dates or times).
BUILTIN_DATE_FORMATS = set(range(14, 23)) | {45, 46, 47}
EXCEL_EPOCH = dt.datetime(1899, 12, 30)
EPOCH_1904 = dt.datetime(1904, 1, 1)

LISTING_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("sheet_idx", T.IntegerType()),
    T.StructField("sheet", T.StringType()), T.StructField("part", T.StringType()),
    T.StructField("part_bytes", T.LongType()), T.StructField("error", T.StringType()),
])
RAW_CELLS_SCHEMA = T.StructType([
    T.StructField("workbook", T.StringType()), T.StructField("sheet", T.StringType()),
    T.StructField("sheet_idx", T.IntegerType()), T.StructField("row", T.LongType()),
    T.StructField("col", T.IntegerType()), T.StructField("value", T.StringType()),
    T.StructField("formula", T.StringType()), T.StructField("is_date", T.BooleanType()),
    T.StructField("serial", T.DoubleType()), T.StructField("error", T.StringType()),
])

_REF = re.compile(r"^([A-Z]{1,3})([0-9]+)$")


# ---------------------------------------------------------------- per-file helpers (run in tasks)

def _col_number(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n


def _local(elem) -> str:
    """An element's name without its namespace."""
    return elem.tag.rpartition("}")[2]


def _text_of(elem) -> str:
    """Text of a string item: its ``<t>``, or the ``<t>`` of each rich run (phonetic runs skipped)."""
    if elem is None:
        return ""
    parts = []
    for child in elem:
        if _local(child) == "t":
            parts.append(child.text or "")
        elif _local(child) == "r":
            t = child.find("{*}t")
            parts.append((t.text or "") if t is not None else "")
    return "".join(parts)


def _relations(zf: zipfile.ZipFile, rels_part: str, base: str) -> list[tuple[str, str, str]]:
    """(id, last part of the type, target part) of a relationship part; none if it is absent."""
    if rels_part not in zf.namelist():
        return []
    out = []
    for r in ET.fromstring(zf.read(rels_part)).findall("{*}Relationship"):
        target = r.get("Target", "")
        target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(base, target))
        out.append((r.get("Id"), r.get("Type", "").rpartition("/")[2], target))
    return out


def _workbook_part(zf: zipfile.ZipFile) -> str:
    main = [t for _, kind, t in _relations(zf, "_rels/.rels", "") if kind == "officeDocument"]
    return main[0] if main and main[0] in zf.namelist() else "xl/workbook.xml"


def _workbook_relations(zf: zipfile.ZipFile) -> list[tuple[str, str, str]]:
    folder, name = posixpath.split(_workbook_part(zf))
    return _relations(zf, f"{folder}/_rels/{name}.rels", folder)


def _related(zf: zipfile.ZipFile, kind: str, default: str) -> str | None:
    """The part that the workbook relates to by ``kind``, or the usual one, if it is there."""
    for part in [t for _, k, t in _workbook_relations(zf) if k == kind] + [default]:
        if part in zf.namelist():
            return part
    return None


def list_sheets(zf: zipfile.ZipFile) -> list[tuple[int, str, str, int]]:
    """(ordinal, name, part path, uncompressed bytes) of every worksheet, in workbook order.  A workbook
    part without a list of sheets is an error."""
    wb = ET.fromstring(zf.read(_workbook_part(zf)))
    rels = {i: target for i, _, target in _workbook_relations(zf)}
    sheets = wb.find("{*}sheets")
    if sheets is None:
        raise ValueError("the workbook part lists no sheets")
    names = set(zf.namelist())
    out = []
    for i, s in enumerate(sheets):
        rel = next((v for k, v in s.attrib.items() if k.endswith("}id")), None)
        part = rels.get(rel, f"xl/worksheets/sheet{i + 1}.xml")
        out.append((i, s.get("name"), part, zf.getinfo(part).file_size if part in names else 0))
    return out


_SI_PLAIN = re.compile(rb"<si>\s*<t(?: [^>]*)?(?:/>|>([^<]*)</t>)\s*</si>")
_SI_ANY = re.compile(rb"<(?:\w+:)?si[\s/>]")


def shared_strings(zf: zipfile.ZipFile) -> list[str]:
    """The workbook's shared strings: one regex pass when all are plain, ElementTree otherwise."""
    part = _related(zf, "sharedStrings", "xl/sharedStrings.xml")
    if part is None:
        return []
    if zf.getinfo(part).file_size <= 64 << 20:
        raw = zf.read(part)
        plain = _SI_PLAIN.findall(raw)
        if len(plain) == len(_SI_ANY.findall(raw)):
            return [_unescape(t) for t in plain]
    out = []
    with zf.open(part) as fh:
        for _, elem in ET.iterparse(fh):
            if _local(elem) == "si":
                out.append(_text_of(elem))
                elem.clear()
    return out


_STRINGS: dict[str, pa.Array] = {}


def strings_of(path: str, zf: zipfile.ZipFile) -> pa.Array:
    """A workbook's shared strings; the last workbook's are kept, since the groups of one workbook often meet
    the same Python worker, if they are not over 64 MB."""
    info = zf.getinfo(_related(zf, "sharedStrings", "xl/sharedStrings.xml")) if _related(
        zf, "sharedStrings", "xl/sharedStrings.xml") else None
    key = f"{path}|{info.CRC if info else 0}|{info.file_size if info else 0}"
    if key not in _STRINGS:
        found = pa.array(shared_strings(zf), pa.string())
        _STRINGS.clear()
        if found.nbytes > 64 << 20:
            return found
        _STRINGS[key] = found
    return _STRINGS[key]


class DateStyles(set):
    """Style numbers that show dates, and whether the workbook counts days from 1904."""

    date1904 = False


_DATE_CODE = re.compile(r"(\"[^\"]*\"|\[[^\]]*\]|\\.)")


def date_styles(zf: zipfile.ZipFile) -> DateStyles:
    """Indexes of cell styles (``s`` attribute) whose number format shows a date or time."""
    out = DateStyles()
    main = _workbook_part(zf)
    if main in zf.namelist():
        props = ET.fromstring(zf.read(main)).find("{*}workbookPr")
        out.date1904 = props is not None and props.get("date1904", "0") in ("1", "true", "on")
    part = _related(zf, "styles", "xl/styles.xml")
    if part is None:
        return out
    root = ET.fromstring(zf.read(part))
    custom = {}
    fmts = root.find("{*}numFmts")
    for f in (fmts if fmts is not None else []):
        code = _DATE_CODE.sub("", f.get("formatCode", "")).lower()
        custom[int(f.get("numFmtId"))] = bool(re.search(r"[ymdhs]", code)) and "general" not in code
    xfs = root.find("{*}cellXfs")
    for i, xf in enumerate(xfs if xfs is not None else []):
        fid = int(xf.get("numFmtId", "0"))
        if fid in BUILTIN_DATE_FORMATS or custom.get(fid, False):
            out.add(i)
    return out


def serial_to_iso(serial: float, date1904: bool = False) -> str:
    """A date serial as ISO text: date only when there is no time part.  The 1900 system counts a 29 February
    1900 that never was as day 60, so days before it start one day later."""
    if not date1904 and 60 <= serial < 61:
        time = (EXCEL_EPOCH + dt.timedelta(days=serial)).time()
        return "1900-02-29" if time == dt.time(0) else f"1900-02-29 {time.isoformat()}"
    epoch = EPOCH_1904 if date1904 else EXCEL_EPOCH + dt.timedelta(days=serial < 60)
    t = epoch + dt.timedelta(days=serial)
    return t.date().isoformat() if t.time() == dt.time(0) else t.isoformat(sep=" ")


def _shared(shared_f: dict, si: str, row: int, col: int) -> str | None:
    """The formula of a cell that shares group ``si``; None when the sheet never gave its text."""
    if si not in shared_f:
        return None
    text, at_row, at_col = shared_f[si]
    return shift_formula(text, row - at_row, col - at_col)


def _cells_of_row(row, row_no: int, strings: list[str], dates: set[int], shared_f: dict) -> list[tuple]:
    """(row, col, value, formula, is_date, serial) of the cells of one ``<row>`` element;
    empty cells without a formula are skipped; dependents of a shared formula get the master's text with
    its relative references moved."""
    out, col_no = [], 0
    for elem in row.findall(".//{*}c"):
        ref = elem.get("r")
        m = _REF.match(ref) if ref else None
        col_no = _col_number(m.group(1)) if m else col_no + 1
        t = elem.get("t", "n")
        v = elem.find("{*}v")
        raw = v.text if v is not None and v.text is not None else None
        f = elem.find("{*}f")
        formula = None
        if f is not None:
            si = f.get("si")
            if f.text:
                formula = f.text
                if si is not None:
                    shared_f[si] = (f.text, row_no, col_no)
            elif si is not None:
                formula = _shared(shared_f, si, row_no, col_no)
        value, is_date, serial = None, False, None
        if t == "s" and raw is not None:
            idx = int(raw)
            value = strings[idx] if 0 <= idx < len(strings) else None
        elif t == "inlineStr":
            value = _text_of(elem.find("{*}is"))
        elif t == "b" and raw is not None:
            value = "TRUE" if raw.strip() in ("1", "true") else "FALSE"
        elif t in ("str", "e", "d"):
            value = raw
        elif raw is not None:
            value = raw
            style = elem.get("s")
            if style is not None and int(style) in dates:
                try:
                    serial = float(raw)
                    value, is_date = serial_to_iso(serial, getattr(dates, "date1904", False)), True
                except (ValueError, OverflowError):
                    pass
        if value == "":
            value = None
        if value is not None or formula is not None:
            out.append((row_no, col_no, value, formula, is_date, serial))
    return out


# Fast path: one compiled regex pass per chunk of whole <row> elements, decoded column-wise.
# A chunk whose cells do not all match (unusual attribute order, missing r=) is parsed by
# ElementTree instead, in any namespace, so the fast path never drops a cell.
_CELL = re.compile(
    rb'<c r="([A-Z]{1,3})([0-9]+)"(?: s="([0-9]+)")?(?: t="([a-zA-Z]+)")?(?: s="([0-9]+)")?'
    rb'(?: (?:cm|vm|ph)="[^"]*")*\s*'
    rb'(?:/>|>(?:<f((?: [a-zA-Z]+="[^"]*")*)\s*(?:/>|>([^<]*)</f>))?(?:<v>([^<]*)</v>)?'
    rb'(?:<is><t(?: [^>]*)?>([^<]*)</t></is>|<is>(.*?)</is>)?</c>)', re.S)
_CELL_START = re.compile(rb"<c[ >/]")
_SI = re.compile(rb'si="([0-9]+)"')
_XML_T = re.compile(r"<t(?: [^>]*)?>([^<]*)</t>")


_SHEET_DATA = re.compile(rb"<(?:([A-Za-z_][\w.-]*):)?sheetData(?=[\s/>])")


def _row_chunks(fh, block: int = 8 << 20) -> Iterator[bytes]:
    """Chunks of whole ``<row>`` elements from a sheet part stream (sheetData body only), without the
    namespace prefix that the part may use.  A part that is no worksheet, or ends early, is an error."""
    buf, prefix, data = b"", None, b""
    while prefix is None:
        data = fh.read(block)
        buf += data
        m = _SHEET_DATA.search(buf)
        j = buf.find(b">", m.end()) if m else -1
        if j >= 0:
            prefix = m[1] + b":" if m[1] else b""
            if buf[j - 1:j] == b"/":  # <sheetData/>: no rows
                return
            buf = buf[j + 1:]
        elif not data:
            if m is None and re.search(rb"</(?:[\w.-]+:)?(?:worksheet|chartsheet|dialogsheet|macrosheet)>", buf):
                return  # a sheet without cells
            raise ValueError("the sheet part has no complete sheetData element")
        elif m is None and len(buf) > 2 * block:
            buf = buf[-block:]
    row_end, data_end = b"</" + prefix + b"row>", b"</" + prefix + b"sheetData"

    def plain(chunk: bytes) -> bytes:
        return chunk.replace(b"<" + prefix, b"<").replace(b"</" + prefix, b"</") if prefix else chunk

    while True:
        end = buf.find(data_end)
        if end >= 0:
            if buf[:end].strip():
                yield plain(buf[:end])
            return
        cut = buf.rfind(row_end)
        if cut >= 0 and len(buf) >= block:
            yield plain(buf[:cut + len(row_end)])
            buf = buf[cut + len(row_end):]
        if not data:
            if cut >= 0 and (whole := buf[:buf.rfind(row_end) + len(row_end)]).strip():
                yield plain(whole)
            raise ValueError("the sheet part ends inside its rows")
        data = fh.read(block)
        buf += data


def _unescape(b: bytes) -> str:
    t = b.decode("utf-8")
    return html.unescape(t) if "&" in t else t


OUT_FIELDS = [("row", pa.int64()), ("col", pa.int32()), ("value", pa.string()), ("formula", pa.string()),
               ("is_date", pa.bool_()), ("serial", pa.float64())]


OUT_KINDS = dict(OUT_FIELDS)


def _empty_batch() -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], t) for _, t in OUT_FIELDS], names=[n for n, _ in OUT_FIELDS])


def _fast_chunk(chunk: bytes, strings: pa.Array, dates: set[int], shared_f: dict) -> pa.RecordBatch | None:
    """Decode one chunk column-wise with Arrow kernels; per-cell Python runs only for rare
    cells (rich inline strings, XML entities, dates, formulas)."""
    found = _CELL.findall(chunk)
    if len(found) != len(_CELL_START.findall(chunk)):
        return None
    if not found:
        return _empty_batch()
    letters, rows, s1, t, s2, fat, ftext, v, inl, rich = zip(*found)
    b = lambda x: pa.array(x, pa.binary())
    T, V = b(t), b(v)
    row = b(rows).cast(pa.string()).cast(pa.int64())
    L = b(letters)
    uniq = pc.unique(L)
    col = pc.take(pa.array([_col_number(x.decode()) for x in uniq.to_pylist()], pa.int32()), pc.index_in(L, value_set=uniq))
    value = pc.if_else(pc.equal(V, b""), pa.scalar(None, pa.string()), V.cast(pa.string()))
    is_s = pc.equal(T, b"s")
    if pc.any(is_s).as_py():
        idx = pc.if_else(pc.and_(is_s, pc.not_equal(V, b"")), V, b"-1").cast(pa.string()).cast(pa.int64())
        ok = pc.and_(pc.greater_equal(idx, 0), pc.less(idx, len(strings)))
        looked = pc.take(strings, pc.if_else(ok, idx, 0)) if len(strings) else pa.nulls(len(idx), pa.string())
        value = pc.if_else(is_s, pc.if_else(ok, looked, pa.scalar(None, pa.string())), value)
    is_inl = pc.equal(T, b"inlineStr")
    if pc.any(is_inl).as_py():
        inline = b(inl).cast(pa.string())
        R = b(rich)
        has_rich = pc.and_(is_inl, pc.and_(pc.equal(b(inl), b""), pc.not_equal(R, b"")))
        if pc.any(has_rich).as_py():
            vals = inline.to_pylist()
            for i in pc.indices_nonzero(has_rich).to_pylist():
                vals[i] = "".join(html.unescape(x) for x in _XML_T.findall(rich[i].decode("utf-8")))
            inline = pa.array(vals, pa.string())
        value = pc.if_else(is_inl, inline, value)
    is_b = pc.equal(T, b"b")
    if pc.any(is_b).as_py():
        truth = pc.or_(pc.equal(V, b"1"), pc.equal(V, b"true"))
        bval = pc.if_else(pc.equal(V, b""), pa.scalar(None, pa.string()), pc.if_else(truth, "TRUE", "FALSE"))
        value = pc.if_else(is_b, bval, value)
    fix = {}
    amp = pc.fill_null(pc.match_substring(value, "&"), False)
    if pc.any(amp).as_py():
        for i in pc.indices_nonzero(amp).to_pylist():
            fix[i] = html.unescape(value[i].as_py())
    n = len(found)
    is_date = serial = None
    if dates:
        d_flags, d_serial = [False] * n, [None] * n
        for i in range(n):
            st = s1[i] or s2[i]
            if st and t[i] in (b"", b"n") and int(st) in dates and v[i]:
                try:
                    d_serial[i] = float(v[i])
                    fix[i], d_flags[i] = serial_to_iso(d_serial[i], getattr(dates, "date1904", False)), True
                except (ValueError, OverflowError):
                    pass
        if any(d_flags):
            is_date, serial = pa.array(d_flags, pa.bool_()), pa.array(d_serial, pa.float64())
    if fix:
        vals = value.to_pylist()
        for i, x in fix.items():
            vals[i] = x
        value = pa.array(vals, pa.string())
    value = pc.if_else(pc.fill_null(pc.equal(value, ""), False), pa.scalar(None, pa.string()), value)
    has_f = pc.or_(pc.not_equal(b(fat), b""), pc.not_equal(b(ftext), b""))
    if pc.any(has_f).as_py():
        forms = [None] * n
        for i in pc.indices_nonzero(has_f).to_pylist():
            si = _SI.search(fat[i])
            si = si and si.group(1).decode()
            if ftext[i]:
                forms[i] = _unescape(ftext[i])
                if si:
                    shared_f[si] = (forms[i], int(rows[i]), _col_number(letters[i].decode()))
            elif si:
                forms[i] = _shared(shared_f, si, int(rows[i]), _col_number(letters[i].decode()))
        formula = pa.array(forms, pa.string())
    else:
        formula = pa.nulls(n, pa.string())
    if is_date is None:
        is_date, serial = pa.repeat(pa.scalar(False), n), pa.nulls(n, pa.float64())
    batch = pa.RecordBatch.from_arrays([row, col, value, formula, is_date, serial], names=[x for x, _ in OUT_FIELDS])
    return batch.filter(pc.or_(pc.is_valid(value), pc.is_valid(formula)))


def _slow_chunk(chunk: bytes, strings, dates, shared_f: dict, row_no: int) -> tuple[list[tuple], int]:
    """ElementTree parse of one chunk (wrapped in a root carrying the namespace)."""
    prefixes = set(re.findall(rb"[<\s/]([A-Za-z_][\w.-]*):[A-Za-z_]", chunk)) - {b"xml", b"xmlns"}
    spaces = b"".join(b' xmlns:' + p + b'="x"' for p in sorted(prefixes))
    root = ET.fromstring(b"<x" + spaces + b">" + chunk + b"</x>")
    out = []
    for row in root.findall(".//{*}row"):
        r = row.get("r")
        row_no = int(r) if r else row_no + 1
        out.extend(_cells_of_row(row, row_no, strings, dates, shared_f))
    return out, row_no


def parse_sheet_batches(zf: zipfile.ZipFile, part: str, strings: pa.Array, dates: set[int]) -> Iterator[pa.RecordBatch]:
    """A sheet part as Arrow batches of (row, col, value, formula, is_date, serial)."""
    shared_f: dict = {}
    row_no = 0
    py_strings = None
    with zf.open(part) as fh:
        for chunk in _row_chunks(fh):
            fast = _fast_chunk(chunk, strings, dates, shared_f)
            if fast is not None:
                if fast.num_rows:
                    row_no = fast.column(0)[-1].as_py()
                    yield fast
                continue
            if py_strings is None:
                py_strings = strings.to_pylist()
            rows, row_no = _slow_chunk(chunk, py_strings, dates, shared_f, row_no)
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, OUT_FIELDS)],
                                                 names=[x for x, _ in OUT_FIELDS])


def parse_sheet_frames(zf: zipfile.ZipFile, part: str, strings: list[str], dates: set[int]) -> Iterator[pd.DataFrame]:
    """The same as pandas frames (for tests and local use)."""
    for batch in parse_sheet_batches(zf, part, pa.array(strings, pa.string()), dates):
        yield batch.to_pandas()


def open_zip(path: str) -> zipfile.ZipFile:
    """Open a workbook where it lives (local, HDFS, S3, … through ``pyarrow.fs``) as a seekable
    file: a task reads the zip directory and the parts it needs, not the whole file."""
    fs, inner = open_path(path)
    return zipfile.ZipFile(fs.open_input_file(inner))


#: What a damaged workbook raises.  A storage error (OSError) is not among them: it fails the task, so Spark
#: tries it again, and a file is never taken for read that was not.
DAMAGE = (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError, IndexError, AttributeError, TypeError, EOFError,
          zlib.error, NotImplementedError, RuntimeError, UnicodeDecodeError, OverflowError, pa.ArrowInvalid)


def reason(e: BaseException) -> str:
    return f"{type(e).__name__}: {e}"


def _listing_fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path in pdf["path"]:
            try:
                with open_zip(path) as zf:
                    rows += [(path, i, name, part, size, None) for i, name, part, size in list_sheets(zf)]
            except DAMAGE as e:  # a bad file becomes an error row, the job goes on
                rows.append((path, None, None, None, None, reason(e)))
        yield pd.DataFrame(rows, columns=[f.name for f in LISTING_SCHEMA.fields])


def _parse_fn(batch_rows: int):
    names = [f.name for f in RAW_CELLS_SCHEMA.fields]

    def rows_of(path: str, sheet: dict, part: pa.RecordBatch | None, error: str | None = None) -> pa.RecordBatch:
        n = part.num_rows if part is not None else 1
        fixed = {"workbook": pa.scalar(path, pa.string()), "sheet": pa.scalar(sheet["sheet"], pa.string()),
                 "sheet_idx": pa.scalar(sheet["sheet_idx"], pa.int32()), "error": pa.scalar(error, pa.string())}
        return pa.RecordBatch.from_arrays(
            [pa.repeat(fixed[x], n) if x in fixed else part.column(x) if part is not None else pa.nulls(1, OUT_KINDS[x])
             for x in names], names=names)

    def sheets_of(path: str, zf: zipfile.ZipFile, sheets: list[dict]) -> Iterator[pa.RecordBatch]:
        strings, dates = strings_of(path, zf), date_styles(zf)
        for s in sheets:
            try:
                for batch in parse_sheet_batches(zf, s["part"], strings, dates):
                    for off in range(0, batch.num_rows, batch_rows):
                        yield rows_of(path, s, batch.slice(off, batch_rows))
            except DAMAGE as e:  # the cells before the fault stay, and the sheet gets an error row
                yield rows_of(path, s, None, reason(e))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for task in rb.to_pylist():
                try:
                    with open_zip(task["path"]) as zf:
                        yield from sheets_of(task["path"], zf, task["sheets"])
                except DAMAGE as e:  # shared strings, styles, or the zip itself
                    for s in task["sheets"]:
                        yield rows_of(task["path"], s, None, reason(e))
    return fn


# ---------------------------------------------------------------- Spark side

def workbook_files(spark: SparkSession, paths: str | Sequence[str], max_file_size: int | None = None,
                   glob: str = "*.[xX][lL][sS][xXmM]") -> DataFrame:
    """The files as ``binaryFile`` rows, sub-folders included; P9: files over ``max_file_size`` bytes are filtered
    on ``length`` before any content is read (see :func:`oversized_files`)."""
    files = _all_files(spark, paths, glob)
    return files if max_file_size is None else files.filter(F.col("length") <= max_file_size)


def _all_files(spark: SparkSession, paths: str | Sequence[str], glob: str) -> DataFrame:
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return reader.load(list(paths) if not isinstance(paths, str) else paths)


def oversized_files(spark: SparkSession, paths: str | Sequence[str], max_file_size: int,
                    glob: str = "*.[xX][lL][sS][xXmM]") -> DataFrame:
    """An error row (path, sheet, error) for each file over the limit."""
    big = _all_files(spark, paths, glob).filter(F.col("length") > max_file_size)
    return big.select("path", F.lit(None).cast("string").alias("sheet"),
                      F.concat(F.lit("file of "), F.col("length"), F.lit(f" bytes is over the limit of {max_file_size}")).alias("error"))


def sheet_listing(files: DataFrame) -> DataFrame:
    """(path, sheet_idx, sheet, part, part_bytes, error) — one row per sheet, or one error
    row for a file that is not a readable workbook (the job does not fail)."""
    return files.select("path").mapInPandas(_listing_fn, LISTING_SCHEMA)


def read_raw(files: DataFrame, listing: DataFrame | None = None, target_bytes: int = 4 << 20,
             batch_rows: int = 65_536, partition_bytes: int = 128 << 20) -> DataFrame:
    """S3 + S4 before typing: a row per cell, and a row with ``error`` for each sheet that could not be read to
    its end.

    Sheets are grouped per workbook by cumulative XML size (a window over the small sheet
    listing, one row per sheet); each (workbook, group) is one task that opens the zip
    itself and streams only its sheets, so no file content is shuffled.  The groups are written (a few
    numbers each), numbered in the order of their files, and cut into partitions of ``partition_bytes`` of XML or, if
    that gives too few for the cluster's cores, some per core: neighbours share a workbook's strings.  A sheet part is
    compressed as a whole and cannot be entered in the middle, so one sheet is one task's work.
    """
    listing = sheet_listing(files) if listing is None else listing
    ok = listing.filter(F.col("error").isNull())
    w = Window.partitionBy("path").orderBy("sheet_idx").rowsBetween(Window.unboundedPreceding, 0)
    grouped = ok.withColumn("_grp", F.floor(F.sum("part_bytes").over(w) / F.lit(target_bytes)).cast("bigint"))
    tasks = write_table(grouped.groupBy("path", "_grp").agg(
        F.array_sort(F.collect_list(F.struct("sheet_idx", "sheet", "part"))).alias("sheets"), F.sum("part_bytes").alias("bytes")), "sheet_groups")
    groups, size = tasks.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    n = max(1, min(groups, max(size // partition_bytes, 4 * files.sparkSession.sparkContext.defaultParallelism)))
    place = F.floor((F.col("row") - 1) * n / F.lit(max(groups, 1))).cast("int")
    dealt = number_rows(tasks, ["path", "_grp"]).repartitionById(n, place)
    return dealt.select("path", "sheets").mapInArrow(_parse_fn(batch_rows), RAW_CELLS_SCHEMA)


def cells_of(raw: DataFrame) -> DataFrame:
    """The ``cells`` table of the rows of :func:`read_raw`."""
    cells = (raw.filter(F.col("error").isNull()).withColumn("ref", cell_ref("col", "row"))
             .withColumn("num", F.when(F.col("is_date"), F.col("serial")).otherwise(parse_number("value")))
             .withColumn("kind", F.when(F.col("is_date") & F.col("formula").isNull(), F.lit("date"))
                         .otherwise(cell_kind("value", "num", "formula"))))
    return cells.select(*CELL_COLUMNS)


def read_cells(files: DataFrame, listing: DataFrame | None = None, target_bytes: int = 4 << 20,
               batch_rows: int = 65_536) -> DataFrame:
    """S3 + S4: the ``cells`` table of all workbooks (workbook = file path).  For the sheets that could not be
    read, write :func:`read_raw` once and take :func:`cells_of` and :func:`workbook_errors` of it."""
    return cells_of(read_raw(files, listing, target_bytes, batch_rows))


def workbook_errors(listing: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """(path, sheet, error): files that could not be opened and, given the rows of :func:`read_raw`, sheets that
    could not be read to their end."""
    out = listing.filter(F.col("error").isNotNull()).select("path", "sheet", "error")
    if raw is None:
        return out
    return out.unionByName(raw.filter(F.col("error").isNotNull()).select(F.col("workbook").alias("path"), "sheet", "error"))


def workbook_metadata(files: DataFrame, cells: DataFrame, listing: DataFrame) -> DataFrame:
    """S1 (+A2, A4): SHA-256 (hex), size, modification time, sheet count, complexity score
    and memory estimate per workbook.  The hash is computed JVM-side over ``content``; the
    sheet count comes from the listing, so empty sheets count too."""
    meta = files.select(F.col("path").alias("workbook"), F.sha2("content", 256).alias("checksum"),
                        F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"))
    sheets = (listing.filter(F.col("error").isNull())
              .select(F.col("path").alias("workbook"), "sheet_idx", "sheet"))
    return meta.join(complexity_score(cells, sheets), "workbook", "left")
