"""Cells written as ``.xlsx`` workbooks, one file per workbook."""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame

from gridlake.session import write_table
from gridlake.sources.files import open_path

#: Name spaces of the file format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _text(value: str) -> str:
    return escape(_NOT_XML.sub("�", value))


def _cell(ref: str, value: str | None, num: float | None, formula: str | None) -> str:
    f = f"<f>{_text(formula)}</f>" if formula else ""
    if value is None:
        return f'<c r="{ref}">{f}</c>'
    if num is not None:
        return f'<c r="{ref}">{f}<v>{_text(value)}</v></c>'
    if f:
        return f'<c r="{ref}" t="str">{f}<v>{_text(value)}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{_text(value)}</t></is></c>'


class _Book:
    """A workbook that is being written, sheet by sheet and row by row."""

    def __init__(self, out):
        self.zip, self.names, self.part, self.sheet, self.row = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), [], None, None, None

    def add(self, sheet: str, row: int, cell: str) -> None:
        if sheet != self.sheet:
            self._end_sheet()
            self.names.append(sheet)
            self.part = self.zip.open(f"xl/worksheets/sheet{len(self.names)}.xml", "w", force_zip64=True)
            self.part.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}"><sheetData>'.encode())
            self.sheet, self.row = sheet, None
        if row != self.row:
            self.part.write(f'{"</row>" if self.row is not None else ""}<row r="{row}">'.encode())
            self.row = row
        self.part.write(cell.encode())

    def _end_sheet(self) -> None:
        if self.part is not None:
            self.part.write(b"</row></sheetData></worksheet>")
            self.part.close()

    def close(self) -> None:
        self._end_sheet()
        one = range(1, len(self.names) + 1)
        sheets = "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="rId{k}"/>' for k, n in zip(one, self.names, strict=True))
        rels = "".join(f'<Relationship Id="rId{k}" Type="{REL}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in one)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.'
                        'spreadsheetml.worksheet+xml"/>' for k in one)
        for name, body in (
                ("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>{sheets}</sheets></workbook>'),
                ("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}/relationships">{rels}</Relationships>'),
                ("_rels/.rels", f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{REL}/officeDocument" '
                                'Target="xl/workbook.xml"/></Relationships>'),
                ("[Content_Types].xml", f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.'
                                        'openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType='
                                        f'"application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')):
            self.zip.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + body)
        self.zip.close()


def write_workbooks(cells: DataFrame, folder: str) -> DataFrame:
    """Writes each workbook of ``cells`` as ``folder/<name>.xlsx`` (its name percent-encoded) and returns (workbook,
    path).  Rows are dealt by workbook, sorted, and streamed into the file, so a task holds one batch of them, however
    large the workbook; a file is one task's work.  It is written beside and moved into place when it is whole, so a
    lost task leaves nothing that looks finished.  Characters that XML cannot hold become U+FFFD; cached values, numbers,
    texts and formulas are kept, styles are not."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_path(folder)
        fs.create_dir(f"{base}/_unfinished", recursive=True)
        book, name, done = None, None, []

        def finish() -> None:
            book.close()
            out.close()
            fs.move(temporary, f"{base}/{quote(name, safe='')}.xlsx")
            done.append((name, f"{folder}/{quote(name, safe='')}.xlsx"))

        for batch in batches:
            for workbook, sheet, row, ref, value, num, formula in zip(*(batch[c].to_pylist() for c in (
                    "workbook", "sheet", "row", "ref", "value", "num", "formula")), strict=True):
                if book is None or workbook != name:
                    if book is not None:
                        finish()
                    name, temporary = workbook, f"{base}/_unfinished/{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temporary, compression=None)
                    book = _Book(out)
                book.add(sheet, row, _cell(ref, value, num, formula))
        if book is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([p for _, p in done], pa.string())],
                                         ["workbook", "path"])

    rows = cells.select("workbook", "sheet_idx", "sheet", "row", "col", "ref", "value", "num", "formula")
    dealt = rows.repartition("workbook").sortWithinPartitions("workbook", "sheet_idx", "sheet", "row", "col")
    return write_table(dealt.mapInArrow(write, "workbook string, path string"), "workbooks")
