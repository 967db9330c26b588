"""A minimal .xlsx writer (stdlib zipfile) for hand-made test workbooks.

A sheet is ``(name, {(row, col): cell})`` with 1-based coordinates; a cell is a plain value
(str -> shared string, bool, int/float) or a dict with keys ``v`` (value text), ``t`` (cell
type), ``f`` (formula), ``s`` (style index), ``inline`` (inline string), ``rich`` (list of runs).
Style 1 is an ISO date format (numFmtId 14).
"""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _letters(n: int) -> str:
    s = ""
    while n:
        n, r = divmod(n - 1, 26)
        s = chr(65 + r) + s
    return s


def write_xlsx(path, sheets, use_row_refs: bool = True) -> str:
    strings: list[str] = []
    index: dict[str, int] = {}

    def sst(text):
        if text not in index:
            index[text] = len(strings)
            strings.append(text)
        return index[text]

    parts = {}
    for i, (name, cells) in enumerate(sheets, start=1):
        rows: dict[int, list] = {}
        for (r, c), cell in sorted(cells.items()):
            rows.setdefault(r, []).append((c, cell))
        out = [f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}" xmlns:r="{REL}"><sheetData>']
        for r in sorted(rows):
            out.append(f'<row r="{r}">' if use_row_refs else "<row>")
            for c, cell in rows[r]:
                ref = f"{_letters(c)}{r}"
                if isinstance(cell, dict):
                    attrs = f' r="{ref}"'
                    if "t" in cell:
                        attrs += f' t="{cell["t"]}"'
                    if "s" in cell:
                        attrs += f' s="{cell["s"]}"'
                    body = ""
                    if "f" in cell:
                        fa = "".join(f' {k}="{v}"' for k, v in cell.get("fattrs", {}).items())
                        body += f"<f{fa}>{escape(cell['f'])}</f>" if cell["f"] else f"<f{fa}/>"
                    if "inline" in cell:
                        attrs = attrs.replace(f' t="{cell.get("t")}"', "") + ' t="inlineStr"'
                        body += f"<is><t>{escape(cell['inline'])}</t></is>"
                    elif "rich" in cell:
                        attrs = attrs.replace(f' t="{cell.get("t")}"', "") + ' t="s"'
                        runs = "".join(f"<r><t>{escape(x)}</t></r>" for x in cell["rich"])
                        strings.append(("__rich__", runs))  # type: ignore[arg-type]
                        body += f"<v>{len(strings) - 1}</v>"
                    elif "v" in cell:
                        body += f"<v>{escape(str(cell['v']))}</v>"
                    out.append(f"<c{attrs}>{body}</c>")
                elif isinstance(cell, bool):
                    out.append(f'<c r="{ref}" t="b"><v>{int(cell)}</v></c>')
                elif isinstance(cell, (int, float)):
                    out.append(f'<c r="{ref}"><v>{cell}</v></c>')
                else:
                    out.append(f'<c r="{ref}" t="s"><v>{sst(str(cell))}</v></c>')
            out.append("</row>")
        out.append("</sheetData></worksheet>")
        parts[f"xl/worksheets/sheet{i}.xml"] = "".join(out)

    si = []
    for s in strings:
        if isinstance(s, tuple):
            si.append(f"<si>{s[1]}</si>")
        else:
            si.append(f"<si><t xml:space=\"preserve\">{escape(s)}</t></si>")
    parts["xl/sharedStrings.xml"] = (f'<?xml version="1.0" encoding="UTF-8"?><sst xmlns="{MAIN}" count="{len(si)}" '
                                     f'uniqueCount="{len(si)}">{"".join(si)}</sst>')
    parts["xl/styles.xml"] = (f'<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="{MAIN}"><cellXfs count="2">'
                              '<xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/></cellXfs></styleSheet>')
    sheet_xml = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>'
                        for i, (n, _) in enumerate(sheets, start=1))
    parts["xl/workbook.xml"] = (f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{MAIN}" xmlns:r="{REL}">'
                                f"<sheets>{sheet_xml}</sheets></workbook>")
    rels = "".join(f'<Relationship Id="rId{i}" Type="{REL}/worksheet" Target="worksheets/sheet{i}.xml"/>'
                   for i in range(1, len(sheets) + 1))
    parts["xl/_rels/workbook.xml.rels"] = ('<?xml version="1.0" encoding="UTF-8"?><Relationships '
                                           f'xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
    parts["[Content_Types].xml"] = ('<?xml version="1.0" encoding="UTF-8"?><Types '
                                    'xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>')
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return str(path)


def tiny():
    return [("Sheet1", {(1, 1): 1, (1, 3): {"f": "A1*2", "v": 2}, (3, 1): "hello"})]


def kinds():
    return [("Kinds", {
        (1, 1): "shared", (1, 2): {"inline": "inline text"}, (1, 3): {"rich": ["ri", "ch"]},
        (1, 4): True, (1, 5): {"t": "e", "v": "#DIV/0!"}, (1, 6): {"s": 1, "v": 45292},
        (1, 7): "", (1, 8): {"s": 1}, (2, 1): 2.5,
    })]


KPI_HEADING = ["Rayons", "Ventes_HT", "Marges", "Taux_Marge", "Demarque", "Frais", "Marge_Theorique"]


def kpi(values):
    cells = {(1, c + 1): h for c, h in enumerate(KPI_HEADING)}
    for r, v in enumerate(values, start=2):
        cells[(r, 1)] = f"Rayon {r - 1}"
        if v is not None:
            cells[(r, 2)] = v
    return [("KPI", cells)]


def many(n=120):
    names = []
    for i in range(n):
        names.append([f"2024_Store {i}", f"Total {i}", f"_x{i}", f" y{i}"][i % 4])
    return [(nm, {(1, 1): i}) for i, nm in enumerate(names)]


def formulas():
    cells = {(1, 1): {"f": "B1+1", "v": 1}, (1, 2): {"f": "A1*2", "v": 2},
             (2, 1): {"f": "IF(A1>0,1,2)", "v": 1}, (2, 2): {"f": "VLOOKUP(A1,Data!A1:B9,2,FALSE)", "v": 0},
             (3, 1): {"f": "Missing!C3+1", "v": 0}, (3, 2): {"f": "SUM(A1:A2)", "v": 3},
             (4, 1): {"f": "INDEX(A1:B2,1,1)", "v": 1}, (4, 2): {"f": "LOG10(100)+MATCH(1,A1:A2,0)", "v": 3},
             (5, 1): {"f": "'Data'!$B$2", "v": 5}, (5, 2): {"f": "A5+B4", "v": 7}}
    return [("Calc", cells), ("Data", {(1, 1): "k", (2, 2): 5})]


def dense(n=25):
    return [("Dense", {(r, c): r * 100 + c for r in range(1, n + 1) for c in range(1, n + 1) if r != c})]
