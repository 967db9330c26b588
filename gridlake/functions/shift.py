"""Moving a formula's relative references, as a spreadsheet does when a formula is filled down or across."""

from __future__ import annotations

import re

MAX_COL, MAX_ROW = 16_384, 1_048_576

_TOKEN = re.compile(
    r'"(?:[^"]|"")*"'  # a text
    r"|'(?:[^']|'')*'(?=!)"  # a quoted sheet name
    r"|(?<![\w.$!\]])[\w.]+(?=!)"  # a sheet name
    r"|\[[^\]]*\]"  # a workbook or a table column
    r"|(?<![\w.$])(?P<c1>\$?[A-Za-z]{1,3}):(?P<c2>\$?[A-Za-z]{1,3})(?![\w.(])"
    r"|(?<![\w.$])(?P<r1>\$?[0-9]+):(?P<r2>\$?[0-9]+)(?![\w.])"
    r"|(?<![\w.$])(?P<dc>\$?)(?P<col>[A-Za-z]{1,3})(?P<dr>\$?)(?P<row>[0-9]{1,7})(?![\w.(])")


def _number(letters: str) -> int:
    n = 0
    for ch in letters.upper():
        n = n * 26 + ord(ch) - 64
    return n


def _letters(n: int) -> str:
    s = ""
    while n:
        n, r = divmod(n - 1, 26)
        s = chr(65 + r) + s
    return s


def _col(text: str, by: int) -> str | None:
    if text.startswith("$"):
        return text
    n = _number(text) + by
    return _letters(n) if 1 <= n <= MAX_COL else None


def _row(text: str, by: int) -> str | None:
    if text.startswith("$"):
        return text
    n = int(text) + by
    return str(n) if 1 <= n <= MAX_ROW else None


def shift_formula(formula: str, rows: int, cols: int) -> str:
    """``formula`` with its relative references moved by ``rows`` and ``cols``; texts, sheet names, function
    names and ``$`` parts stay, a reference that leaves the sheet becomes ``#REF!``."""
    if not rows and not cols:
        return formula

    def move(m: re.Match) -> str:
        if m["col"]:
            c, r = _col(m["dc"] + m["col"], cols), _row(m["dr"] + m["row"], rows)
            return "#REF!" if c is None or r is None else c + r
        if m["c1"]:
            a, b = _col(m["c1"], cols), _col(m["c2"], cols)
            return "#REF!" if a is None or b is None else f"{a}:{b}"
        if m["r1"]:
            a, b = _row(m["r1"], rows), _row(m["r2"], rows)
            return "#REF!" if a is None or b is None else f"{a}:{b}"
        return m[0]

    return _TOKEN.sub(move, formula)
