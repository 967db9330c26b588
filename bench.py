"""Benchmark: headline gridlake work on the driver tables; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Every step runs its whole plan (a write, or Spark's ``noop`` sink) and is timed on the wall
analyse 244 sheets < 3 s, build index < 7 s, indexed query < 0.3 s, 1000-row window < 0.5 s.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
import zipfile
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from gridlake.operators import index as ix  # noqa: E402
from gridlake.operators import profile as pf  # noqa: E402
from gridlake.operators import search as sr  # noqa: E402
from gridlake.operators.window import read_window  # noqa: E402
from gridlake.plans.catalog import QUERIES  # noqa: E402
from gridlake.plans.grid import big_grid_cells, load  # noqa: E402
from gridlake.plans.workbooks import analyse_files  # noqa: E402
from gridlake.session import local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
CATALOG = ["range_batch", "rect_batch", "batch_text_search", "hot_keys", "key_sessions", "sheet_similarity",
           "snapshot_diff", "delta_apply", "outliers", "cyclic_core", "formula_links", "postings"]


def run(df):
    df.write.format("noop").mode("overwrite").save()


def xlsx_from_table(spark, sf_dir: str, path: Path, n_sheets: int = 244) -> Path:
    """A 244-sheet workbook cut from lineitem (bench fixture; written once per scale and reused): shared strings,
    a date style and a shared formula per sheet.  Rows are streamed from Spark straight into the zip."""
    if path.exists():
        return path
    heads = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "day", "total"]
    li = load(spark, sf_dir, "lineitem")
    n = li.count()
    rows = (li.select(*heads[:7], F.datediff(F.to_date("l_shipdate"), F.lit("1899-12-30").cast("date")).alias("day"))
            .orderBy("l_orderkey", "l_linenumber", "l_partkey").toLocalIterator(prefetchPartitions=True))
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    strings: dict[str, int] = {}
    tmp = path.with_suffix(".tmp")
    with zipfile.ZipFile(tmp, "w", zipfile.ZIP_DEFLATED) as z:
        for s in range(n_sheets):
            size = n * (s + 1) // n_sheets - n * s // n_sheets
            out = [f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{main}"><sheetData><row r="1">']
            out += [f'<c r="{chr(65 + j)}1" t="s"><v>{strings.setdefault(h, len(strings))}</v></c>' for j, h in enumerate(heads)]
            out.append("</row>")
            for r in range(2, size + 2):
                cells = []
                for j, v in enumerate(next(rows)):
                    if isinstance(v, str):
                        cells.append(f'<c r="{chr(65 + j)}{r}" t="s"><v>{strings.setdefault(v, len(strings))}</v></c>')
                    elif v is not None:
                        cells.append(f'<c r="{chr(65 + j)}{r}"{' s="1"' if heads[j] == "day" else ""}><v>{v}</v></c>')
                f = f' ref="I2:I{size + 1}"' if r == 2 else ""
                cells.append(f'<c r="I{r}"><f t="shared"{f} si="0">{"D2*E2" if r == 2 else ""}</f><v>1</v></c>')
                out.append(f'<row r="{r}">' + "".join(cells) + "</row>")
            out.append("</sheetData></worksheet>")
            z.writestr(f"xl/worksheets/sheet{s + 1}.xml", "".join(out))
        sheets = "".join(f'<sheet name="Orders {s}" sheetId="{s + 1}" r:id="rId{s + 1}"/>' for s in range(n_sheets))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{sheets}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{s + 1}" Type="{rel}/worksheet" Target="worksheets/sheet{s + 1}.xml"/>'
                       for s in range(n_sheets))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{package}/relationships">{rels}</Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<?xml version="1.0"?><sst xmlns="{main}">'
                   + "".join(f"<si><t>{t}</t></si>" for t in strings) + "</sst>")
        z.writestr("xl/styles.xml", f'<?xml version="1.0"?><styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{package}/content-types"/>')
    tmp.rename(path)
    return path


def main():
    spark = local_session(CPUS, max(8, CPUS * 2), app="gridlake-bench")
    work = Path(tempfile.mkdtemp(prefix="gridlake-bench-"))
    times, extra = {}, {}

    def timed(name, fn):
        t0 = time.time()
        out = fn()
        times[name] = round(time.time() - t0, 3)
        return out

    # untimed warm-up: JVM start-up and code generation are not part of any step
    run(spark.range(2_000_000).selectExpr("id % 97 AS k").groupBy("k").count())
    cells_path = str(work / "cells")
    timed("grid_build", lambda: big_grid_cells(spark, SF_DIR).write.parquet(cells_path))
    cells = spark.read.parquet(cells_path)
    n_cells = cells.count()
    extra["cells"] = n_cells

    def analyse():
        run(pf.sheet_profile(cells))  # includes the value-type counts
        run(pf.hot_zones(cells))
        run(pf.sheet_chunks(cells, 2))
        run(pf.key_points(cells))
        run(pf.column_stats(cells))
    timed("analyse", analyse)

    idx = str(work / "index")
    timed("build_index", lambda: ix.write_index(cells, idx, files_per_table=CPUS * 2))
    t = ix.read_index(spark, idx)
    timed("query_index", lambda: sr.fetch_cells(t["cells"], sr.top_hits(sr.search_text(t["postings"], "cold widget"), 100)).collect())
    timed("query_numeric", lambda: sr.search_numeric(t["cells"], 1000, 1010).collect())
    timed("window_1000", lambda: read_window(t["cells"], 100_000, 100_999, 0, 20, sheet="lineitem").collect())

    def warm(fn, n=3):
        best = None
        for _ in range(n):
            t0 = time.time()
            fn()
            best = min(best or 1e9, time.time() - t0)
        return round(best, 3)
    # steady-state latencies (best of 3, not part of the total): the reference's per-call targets
    extra["query_index_warm_sec"] = warm(lambda: sr.fetch_cells(
        t["cells"], sr.top_hits(sr.search_text(t["postings"], "cold widget"), 100)).collect())
    extra["window_1000_warm_sec"] = warm(lambda: read_window(t["cells"], 100_000, 100_999, 0, 20, sheet="lineitem").collect())

    book_dir = Path(tempfile.gettempdir()) / f"gridlake-bench-book2-{Path(SF_DIR).name}"
    book_dir.mkdir(exist_ok=True)
    book = xlsx_from_table(spark, SF_DIR, book_dir / "orders244.xlsx")
    extra["workbook_mb"] = round(book.stat().st_size / 1e6, 1)

    def analyse_workbook():
        found = analyse_files(spark, str(book_dir))
        for part in ("metadata", "chunks", "patterns", "groups", "formulas", "value_types", "tokens", "errors"):
            found[part].collect()
        return found["cells"]
    book_cells = timed("workbook_244_analyse", analyse_workbook)
    extra["workbook_cells"] = book_cells.count()
    timed("workbook_244_index", lambda: ix.write_index(book_cells, str(work / "book_index"), files_per_table=CPUS * 2))

    for name in CATALOG:
        timed(name, lambda n=name: run(QUERIES[n](spark, SF_DIR)))

    total = round(sum(times.values()), 3)
    extra["cells_per_sec_grid"] = round(n_cells / max(times["grid_build"], 1e-9))
    extra["cells_per_sec_workbook"] = round(extra["workbook_cells"] / max(times["workbook_244_analyse"], 1e-9))
    print(json.dumps({"metric": "total_wall_time", "value": total, "unit": "sec", "queries": times,
                      "sf": Path(SF_DIR).name.replace("sf", ""), "cpus": CPUS, **extra}))


if __name__ == "__main__":
    main()
