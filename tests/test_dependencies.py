"""Spatial index, references as blocks, cycles, impact, formats and sketches: against brute force on small inputs."""

import random
import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridlake.operators import cycles, links
from gridlake.operators import dependencies as dp
from gridlake.operators import index as ix
from gridlake.operators import profile as pf
from gridlake.operators import search as sr
from gridlake.operators import sequence as sq
from gridlake.operators import spatial as sp
from gridlake.session import write_table
from gridlake.sources.tables import number_rows, with_cell_fields

CELL = "workbook string, sheet string, sheet_idx int, row long, col int, value string, formula string"


def rows_read(df):
    """Rows that the scan of a plan without exchanges gave to its filter: those of the row groups and pages it read."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


# ---------------------------------------------------------------- spatial index


def test_key_ranges_hold_the_rectangle():
    rnd = random.Random(1)
    for _ in range(40):
        r, c = sorted(rnd.sample(range(1 << sp.BITS), 2)), sorted(rnd.sample(range(1 << sp.BITS), 2))
        for most in (4, 64):
            ranges = sp.key_ranges(tuple(r), tuple(c), most)
            assert len(ranges) <= most and all(a <= b for a, b in ranges) and all(x[1] + 1 < y[0] for x, y in zip(ranges, ranges[1:]))
            for _ in range(30):
                key = sp._interleave(rnd.randint(*r), rnd.randint(*c))
                assert any(a <= key <= b for a, b in ranges)
    assert sp.key_ranges((0, -1), (0, 5), 8) == [] and sp.key_ranges((0, (1 << sp.BITS) - 1), (0, (1 << sp.BITS) - 1), 4) == [(0, (1 << 40) - 1)]


def test_stored_rectangles_equal_the_filter_and_read_little(spark, tmp_path):
    side = 700
    base = spark.range(side * side).select(
        F.lit("w").alias("workbook"), F.lit("big").alias("sheet"), F.lit(0).alias("sheet_idx"), (F.floor(F.col("id") / side) + 1).alias("row"),
        (F.col("id") % side + 1).cast("int").alias("col"), F.sha2(F.col("id").cast("string"), 256).alias("value"))
    odd = [("w", "one", 1, 1, 1, "x"), ("w", "far", 2, 3_000_000_000, 9, "y"), (None, "big", 3, 5, 5, "z"), ("w", "wide", 4, 2, 16_384, "v")]
    cells = base.unionByName(spark.createDataFrame(odd, "workbook string, sheet string, sheet_idx int, row long, col int, value string"))
    path = str(tmp_path / "s")
    sp.write_spatial(cells, path, files=4, row_group_bytes=60_000)
    groups = sum(pq.ParquetFile(f).num_row_groups for f in (tmp_path / "s" / "spatial").glob("*.parquet"))
    assert groups > 100
    rnd = random.Random(2)
    rects = [(300, 0, 1, 1 << 40), (0, 300, 1 << 20, 1), (4, 4, 1, 1), (16_383, 0, 1, 9), (5, 5, 0, 9), (-4, -4, 6, 6), (8, 2_999_999_999, 1, 1)]
    rects += [(rnd.randint(0, 800), rnd.randint(0, 800), rnd.randint(1, 300), rnd.randint(1, 300)) for _ in range(4)]
    for x, y, w, h in rects:
        got = sp.search_rect_stored(spark, path, x, y, w, h)
        want = sr.search_rect(cells, x, y, w, h)
        assert sorted(got.select(*cells.columns).collect(), key=str) == sorted(want.collect(), key=str)
    total = side * side
    assert rows_read(sp.search_rect_stored(spark, path, 300, 0, 1, 1 << 40, sheet="big")) < total / 10  # tall and narrow
    assert rows_read(sp.search_rect_stored(spark, path, 0, 300, 1 << 20, 1, sheet="big")) < total / 10  # wide and flat
    assert [r["sheet"] for r in sp.search_rect_stored(spark, path, 0, 0, 1, 1, sheet="one").collect()] == ["one"]
    empty = str(tmp_path / "e")
    sp.write_spatial(cells.limit(0), empty)
    assert sp.search_rect_stored(spark, empty, 0, 0, 9, 9).collect() == []


def test_write_index_has_a_spatial_table(spark, tmp_path):
    rows = [("wb", "S", 0, r, c, f"v{r * c}") for r in range(1, 40) for c in range(1, 9)]
    cells = with_cell_fields(spark.createDataFrame(rows, "workbook string, sheet string, sheet_idx int, row long, col int, value string"))
    ix.write_index(cells, str(tmp_path / "idx"), files_per_table=2)
    t = ix.read_index(spark, str(tmp_path / "idx"))
    assert t["spatial"].count() == len(rows) and t["shapes"].first()["row_bits"] == 6
    assert sp.search_rect_stored(spark, str(tmp_path / "idx"), 2, 3, 2, 5).count() == 10


# ---------------------------------------------------------------- references and readers


def test_side_blocks_cut_every_interval_once(spark):
    rnd = random.Random(3)
    spans = [(a, a + n) for a in (0, 1, 2, 7, 8, 100) for n in (0, 1, 2, 5, 8, 31)] + [(0, (1 << 40) - 1), (5, (1 << 40) - 1)]
    spans += [(a, a + rnd.randint(0, 10**6)) for a in [rnd.randint(0, 10**6) for _ in range(20)]]
    df = spark.createDataFrame(spans, "a long, b long")
    for r in df.select("a", "b", dp.side_blocks(F.col("a"), F.col("b")).alias("s")).collect():
        found = sorted((x["block"] << x["level"], (x["block"] + 1 << x["level"]) - 1) for x in r["s"])
        assert found[0][0] == r["a"] and found[-1][1] == r["b"] and all(x[1] + 1 == y[0] for x, y in zip(found, found[1:]))
        assert len(found) <= 2 * (r["b"] - r["a"] + 1).bit_length()


REF = re.compile(r"(?:(\w+)!)?\$?([A-Z]+)\$?(\d+)?(?::\$?([A-Z]+)\$?(\d+)?)?")


def number(letters):
    n = 0
    for ch in letters:
        n = n * 26 + ord(ch) - 64
    return n


def brute_reads(cells):
    """{(sheet, row, col) of a cell: formulas that read it}, for references that stand between + signs."""
    out = defaultdict(set)
    for sheet, row, col, formula in cells:
        for part in (formula or "").split("+"):
            if (m := REF.fullmatch(part.strip("()"))) and (m[3] or m[4]):
                c1, c2 = sorted((number(m[2]), number(m[4] or m[2])))
                r1, r2 = sorted((int(m[3] or 1), int(m[5] or m[3] or 1 << 40)))
                for s, r, c, _ in cells:
                    if s == (m[1] or sheet) and r1 <= r <= r2 and c1 <= c <= c2:
                        out[s, r, c].add((sheet, row, col))
    return out


def random_sheets(rnd, n=160):
    cells = {}
    name = lambda: "ABCDEF"[rnd.randrange(6)]
    for _ in range(n):
        parts = []
        for _ in range(rnd.choice([0, 0, 1, 1, 2])):
            sheet = rnd.choice(["", "", "S!", "T!"])
            r = rnd.randint(1, 40)
            parts.append(sheet + rnd.choice([f"{name()}{r}", f"{name()}${r}:${name()}{rnd.randint(1, 40)}", f"{name()}{r}:{name()}{r + rnd.randint(0, 3)}",
                                             *([f"{name()}:{name()}"] if rnd.random() < 0.1 else [])]))
        cells[rnd.choice("ST"), rnd.randint(1, 40), rnd.randint(1, 6)] = "+".join(parts) or None
    return [(s, r, c, f) for (s, r, c), f in cells.items()]


def frame(spark, cells):
    return with_cell_fields(spark.createDataFrame([("w", s, "ST".find(s), r, c, "1", f) for s, r, c, f in cells], CELL))


def test_readers_match_brute_force(spark):
    for seed in (1, 2):
        cells = random_sheets(random.Random(seed))
        df = frame(spark, cells)
        blocks = dp.reference_blocks(links.formula_links(dp.formula_cells(df)))
        got = {((r["sheet"], r["row"], r["col"]), (r["formula_sheet"], r["formula_row"], r["formula_col"])) for r in dp.readers(df, blocks).collect()}
        assert got == {(c, f) for c, fs in brute_reads(cells).items() for f in fs}
    none = frame(spark, [("S", 1, 1, None)])
    assert dp.readers(none, dp.reference_blocks(links.formula_links(dp.formula_cells(none)))).collect() == []


def reachable(edges):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    closure = {}
    for start in list(out):
        seen, todo = set(), [start]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        closure[start] = seen
    return closure


def brute_components(edges):
    reach = reachable(edges)
    return {a: min(b for b in reach[a] if a in reach.get(b, ())) for a in reach if a in reach[a]}


@pytest.mark.parametrize("local", [None, 0])
def test_formula_cycles_match_brute_force(spark, local):
    for seed, n in ((3, 90), (4, 60)) if local is None else ((3, 70),):
        cells = random_sheets(random.Random(seed), n)
        edges = [(f, c) for c, fs in brute_reads(cells).items() for f in fs]
        formulas = {(s, r, c) for s, r, c, f in cells if f}
        want = brute_components([(a, b) for a, b in edges if b in formulas])
        got = {(r["sheet"], r["row"], r["col"]): (r["cycle_sheet"], r["cycle_row"], r["cycle_col"])
               for r in dp.formula_cycles(frame(spark, cells), local).collect()}
        assert got == want and (want or seed == 4)
    assert dp.formula_cycles(frame(spark, [("S", 1, 1, "B1"), ("S", 1, 2, None)])).collect() == []
    own = dp.formula_cycles(frame(spark, [("S", 3, 1, "A1:A9"), ("S", 4, 2, "B4"), ("S", 5, 3, "C6")])).collect()
    assert sorted((r["row"], r["cycle_row"]) for r in own) == [(3, 3), (4, 4)]


def test_a_growing_range_costs_logarithmic_edges(spark):
    n = 2000
    cells = frame(spark, [("S", r, 1, f"A$1:A{r - 1}" if r > 1 else None) for r in range(1, n + 1)])
    formulas = dp.formula_cells(cells)
    blocks = dp.reference_blocks(links.formula_links(formulas))
    assert dp.dependency_edges(formulas, blocks).count() < 2 * 12 * n
    assert dp.formula_cycles(cells).count() == 0


# ---------------------------------------------------------------- components


@pytest.mark.parametrize("local", [0, 10_000])
def test_components_match_brute_force(spark, local):
    rnd = random.Random(5)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(75)] + [(100 + k, 100 + (k + 1) % 30) for k in range(30)]
    edges += [(130 + k, 131 + k) for k in range(30)] + [(129, 130), (200, 200), (201, 200), (3, 100)]
    df = spark.createDataFrame([*edges, *edges[:5], (None, 7), (7, None)], "src long, dst long")
    got = {r["node"]: r["component"] for r in cycles.strongly_connected(df, max_local_edges=local, trim_rounds=2).collect()}
    assert got == brute_components(edges)
    assert cycles.strongly_connected(df.limit(0)).collect() == []


def test_a_long_ladder_takes_few_rounds(spark, monkeypatch):
    """Two rails of 10,000 nodes with a rung at each: no cycle; with one edge back from the end all are one."""
    k = 10_000
    written = []
    keep = cycles.write_table
    monkeypatch.setattr(cycles, "write_table", lambda df, name: written.append(name) or keep(df, name))
    i = spark.range(k - 1).select(F.col("id"))
    rails = i.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).unionByName(
        i.select((F.col("id") + k).alias("src"), (F.col("id") + k + 1).alias("dst"))).unionByName(
        spark.range(k).select(F.col("id").alias("src"), (F.col("id") + k).alias("dst"))).unionByName(
        i.select((F.col("id") + k).alias("src"), (F.col("id") + 1).alias("dst")))
    assert cycles.strongly_connected(rails).count() == 0
    assert len(written) < 20
    back = rails.unionByName(spark.createDataFrame([(2 * k - 1, 0)], "src long, dst long"))
    found = cycles.strongly_connected(back)
    assert found.count() == 2 * k and [r[0] for r in found.select("component").distinct().collect()] == [0]


# ---------------------------------------------------------------- impact and context


def test_downstream_matches_brute_force(spark):
    cells = random_sheets(random.Random(7), 120)
    reads = brute_reads(cells)
    changed = [c[:3] for c in cells[:4]] + [("S", 99, 99)]
    depth, frontier = {c: 0 for c in changed}, list(changed)
    while frontier:
        found = {f for c in frontier for f in reads.get(c, ()) if f not in depth}
        depth |= {f: max(depth.values()) + 1 for f in found}
        frontier = list(found)
    at = spark.createDataFrame([("w", *c) for c in changed], "workbook string, sheet string, row long, col int")
    got = {(r["sheet"], r["row"], r["col"]): r["depth"] for r in dp.downstream(frame(spark, cells), at).collect()}
    assert got == depth
    short = dp.downstream(frame(spark, cells), at, max_depth=1)
    assert {(r["sheet"], r["row"], r["col"]) for r in short.collect()} == {c for c, n in depth.items() if n <= 1}
    plan = {r["sheet"]: (r["affected"], r["action"]) for r in dp.rebuild_plan(short, 3).collect()}
    per = Counter(c[0] for c, n in depth.items() if n <= 1)
    assert plan == {s: (n, "rebuild" if n > 3 else "incremental") for s, n in per.items()}


def test_hit_parts(spark):
    cells = [("S", 1, 1, None), ("S", 1, 2, None), ("S", 4, 1, None), ("S", 4, 2, "A4*2"), ("T", 9, 3, "SUM(S!A2:B9)"), ("T", 1, 1, "B1")]
    df = frame(spark, cells)
    hits = df.filter("sheet = 'S' and row = 4")
    got = sorted((r["col"], r["part"], r["part_sheet"], r["part_row"], r["part_col"], r["text"]) for r in dp.hit_parts(hits, df).collect())
    assert got == sorted([
        (1, "heading", "S", 1, 1, "1"), (1, "nearby", "S", 4, 2, "1"), (1, "reads", "S", 4, 2, "A4*2"), (1, "reads", "T", 9, 3, "SUM(S!A2:B9)"),
        (2, "heading", "S", 1, 2, "1"), (2, "nearby", "S", 4, 1, "1"), (2, "own", "S", 4, 2, "A4*2"), (2, "reads", "T", 9, 3, "SUM(S!A2:B9)")])


# ---------------------------------------------------------------- formats, sketches, ranges, rectangles, numbering


def test_column_masks(spark):
    values = ["2024-01-05", "2023-11-30", "2024-1-5", "AB-12", "Ünïx", "日本 7", "x", None, ""]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    masks = lambda i: [r[0] for r in df.select(pf.value_mask("value", i)).collect()]
    assert masks(0)[:7] == ["9999-99-99", "9999-99-99", "9999-9-9", "AA-99", "Aaaa", "aa 9", "a"]
    assert masks(1)[:6] == ["9+-9+-9+"] * 3 + ["A+-9+", "A+a+", "a+ 9+"] and masks(2)[4] == "L+" and masks(3)[3] == "X+-X+"
    cells = spark.createDataFrame([("w", "s", 1, v) for v in values[:3] * 4] + [("w", "s", 2, f"{'z' * k}{k}") for k in range(1, 30)],
                                  "workbook string, sheet string, col int, value string")
    got = {(r["col"], r["level"], r["mask"], r["n"]) for r in pf.column_masks(cells, 2).collect()}
    assert got == {(1, 0, "9999-99-99", 8), (1, 0, "9999-9-9", 4), (2, 1, "a+9+", 29)}


def test_sketches_merge_without_the_cells(spark):
    rnd = random.Random(9)
    xs = [rnd.gauss(1e9, 3) for _ in range(20_000)]
    cells = spark.createDataFrame([("w", "s", k % 2, x) for k, x in enumerate(xs)], "workbook string, sheet string, col int, num double")
    parts = [pf.column_sketches(cells.filter(F.pmod(F.hash("num"), F.lit(4)) == k)) for k in range(4)]
    got = {r["col"]: r for r in pf.sketch_stats(pf.merge_sketches(pf.merge_sketches(*parts[:2]), parts[2], parts[3])).collect()}
    for c in (0, 1):
        own = sorted(xs[c::2])
        mean = sum(own) / len(own)
        sd = (sum((x - mean) ** 2 for x in own) / (len(own) - 1)) ** 0.5
        r = got[c]
        assert (r["n"], r["lo"], r["hi"]) == (len(own), own[0], own[-1])
        assert abs(r["mean"] - mean) < 1e-4 and abs(r["sd"] - sd) < 1e-4
        assert abs(r["approx_distinct"] - len(own)) < 0.05 * len(own)
        for share, q in zip((0.25, 0.5, 0.75), r["quantiles"], strict=True):
            assert abs(sum(x <= q for x in own) / len(own) - share) < 0.03


def test_range_count_is_exact_above_two_to_the_53(spark):
    big = 1 << 53
    ranges = spark.createDataFrame([(k, big + k, big + k + 1) for k in range(1, 4)], "q int, lo long, hi long")
    values = spark.createDataFrame([(big + k,) for k in (1, 2, 3)], "x long")
    assert {r["q"]: r["n"] for r in sr.range_count(ranges, values, ["q"], "lo", "hi", "x").collect()} == {1: 1, 2: 1, 3: 1}
    got = sr.range_count(ranges, values, ["q"], "lo", "hi", "x", lo_inclusive=False, hi_inclusive=True).collect()
    assert {r["q"]: r["n"] for r in got} == {1: 1, 2: 1}


def test_rects_join_matches_brute_force(spark):
    rnd = random.Random(11)
    rects = [(k, rnd.choice(["a", "b", None]), rnd.randint(-20, 60), rnd.randint(0, 40), rnd.randint(0, 9), rnd.randint(1, 25)) for k in range(80)]
    df = spark.createDataFrame(rects, "k int, g string, x int, y int, w int, h int")
    got = sorted((r["k"], r["r_k"]) for r in sr.rects_join(df, df, ["g"], 5, 7).collect())
    over = lambda p, n, q, m: p < q + m and q < p + n
    want = sorted((a[0], b[0]) for a in rects for b in rects if a[1] == b[1] is not None and a[4] and b[4]
                  and over(a[2], a[4], b[2], b[4]) and over(a[3], a[5], b[3], b[5]))
    assert got == want


def test_number_rows_spreads_a_hot_first_key(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 7 != 0, F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    out = number_rows(df, ["k", "id"], partitions=10)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata.num_rows for f in out.inputFiles()]
    assert len(files) == 10 and max(files) < 2 * 6_000
    want = sorted(((r["k"], r["id"]) for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or "", x[1]))
    assert [(r["k"], r["id"]) for r in out.orderBy("row").collect()] == want
    assert [r["row"] for r in out.orderBy("row").select("row").collect()] == list(range(1, 60_001))


def test_joins_that_multiply_rows_are_not_broadcast(spark, tmp_path):
    """A small file whose rows multiply in a join goes through a shuffle, not whole through the driver (it was broadcast)."""
    spark.range(3000).select(F.lit("b").alias("workbook"), F.lit("s").alias("sheet"), (F.col("id") + 1).alias("row"), F.lit(1).alias("col"),
                             F.concat(F.lit("SUM(A"), F.col("id") + 2, F.lit(":A"), F.col("id") + 40, F.lit(")")).alias("formula")
                             ).write.parquet(str(tmp_path / "cells"))
    cells = spark.read.parquet(str(tmp_path / "cells"))
    blocks = write_table(dp.reference_blocks(links.formula_links(cells)), "references")
    found = dp.readers(cells, blocks)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan
    assert found.filter("row = 100").count() == 39
    few = dp.readers(sq.join_side(cells.filter("row = 100"), 1), blocks)
    assert "BroadcastExchange" in few._jdf.queryExecution().executedPlan().toString() and few.count() == 39


def test_outliers_do_not_shuffle_the_rows(spark):
    """One group of nearly all rows: the statistics go to the rows (all rows of a group were shuffled to one task)."""
    df = spark.range(5000).select(F.when(F.col("id") % 100 == 0, "b").when(F.col("id") % 500 != 7, "a").alias("g"),
                                  F.when(F.col("id") == 11, 1e6).otherwise(F.col("id") % 10).alias("v"))
    found = pf.outliers(df, ["g"], "v")
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r["v"] for r in found.collect()] == [1e6]


def test_rects_join_deals_meetings_over_tasks(spark, monkeypatch):
    """As many tasks as the meetings within tiles ask for, however few the rows (their bytes decided)."""
    monkeypatch.setattr(sr, "MEETINGS_PER_TASK", 1000)
    df = spark.range(600).select((F.col("id") % 2).alias("g"), F.col("id").alias("k"), (F.col("id") % 7).alias("x"),
                                 (F.col("id") % 5).alias("y"), F.lit(3).alias("w"), F.lit(3).alias("h"))
    pairs = sr.rects_join(df, df, ["g"], 3, 3)
    assert pairs.rdd.getNumPartitions() > 50
    rows = df.collect()
    assert pairs.count() == sum(a["g"] == b["g"] and abs(a["x"] - b["x"]) < 3 and abs(a["y"] - b["y"]) < 3 for a in rows for b in rows)
