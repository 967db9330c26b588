"""What formulas read, as aligned blocks of cells: edges through ranges, readers of a cell, downstream impact
(J7, J8, A18, A19, P12, T2).

A reference is a rectangle.  Each of its sides is cut into aligned blocks (of 2**level places that begin at a
multiple of 2**level), at most two per level, so a range of a million rows is some forty blocks, a whole column one and a
single cell the block of level 0.  A cell lies in exactly one block per level, hence in exactly one block of every
range that holds it: "which ranges hold this cell" is an equi join on the block, without a residual test and without
a row per cell of a range.

Cycles are looked for on a graph whose nodes are cells and blocks (formula -> block -> formula cells in it), so n
running totals over a growing range give about n * log(n) edges instead of n * n.

Rules: links to other workbooks are not followed; a range's ends may come in any order; a sheet name must match as
written; locations with a null workbook or sheet match each other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.operators.cycles import strongly_connected
from gridlake.operators.links import formula_links
from gridlake.operators.sequence import join_side, null_safe_join
from gridlake.schema import LOCATION
from gridlake.session import checkpoint_dir, write_table

#: Levels of the two sides: places below 2**40 (rows) and 2**15 (columns).
ROW_LEVELS, COL_LEVELS = 40, 15
BLOCK = ["workbook", "sheet", "row_level", "row_block", "col_level", "col_block"]


def _shift(by: str, x: Column, n: Column) -> Column:
    return F.call_function(by, x.cast("bigint"), n.cast("int"))


def side_blocks(first: Column, last: Column) -> Column:
    """The aligned blocks, array of struct(level, block), of the 0-based places ``first`` to ``last``, both included:
    at each level, what is left of the interval gives away an odd first and an odd last block."""
    end = last + 1
    levels = F.sequence(F.lit(0), F.length(F.bin(end - first)))

    def at(level: Column) -> Column:
        lo = _shift("shiftright", first + _shift("shiftleft", F.lit(1), level) - 1, level)
        hi = _shift("shiftright", end, level)
        left = F.when((lo < hi) & (lo % 2 == 1), F.struct(level.alias("level"), lo.alias("block")))
        right = F.when((lo < hi) & (hi % 2 == 1), F.struct(level.alias("level"), (hi - 1).alias("block")))
        return F.array(left, right)

    return F.filter(F.flatten(F.transform(levels, at)), lambda b: b.isNotNull())


def reference_blocks(links: DataFrame) -> DataFrame:
    """(workbook, sheet, row, col) of each formula and the blocks it reads: target_sheet, row_level, row_block,
    col_level, col_block; one row per block, each once per formula.  ``links``: of :func:`formula_links`."""
    own = links.filter(F.col("target_book").isNull() & F.col("target_col").isNotNull())
    r1, c1 = F.coalesce("target_row", F.lit(1)), F.col("target_col")
    r2 = F.when(F.col("target_row").isNull(), F.lit(1 << ROW_LEVELS)).otherwise(F.coalesce("target_end_row", r1))
    c2 = F.coalesce("target_end_col", c1)
    out = own.select(*LOCATION, "target_sheet", F.explode(side_blocks(F.least(r1, r2) - 1, F.greatest(r1, r2) - 1)).alias("_r"),
                     F.least(c1, c2).alias("_c1"), F.greatest(c1, c2).alias("_c2"))
    out = out.select("*", F.explode(side_blocks(F.col("_c1") - 1, F.col("_c2") - 1)).alias("_c"))
    return out.select(*LOCATION, "target_sheet", F.col("_r.level").alias("row_level"), F.col("_r.block").alias("row_block"),
                      F.col("_c.level").alias("col_level"), F.col("_c.block").alias("col_block")).distinct()


def formula_cells(cells: DataFrame) -> DataFrame:
    return cells.filter(F.col("formula").isNotNull() & (F.col("formula") != "")).select(*LOCATION, "formula")


def levels_in_use(blocks: DataFrame) -> list[tuple[int, int]]:
    """The distinct (row level, column level): at most 41 * 16, a few in practice."""
    return sorted((r[0], r[1]) for r in blocks.select("row_level", "col_level").distinct().collect())


def cell_blocks(cells: DataFrame, levels: list[tuple[int, int]]) -> DataFrame:
    """Every cell with the one block per pair of levels that it lies in: its columns, row_level ... col_block."""
    pairs = ", ".join(f"struct({a} as row_level, {b} as col_level)" for a, b in levels)
    out = cells.select("*", F.explode(F.expr(f"array({pairs})")).alias("_l")) if levels else cells.limit(0).withColumn(
        "_l", F.expr("struct(0 as row_level, 0 as col_level)"))
    return out.select(*cells.columns, "_l.row_level", _shift("shiftright", F.col("row") - 1, F.col("_l.row_level")).alias("row_block"),
                      "_l.col_level", _shift("shiftright", F.col("col") - 1, F.col("_l.col_level")).alias("col_block"))


def readers(cells: DataFrame, blocks: DataFrame, levels: list[tuple[int, int]] | None = None) -> DataFrame:
    """The formulas that read each cell: ``cells``' location as workbook, sheet, row, col and the formula's as
    formula_sheet, formula_row, formula_col; each pair once.  An equi join on the block, merged unless ``cells`` are
    marked for a broadcast.  ``blocks`` are read twice without ``levels``, so they should be a written table."""
    at = cell_blocks(cells.select(*LOCATION), levels_in_use(blocks) if levels is None else levels)
    reads = blocks.select("workbook", F.col("target_sheet").alias("_sheet"), *BLOCK[2:], F.col("sheet").alias("formula_sheet"),
                          F.col("row").alias("formula_row"), F.col("col").alias("formula_col")).withColumnRenamed("_sheet", "sheet")
    return null_safe_join(at, reads.hint("merge"), BLOCK).select(*LOCATION, "formula_sheet", "formula_row", "formula_col").distinct()


def _node(sheet: str, row_level, row_block, col_level, col_block) -> Column:
    return F.struct(F.col("workbook").alias("workbook"), F.col(sheet).alias("sheet"), row_level.cast("int").alias("row_level"),
                    row_block.cast("bigint").alias("row_block"), col_level.cast("int").alias("col_level"),
                    col_block.cast("bigint").alias("col_block"))


def dependency_edges(formulas: DataFrame, blocks: DataFrame) -> DataFrame:
    """A18's graph (src reads dst).  A node is a block; a cell is the block of level 0 at its place.  Formula cells
    point to the blocks they read, larger blocks to the formula cells in them."""
    zero = F.lit(0)
    cell = _node("sheet", zero, F.col("row") - 1, zero, F.col("col") - 1)
    read = _node("target_sheet", *[F.col(c) for c in BLOCK[2:]])
    larger = [x for x in levels_in_use(blocks) if x != (0, 0)]
    inside = cell_blocks(formulas.select(*LOCATION), larger)
    return (blocks.select(cell.alias("src"), read.alias("dst"))
            .unionByName(inside.select(_node("sheet", *[F.col(c) for c in BLOCK[2:]]).alias("src"), cell.alias("dst"))))


def formula_cycles(cells: DataFrame, max_local_edges: int | None = None) -> DataFrame:
    """Every formula cell that depends on itself, directly, through other cells or through ranges, with its
    cycle: workbook, sheet, row, col and cycle_sheet, cycle_row, cycle_col, the first cell of its strongly connected
    component.  Cells on paths between cycles are not in it."""
    formulas = write_table(formula_cells(cells), "formulas")
    blocks = write_table(reference_blocks(formula_links(formulas)), "references")
    edges = dependency_edges(formulas, blocks)
    found = strongly_connected(edges, **({} if max_local_edges is None else {"max_local_edges": max_local_edges}))
    on = found.filter((F.col("node.row_level") == 0) & (F.col("node.col_level") == 0)).select(
        "component", F.struct(F.col("node.workbook").alias("workbook"), F.col("node.sheet").alias("sheet"),
                              (F.col("node.row_block") + 1).alias("row"), (F.col("node.col_block") + 1).cast("int").alias("col")).alias("cell"))
    first = on.groupBy("component").agg(F.min("cell").alias("first")).withColumnRenamed("component", "_component")
    return (on.join(first.hint("merge"), F.col("component") == F.col("_component")).select(
        "cell.*", F.col("first.sheet").alias("cycle_sheet"), F.col("first.row").alias("cycle_row"), F.col("first.col").alias("cycle_col")))


def downstream(cells: DataFrame, changed: DataFrame, max_depth: int | None = None) -> DataFrame:
    """What a change reaches.  workbook, sheet, row, col, depth: the changed cells (0), the formulas that read
    them (1), the formulas that read those (2), and so on, each with its smallest depth.

    One written round per depth: only the last round's cells meet the references, so the work is the edges out of
    reached cells, once; a chain of formulas takes as many rounds as it is long, unless ``max_depth`` ends it.
    """
    spark = cells.sparkSession
    formulas = formula_cells(cells)
    blocks = write_table(reference_blocks(formula_links(formulas)), "references")
    levels = levels_in_use(blocks)
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/reached-{uuid.uuid4().hex[:12]}"
    seen = lambda: spark.read.option("basePath", path).parquet(f"{path}/depth=*")
    changed.select(*LOCATION).distinct().write.parquet(f"{path}/depth=0")
    depth, n_seen = 0, 0
    while max_depth is None or depth < max_depth:
        last = spark.read.parquet(f"{path}/depth={depth}")
        n_last = last.count()
        if not n_last:
            break
        n_seen += n_last
        last = join_side(last, n_last * len(levels))
        found = readers(last, blocks, levels).select("workbook", F.col("formula_sheet").alias("sheet"), F.col("formula_row").alias("row"),
                                                     F.col("formula_col").alias("col")).distinct()
        depth += 1
        null_safe_join(found, join_side(seen().select(*LOCATION), n_seen), LOCATION, "left_anti").write.parquet(f"{path}/depth={depth}")
    return seen().select(*LOCATION, F.col("depth").cast("int").alias("depth"))


def rebuild_plan(reached: DataFrame, threshold: int) -> DataFrame:
    """Per sheet the cells that a change reaches, its greatest depth, and whether the sheet is to be rebuilt
    (more than ``threshold`` cells) or updated."""
    return (reached.groupBy("workbook", "sheet").agg(F.count("*").alias("affected"), F.max("depth").alias("max_depth"))
            .withColumn("action", F.when(F.col("affected") > threshold, "rebuild").otherwise("incremental")))


def hit_formulas(hits: DataFrame, cells: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """The formulas of each hit: its own (relation ``own``) and those that read it (``reads``), one row each:
    the hit's location, relation, formula_sheet, formula_row, formula_col, formula.  ``blocks``: the stored
    references, else they are taken from the cells' formulas."""
    formulas = formula_cells(cells)
    blocks = write_table(reference_blocks(formula_links(formulas)), "references") if blocks is None else blocks
    levels = levels_in_use(blocks)
    at = write_table(hits.select(*LOCATION).distinct(), "hits")
    text = formulas.select("workbook", F.col("sheet").alias("formula_sheet"), F.col("row").alias("formula_row"),
                           F.col("col").alias("formula_col"), "formula")
    place = ["workbook", "formula_sheet", "formula_row", "formula_col"]
    own = at.select("*", F.lit("own").alias("relation"), F.col("sheet").alias("formula_sheet"), F.col("row").alias("formula_row"),
                    F.col("col").alias("formula_col"))
    read = readers(join_side(at, at.count() * len(levels)), blocks, levels).select(*LOCATION, F.lit("reads").alias("relation"), "formula_sheet", "formula_row", "formula_col")
    return null_safe_join(own.unionByName(read), text.hint("merge"), place)


def hit_parts(hits: DataFrame, cells: DataFrame, k: int = 1, blocks: DataFrame | None = None) -> DataFrame:
    """The whole context of each hit, one row per part: the hit's location, ``part`` (``heading``: row 1 of its
    column; ``nearby``: the cells of its row within ``k`` columns; ``own`` and ``reads``: formulas), the part's
    sheet, row and column and its text."""
    at = write_table(hits.select(*LOCATION).distinct(), "hits")
    few = join_side(at, at.count())
    text = cells.filter(F.col("value").isNotNull())
    heading = null_safe_join(few, text.filter(F.col("row") == 1).select("workbook", "sheet", "col", F.col("value").alias("text")),
                             ["workbook", "sheet", "col"])
    near = null_safe_join(few, text.select("workbook", "sheet", "row", F.col("col").alias("part_col"), F.col("value").alias("text")),
                          ["workbook", "sheet", "row"]).filter(F.abs(F.col("part_col") - F.col("col")).between(1, k))
    formulas = hit_formulas(at, cells, blocks)
    return (heading.select(*LOCATION, F.lit("heading").alias("part"), F.col("sheet").alias("part_sheet"), F.lit(1).cast("bigint").alias("part_row"),
                           F.col("col").alias("part_col"), "text")
            .unionByName(near.select(*LOCATION, F.lit("nearby").alias("part"), F.col("sheet").alias("part_sheet"),
                                     F.col("row").alias("part_row"), "part_col", "text"))
            .unionByName(formulas.select(*LOCATION, F.col("relation").alias("part"), F.col("formula_sheet").alias("part_sheet"),
                                         F.col("formula_row").alias("part_row"), F.col("formula_col").alias("part_col"),
                                         F.col("formula").alias("text"))))
