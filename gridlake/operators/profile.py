"""Sheet and workbook profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions.a1 import cell_ref, idiv
from gridlake.functions.values import NAMING_PATTERNS, name_prefix, naming_flags
from gridlake.operators.sequence import join_side, null_safe_join
from gridlake.session import write_table

# Fixed values of the reference's estimates.
BYTES_PER_CELL = 50
MEMORY_BASE = 1024 * 1024
MEMORY_PER_SHEET = 500 * 1024
STREAMING_BYTES = 10 * 1024 * 1024
COMPLEX_FUNCTIONS = ["IF", "VLOOKUP", "INDEX", "MATCH"]

SHEET = ["workbook", "sheet", "sheet_idx"]


def _nonempty() -> Column:
    return F.col("value").isNotNull() & (F.col("value") != "")


def row_lengths(cells: DataFrame) -> DataFrame:
    """Ragged row length (``max(col)``) of every row that has a cell."""
    return cells.groupBy(*SHEET, "row").agg(F.max("col").alias("len"))


def sheets(cells: DataFrame) -> DataFrame:
    """One row per sheet with its ordinal and id ``sheet_{i}``."""
    return (cells.select(*SHEET).distinct()
            .withColumn("sheet_id", F.concat(F.lit("sheet_"), F.col("sheet_idx").cast("string"))))


def sheet_profile(cells: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """A1 (+A8): rows, cols (max row length), non-empty cells, density, formulas, footprint,
    and the cell counts per kind and implied empty cells — one aggregation per sheet.
    ``sheets`` (workbook, sheet, sheet_idx) adds empty sheets with zero counts."""
    k = F.col("kind")
    out = (cells.groupBy(*SHEET)
            .agg(F.max("row").alias("n_rows"), F.max("col").cast("bigint").alias("n_cols"),
                 F.count_if(_nonempty()).alias("nonempty"),
                 F.bool_or(F.col("formula").isNotNull()).alias("has_formulas"),
                 F.count_if(k == "number").alias("n_number"), F.count_if(k == "text").alias("n_text"),
                 F.count_if(k == "formula").alias("n_formula"), F.count_if(k == "date").alias("n_date"))
            .withColumn("n_empty", (F.col("n_rows") * F.col("n_cols") - F.col("nonempty")).cast("bigint"))
            .withColumn("density", F.coalesce(F.try_divide(F.col("nonempty").cast("double"),
                                                           F.col("n_rows") * F.col("n_cols")), F.lit(0.0)))
            .withColumn("footprint", F.col("nonempty") * BYTES_PER_CELL)
            .withColumn("sheet_id", F.concat(F.lit("sheet_"), F.col("sheet_idx").cast("string"))))
    if sheets is None:
        return out
    zero = ["n_rows", "n_cols", "nonempty", "n_number", "n_text", "n_formula", "n_date", "n_empty", "footprint"]
    return (sheets.select(*SHEET).join(out.drop("sheet_id"), SHEET, "left").fillna(0, zero)
            .fillna(0.0, ["density"]).fillna(False, ["has_formulas"])
            .withColumn("sheet_id", F.concat(F.lit("sheet_"), F.col("sheet_idx").cast("string"))))


def memory_estimate(n_sheets) -> Column:
    """A4: 1 MiB + 500 KiB per sheet."""
    n = F.col(n_sheets) if isinstance(n_sheets, str) else n_sheets
    return F.lit(MEMORY_BASE) + n.cast("bigint") * MEMORY_PER_SHEET


def complexity_score(cells: DataFrame, sheets: DataFrame | None = None, sample_sheets: int = 5,
                     sample: int = 10) -> DataFrame:
    """A2 (+A4): per workbook ``least(10, 0.1·sheets + Σ over the first 5 sheets of
    (0.001·rows + 0.1·formulas in the top-left 10×10))`` and the memory estimate.
    ``sheets`` (workbook, sheet_idx, sheet) lists empty sheets too; default: sheets with cells."""
    per_sheet = (cells.groupBy(*SHEET)
                 .agg(F.max("row").alias("n_rows"),
                      F.count_if(F.col("formula").isNotNull() & (F.col("row") <= sample)
                                 & (F.col("col") <= sample)).alias("n_f")))
    if sheets is not None:
        per_sheet = sheets.select(*SHEET).join(per_sheet, SHEET, "left").fillna(0, ["n_rows", "n_f"])
    return (per_sheet.groupBy("workbook")
            .agg(F.count(F.lit(1)).alias("sheets_count"),
                 F.sum(F.when(F.col("sheet_idx") < sample_sheets,
                              F.col("n_rows") * 0.001 + F.col("n_f") * 0.1).otherwise(0.0)).alias("_s"))
            .select("workbook", "sheets_count",
                    F.least(F.lit(10.0), F.col("sheets_count") * 0.1 + F.col("_s")).alias("complexity_score"),
                    memory_estimate("sheets_count").alias("memory_estimate")))


def sheet_chunks(cells: DataFrame, chunk_size: int = 50, stream_mode: bool = True,
                 sheets: DataFrame | None = None) -> DataFrame:
    """A3 + W5: chunks of ``chunk_size`` consecutive sheets: id ``chunk_{first}_{last}``,
    size = Σ row lengths · 50 bytes (interior blanks count), streaming when > 10 MiB.
    ``sheets`` (workbook, sheet, sheet_idx — e.g. the workbook listing) makes empty sheets
    count, as in the reference: chunk bounds are then ``[k·size, min((k+1)·size, n) − 1]``."""
    lens = row_lengths(cells)
    per_sheet = lens.groupBy(*SHEET).agg(F.sum("len").alias("_cells"))
    if sheets is not None:
        per_sheet = sheets.select(*SHEET).join(per_sheet, SHEET, "left").fillna(0, ["_cells"])
    chunk = idiv("sheet_idx", chunk_size)
    out = (per_sheet.groupBy("workbook", chunk.alias("chunk"))
           .agg(F.min("sheet_idx").alias("first_sheet"), F.max("sheet_idx").alias("last_sheet"),
                (F.sum("_cells") * BYTES_PER_CELL).cast("bigint").alias("size_bytes")))
    if sheets is not None:
        n = sheets.groupBy("workbook").agg(F.count(F.lit(1)).alias("_n"))
        out = (out.join(n, "workbook")
               .withColumn("first_sheet", (F.col("chunk") * chunk_size).cast("int"))
               .withColumn("last_sheet", F.least(F.col("chunk") * chunk_size + chunk_size, F.col("_n")).cast("int") - 1)
               .drop("_n"))
    return (out.withColumn("chunk_id", F.concat_ws("_", F.lit("chunk"), F.col("first_sheet"), F.col("last_sheet")))
            .withColumn("streaming", F.lit(stream_mode) & (F.col("size_bytes") > STREAMING_BYTES)))


def naming_patterns(names: DataFrame, group: Sequence[str] = ("workbook",), name: str = "sheet") -> DataFrame:
    """A5 (+F10, U4): per group, whether any name has each pattern, and the sorted pattern set."""
    flags = naming_flags(name)
    agg = names.groupBy(*group).agg(*[F.bool_or(c).alias(k) for k, c in flags.items()])
    labels = F.array(*[F.when(F.col(k), F.lit(p)) for k, p in zip(flags, NAMING_PATTERNS)])
    return agg.withColumn("patterns", F.array_sort(F.filter(labels, lambda x: x.isNotNull())))


def structural_groups(names: DataFrame, group: Sequence[str] = ("workbook",), name: str = "sheet") -> DataFrame:
    """A6 (+F9): number of distinct name prefixes per group."""
    return names.groupBy(*group).agg(F.count_distinct(name_prefix(name)).alias("n_groups"))


def formula_complexity(cells: DataFrame, group: Sequence[str] = ("workbook",), sample_sheets: int | None = 3,
                       sample: int | None = 10) -> DataFrame:
    """A7 (+L8): 'none' without formulas; 'simple' when none uses IF/VLOOKUP/INDEX/MATCH
    (case-sensitive substring test, so COUNTIF counts); 'complex' when that share is > 0.3; else 'mixed'.
    Sampled on the first 3 sheets' top-left 10×10 as in the reference (None = everything)."""
    c = cells
    if sample_sheets is not None:
        c = c.filter(F.col("sheet_idx") < sample_sheets)
    if sample is not None:
        c = c.filter((F.col("row") <= sample) & (F.col("col") <= sample))
    f = F.col("formula")
    is_complex = F.exists(F.array(*[F.lit(x) for x in COMPLEX_FUNCTIONS]), lambda k: F.instr(f, k) > 0)
    agg = c.groupBy(*group).agg(F.count("formula").alias("n_formulas"),
                                F.count_if(F.col("formula").isNotNull() & is_complex).alias("n_complex"))
    share = F.col("n_complex") / F.col("n_formulas")
    return agg.withColumn("cls", F.when(F.col("n_formulas") == 0, "none")
                          .when(F.col("n_complex") == 0, "simple")
                          .when(share > 0.3, "complex").otherwise("mixed"))


def value_types(cells: DataFrame) -> DataFrame:
    """Counts per kind, and implied empty cells = rows·cols − non-empty, per sheet (the
    same single aggregation as :func:`sheet_profile`)."""
    return sheet_profile(cells).select(*SHEET, "n_number", "n_text", "n_formula", "n_date", "n_empty")


def hot_zones(cells: DataFrame, window: int = 10, threshold: float = 0.7, max_cols: int = 50,
              include_tail: bool = False) -> DataFrame:
    """``window``×``window`` tiles whose density is > ``threshold``.

    Reproduces the reference exactly (D14): tiles start at columns below ``max_cols``; the last
    full row window is not examined (``start_row < rows - window``) unless ``include_tail``;
    the denominator counts only cells inside ragged rows: Σ over the tile's rows of
    ``clamp(len - first_col, 0, window)``.  One aggregate per row carries its length and its
    non-empty count in each of the max_cols/window column tiles; rows then fold into bands
    of ``window`` rows, and only the bands (not the rows) are split into tiles.
    """
    n_tiles = -(-max_cols // window)
    c = F.col("col")
    per_row = cells.groupBy(*SHEET, "row").agg(
        F.max("col").alias("len"),
        *[F.count_if(_nonempty() & (c > t * window) & (c <= (t + 1) * window)).alias(f"_k{t}") for t in range(n_tiles)])
    clamp = lambda t: F.greatest(F.least(F.col("len") - t * window, F.lit(window)), F.lit(0))
    per_band = per_row.groupBy(*SHEET, idiv(F.col("row") - 1, window).alias("tr")).agg(
        *[F.sum(f"_k{t}").alias(f"_k{t}") for t in range(n_tiles)],
        *[F.sum(clamp(t)).alias(f"_t{t}") for t in range(n_tiles)])
    agg = per_band.select(*SHEET, "tr", F.inline(F.array(*[
        F.struct(F.lit(t).alias("tc"), F.col(f"_k{t}").alias("k"), F.col(f"_t{t}").alias("tot"))
        for t in range(n_tiles)]))).filter(F.col("k") > 0)
    out = agg.join(cells.groupBy(*SHEET).agg(F.max("row").alias("_n")), SHEET)
    if not include_tail:
        out = out.filter(F.col("tr") * window < F.col("_n") - window)
    out = out.withColumn("density", F.col("k") / F.col("tot")).filter(F.col("density") > threshold)
    first_row, first_col = F.col("tr") * window + 1, F.col("tc") * window + 1
    return out.select(*SHEET, first_row.alias("first_row"), first_col.cast("int").alias("first_col"), "density",
                      F.concat(cell_ref(first_col, first_row), F.lit(":"),
                               cell_ref(first_col + window - 1, first_row + window - 1)).alias("range"))


def column_stats(cells: DataFrame) -> DataFrame:
    """Per (sheet, col) count, min, max, mean, sample stddev and approximate distinct of numbers."""
    return (cells.filter(F.col("num").isNotNull()).groupBy(*SHEET, "col")
            .agg(F.count("num").alias("n"), F.min("num").alias("lo"), F.max("num").alias("hi"),
                 F.avg("num").alias("mean"), F.stddev_samp("num").alias("sd"),
                 F.approx_count_distinct("num").alias("approx_distinct")))


def outliers(df: DataFrame, group: Sequence[str], value: str, k: float = 3.0) -> DataFrame:
    """Rows whose value is more than ``k`` sample standard deviations from its group mean.

    Group statistics come from a partial aggregate, are written and joined back.  Statistics of few groups go whole to
    every task, so the rows are not shuffled at all; those of many are merged, both sides straight from an exchange,
    so that AQE splits a group that holds a large share of all rows.
    """
    stats = write_table(df.groupBy(*group).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_sd")), "statistics")
    return (df.join(join_side(stats, stats.count()), list(group)).filter(F.abs(F.col(value) - F.col("_m")) > k * F.col("_sd"))
            .drop("_m", "_sd"))


def sheet_zones(profile: DataFrame, zone_rows: int = 1000, compress_over: int = 500) -> DataFrame:
    """Zones of ``zone_rows`` rows per sheet with their A1 range (to the last column) and a
    ``compressed`` flag when the zone has more than 500 rows."""
    s = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_rows") - 1, F.lit(zone_rows).cast("bigint")))
    z = profile.filter(F.col("n_rows") > 0).select(*SHEET, "n_rows", "n_cols", s.alias("_s"))
    end = F.least(F.col("_s") + zone_rows, F.col("n_rows"))
    return z.select(*SHEET,
                    F.concat(F.lit("zone_"), idiv("_s", zone_rows).cast("string")).alias("zone_id"),
                    F.concat(cell_ref(F.lit(1), F.col("_s") + 1), F.lit(":"), cell_ref("n_cols", end)).alias("rng"),
                    F.lit(zone_rows).alias("window_size"),
                    (end - F.col("_s") > compress_over).alias("compressed"))


def key_points(cells: DataFrame, n: int = 5) -> DataFrame:
    """A1 (when row 1 has any cell, as the reference checks the first row's length), the
    first ``n`` heading cells (bounded by row 1's length) and the first ``n`` first-column
    cells (bounded by the row count), each with a role.  One aggregate per sheet, expanded by
    one ``inline``."""
    agg = cells.groupBy(*SHEET).agg(F.max("row").alias("_n"), F.max(F.when(F.col("row") == 1, F.col("col"))).alias("_len1"))
    point = lambda ref, role: F.struct(ref.alias("ref"), F.lit(role).alias("role"))
    empty = F.array().cast("array<struct<ref:string,role:string>>")
    corner = F.when(F.col("_len1").isNotNull(), F.array(point(F.lit("A1"), "corner"))).otherwise(empty)
    header = F.when(F.col("_len1").isNotNull(), F.transform(
        F.sequence(F.lit(1), F.least(F.col("_len1"), F.lit(n))), lambda c: point(cell_ref(c, F.lit(1)), "header"))).otherwise(empty)
    first = F.transform(F.sequence(F.lit(1).cast("bigint"), F.least(F.col("_n"), F.lit(n).cast("bigint"))),
                        lambda r: point(F.concat(F.lit("A"), r.cast("string")), "first_col"))
    return agg.select(*SHEET, F.inline(F.concat(corner, header, first)))


#: The lattice of value masks, finest first: every character by its kind, runs of a kind, letters as one kind, letters
#: and digits as one kind, anything.  All levels are functions of the finest, so its counts are merged upwards.
MASK_LEVELS = 5


def value_mask(value, level: int = 0) -> Column:
    """A value's format: digits 9, capital letters A, other letters a (any script), all else as it is; level 1
    writes a run of one kind once with ``+``; 2 has L for letters; 3 has X for letters and digits; 4 is ``*``."""
    if level >= 4:
        return F.lit("*")
    m = F.col(value) if isinstance(value, str) else value
    for pattern, kind in ((r"\p{Lu}", "A"), (r"[\p{L}&&[^A]]", "a"), (r"\p{Nd}", "9")):
        m = F.regexp_replace(m, pattern, kind)
    return _coarser(m, level)


def _coarser(mask: Column, level: int) -> Column:
    """A level-0 mask at a higher level."""
    if level >= 4:
        return F.lit("*")
    if level == 2:
        mask = F.translate(mask, "Aa", "LL")
    if level == 3:
        mask = F.translate(mask, "Aa9", "XXX")
    return mask if level == 0 else F.regexp_replace(mask, "([Aa9LX])\\1*", "$1+")


def column_masks(cells: DataFrame, k: int = 5) -> DataFrame:
    """The formats of each column: workbook, sheet, col, level, mask, n, share, at the finest level of the
    lattice at which at most ``k`` masks cover the column.  Two partial aggregates: values to level-0 masks with
    counts, those to the masks of all levels; no list of masks is gathered."""
    base = (cells.filter(F.col("value").isNotNull()).groupBy("workbook", "sheet", "col", value_mask("value").alias("m"))
            .agg(F.count(F.lit(1)).alias("n")))
    levels = F.array(*[F.struct(F.lit(i).alias("level"), _coarser(F.col("m"), i).alias("mask")) for i in range(MASK_LEVELS)])
    counts = (base.select("workbook", "sheet", "col", "n", F.inline(levels)).groupBy("workbook", "sheet", "col", "level", "mask")
              .agg(F.sum("n").alias("n")))
    sizes = counts.groupBy("workbook", "sheet", "col", "level").agg(F.count(F.lit(1)).alias("masks"), F.sum("n").alias("total"))
    best = (sizes.filter(F.col("masks") <= k).groupBy("workbook", "sheet", "col")
            .agg(F.min(F.struct("level", "total")).alias("best")).select("workbook", "sheet", "col", "best.*"))
    return (null_safe_join(counts, best, ["workbook", "sheet", "col", "level"])
            .select("workbook", "sheet", "col", "level", "mask", "n", (F.col("n") / F.col("total")).alias("share")))


def column_sketches(cells: DataFrame) -> DataFrame:
    """One mergeable row per (workbook, sheet, col) of the numbers: exact n, lo, hi, sum, and mean and m2 (the
    sum of squared distances from it), and two sketches: quantiles (KLL) and distinct values (HLL)."""
    return (cells.filter(F.col("num").isNotNull()).groupBy("workbook", "sheet", "col")
            .agg(F.count("num").alias("n"), F.min("num").alias("lo"), F.max("num").alias("hi"), F.avg("num").alias("mean"),
                 (F.var_pop("num") * F.count("num")).alias("m2"), F.kll_sketch_agg_double("num").alias("quantiles"),
                 F.hll_sketch_agg(F.col("num").cast("string")).alias("distinct")))


def merge_sketches(*parts: DataFrame) -> DataFrame:
    """The sketches of several sets of cells (a stored table and a micro-batch, say) as those of all of them, without
    reading a cell again.  The means and squares are merged about the common mean, so large values lose nothing."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    key = ["workbook", "sheet", "col"]
    total = rows.groupBy(*key).agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("_mean"))
    moved = F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) * (F.col("mean") - F.col("_mean"))
    return (null_safe_join(rows, total, key).groupBy(*key)
            .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("_mean").alias("mean"), F.sum(moved).alias("m2"),
                 F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("distinct").alias("distinct")))


def sketch_stats(sketches: DataFrame, shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """A14 from stored sketches: exact n, lo, hi, mean, sd; approximate distinct values and quantiles (an array, one
    per share)."""
    sd = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return sketches.select("workbook", "sheet", "col", "n", "lo", "hi", "mean", sd.alias("sd"),
                           F.hll_sketch_estimate("distinct").alias("approx_distinct"),
                           F.array(*[F.kll_sketch_get_quantile_double("quantiles", F.lit(float(x))) for x in shares]).alias("quantiles"))
