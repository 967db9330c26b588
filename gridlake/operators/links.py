"""Formula links, dangling references, set similarity and circular dependencies."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.functions.a1 import ref_col, ref_row
from gridlake.operators.sequence import null_safe_join, scan_sum
from gridlake.session import checkpoint_dir, materialize

# A reference: optional sheet (quoted, with '' for a quote in it, or bare; any letters; a workbook in brackets before
# it) and '!', then a cell, optionally ':' and a second cell, or two columns.  Not preceded by a name character and not
# followed by '(' (so LOG10( is a function, not a cell).
_SHEET = r"(?:'(?:[^']|'')+'|(?:\[[^\]]+\])?[\p{L}_][\p{L}\p{N}_.]*)!"
_REF = (r"(?<![\p{L}\p{N}_.$'!\]])(?:" + _SHEET + r")?"
        r"(?:\$?[A-Z]{1,3}\$?[0-9]+(?::\$?[A-Z]{1,3}\$?[0-9]+)?|\$?[A-Z]{1,3}:\$?[A-Z]{1,3})(?![\p{L}\p{N}_(!])")
_TEXT = r'"(?:[^"]|"")*"'


def formula_links(df: DataFrame, formula: str = "formula", sheet: str = "sheet") -> DataFrame:
    """One row per reference found in a formula (texts in double quotes hold none), keeping the input columns:
    ``target_book`` (the workbook in brackets; null: the own one), ``target_sheet`` (the cell's own sheet when
    unqualified), ``target_row``, ``target_col`` and, for a range, ``target_end_row``/``target_end_col``; whole
    columns have no rows.  Regex extraction and ``explode``; no UDF."""
    refs = F.regexp_extract_all(F.regexp_replace(F.col(formula), _TEXT, '""'), F.lit(_REF), 0)
    out = df.withColumn("_ref", F.explode(refs))
    qual = F.regexp_extract("_ref", r"^(.*)!", 1)
    quoted = qual.startswith("'")
    name = F.when(quoted, F.regexp_replace(F.regexp_replace(qual, "^'|'$", ""), "''", "'")).otherwise(qual)
    book = F.regexp_extract(name, r"\[([^\]]+)\]", 1)
    cells = F.regexp_replace(F.regexp_replace("_ref", r"^.*!", ""), r"\$", "")
    first, last = F.get(F.split(cells, ":"), 0), F.get(F.split(cells, ":"), 1)
    col = lambda part: F.coalesce(ref_col(part), ref_col(F.concat(part, F.lit("1"))))  # noqa: E731 - a column alone
    tsheet = F.when(qual != "", F.regexp_replace(name, r"^.*\]", "")).otherwise(F.col(sheet))
    return (out.withColumn("target_book", F.when(book != "", book)).withColumn("target_sheet", tsheet)
            .withColumn("target_row", ref_row(first)).withColumn("target_col", col(first))
            .withColumn("target_end_row", ref_row(last)).withColumn("target_end_col", col(last))
            .drop("_ref"))


def dangling_links(links: DataFrame, cells: DataFrame) -> DataFrame:
    """Links within a workbook whose target is not there: a single cell that is empty, or, for ranges and
    whole columns, a sheet that has no cells.  Links to other workbooks are not judged."""
    own = links.filter(F.col("target_book").isNull())
    single = F.col("target_row").isNotNull() & F.col("target_end_col").isNull()
    at = cells.select("workbook", F.col("sheet").alias("target_sheet"), F.col("row").alias("target_row"), F.col("col").alias("target_col"))
    sheets = at.select("workbook", "target_sheet").distinct()
    return (null_safe_join(own.filter(single), at.distinct(), ["workbook", "target_sheet", "target_row", "target_col"], "left_anti")
            .unionByName(null_safe_join(own.filter(~single), sheets, ["workbook", "target_sheet"], "left_anti")))


def similar_sets(items: DataFrame, set_col: str, item_col: str, threshold: float) -> DataFrame:
    """Pairs of sets (a < b) with exact Jaccard similarity >= ``threshold``.

    Exact prefix filtering instead of all pairs: items are ordered globally by frequency
    (its power of two, rarest first, then by hash); a pair with Jaccard >= t must share an item among the first
    ``|s| - ceil(t·|s|) + 1`` items of each set, so only prefix items are joined (a frequent
    item sits at the end of the order and rarely in a prefix).  Candidates pass a size filter
    and are then verified with an exact intersection count.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    # read four times below: written once to the checkpoint folder instead of recomputed
    s = materialize(items.select(F.col(set_col).alias("s"), F.col(item_col).alias("t")).distinct())
    sizes = s.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    freq = s.groupBy("t").agg(F.count(F.lit(1)).alias("f"))
    # places in a set: by how often an item occurs (its power of two), then by hash; a running count over buckets of
    # that order, so that a very large set is not one task
    high = F.floor(F.log2("f")).cast("bigint")
    ordered = s.join(freq, "t").join(sizes, "s").withColumn("_order", F.struct(high.alias("f"), F.xxhash64("t").alias("h"), F.col("t")))
    ordered = ordered.withColumn("_bucket", high * 64 + F.shiftright("_order.h", 58) + 32)
    ranked = scan_sum(ordered, ["s"], ["_order"], "_bucket", {"pos": (F.lit(1), True)})
    prefix_len = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    pre = ranked.filter(F.col("pos") <= prefix_len).select("s", "t", "n")
    # size bands of ratio 1/t: a pair can only reach t when |b| is within [t|a|, |a|/t], i.e. in
    # the same or a neighbouring band, so each prefix row meets only its band and the two next
    # to it (one band of margin for floating-point rounding at band edges)
    band = (F.floor(F.log(F.col("n")) / math.log(1.0 / threshold) + 1e-9) if threshold < 1 else F.col("n")).cast("bigint")
    pre = pre.withColumn("_band", band)
    a = pre.select(F.col("s").alias("a"), "t", F.col("n").alias("na"),
                   F.explode(F.array(F.col("_band") - 1, F.col("_band"), F.col("_band") + 1)).alias("_band"))
    b = pre.select(F.col("s").alias("b"), "t", F.col("n").alias("nb"), "_band")
    pairs = (a.join(b, ["t", "_band"]).filter(F.col("a") != F.col("b"))
             .filter((F.col("nb") >= F.col("na") * threshold - 1e-9) & (F.col("na") >= F.col("nb") * threshold - 1e-9)))
    lo = F.when(F.col("a") < F.col("b"), F.struct(F.col("a").alias("s"), F.col("na").alias("n"))).otherwise(
        F.struct(F.col("b").alias("s"), F.col("nb").alias("n")))
    hi = F.when(F.col("a") < F.col("b"), F.struct(F.col("b").alias("s"), F.col("nb").alias("n"))).otherwise(
        F.struct(F.col("a").alias("s"), F.col("na").alias("n")))
    cand = pairs.select(lo.alias("_x"), hi.alias("_y")).select(
        F.col("_x.s").alias("a"), F.col("_y.s").alias("b"), F.col("_x.n").alias("na"), F.col("_y.n").alias("nb")).distinct()
    inter = (cand.join(s.withColumnRenamed("s", "a"), "a")
             .join(s.withColumnRenamed("s", "b"), ["b", "t"], "left_semi")
             .groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("k")))
    jac = F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))
    return inter.withColumn("jaccard", jac).filter(F.col("jaccard") >= threshold).select("a", "b", "k", "jaccard")


def _chain_dead(e: DataFrame) -> DataFrame:
    """Nodes of edge table (a -> b) whose chain of single predecessors starts at a node with
    no predecessor: such a node cannot lie on a cycle.  Pointer doubling: every round each
    node's pointer jumps to its pointer's pointer, so a chain of length L is resolved in
    about log2(L) rounds (each a join, written to the checkpoint folder); the loop stops when
    no pointer moves.  Nodes on a cycle keep circling and are never marked."""
    nodes = e.select(F.col("a").alias("v")).union(e.select(F.col("b").alias("v"))).distinct()
    indeg = e.groupBy(F.col("b").alias("v")).agg(F.count(F.lit(1)).alias("k"))
    sources = nodes.join(indeg, "v", "left_anti")
    state = materialize(e.join(indeg.filter(F.col("k") == 1).select(F.col("v").alias("b")), "b")
                        .select(F.col("b").alias("v"), F.col("a").alias("ptr")))
    # after r rounds a pointer has walked 2**r steps: ceil(log2(n+1)) rounds walk any chain of
    # the n single-predecessor nodes to its start; pointers on a cycle never settle
    rounds = max(1, math.ceil(math.log2(state.count() + 1)))
    for _ in range(rounds):
        s_, t_ = state.alias("s"), state.alias("t")
        nxt = (s_.join(t_, F.col("s.ptr") == F.col("t.v"), "left")
               .select(F.col("s.v").alias("v"), F.coalesce(F.col("t.ptr"), F.col("s.ptr")).alias("ptr"),
                       (F.col("t.ptr").isNotNull() & (F.col("t.ptr") != F.col("s.ptr"))).alias("_moved")))
        nxt = materialize(nxt)
        state = nxt.drop("_moved")
        if nxt.filter("_moved").limit(1).count() == 0:
            break
    dead = state.join(sources.withColumnRenamed("v", "ptr"), "ptr", "left_semi").select("v")
    return dead.unionByName(sources).distinct()


def cyclic_core(edges: DataFrame, src: str = "src", dst: str = "dst", peel_rounds: int = 6) -> DataFrame:
    """Nodes left after repeatedly removing nodes that cannot be on a cycle: those
    whose predecessor chain starts at a source, or whose successor chain ends at a sink.  For
    a graph where each node has at most one outgoing edge (one formula -> one reference)
    these are exactly the nodes on cycles; in general, nodes on cycles and on paths between
    cycles.

    A plain peeling of sources and sinks needs one round per node of the longest chain (a
    running total down a million rows would be a million rounds); chains are resolved here by
    pointer doubling (:func:`_chain_dead`), so rounds grow with the logarithm of chain length
    and with the number of merge points.  Up to ``peel_rounds`` cheap peeling rounds run
    first; most graphs settle there.  Surviving edges are written to the session's
    checkpoint folder every round; only counts reach the driver.
    """
    checkpoint_dir(edges.sparkSession)
    e = materialize(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct())
    n = e.count()
    # cheap peeling rounds first (sources and sinks); chains left after them go to doubling
    for _ in range(peel_rounds):
        has_out = e.select(F.col("a").alias("b")).distinct()
        has_in = e.select(F.col("b").alias("a")).distinct()
        nxt = materialize(e.join(has_out, "b", "left_semi").join(has_in, "a", "left_semi").select("a", "b"))
        m = nxt.count()
        e = nxt
        if m == n:
            return e.select(F.col("a").alias("node")).distinct()
        n = m
    while n:
        dead_in = _chain_dead(e)
        dead_out = _chain_dead(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        dead = dead_in.unionByName(dead_out).distinct()
        nxt = (e.join(dead.withColumnRenamed("v", "a"), "a", "left_anti")
               .join(dead.withColumnRenamed("v", "b"), "b", "left_anti").select("a", "b"))
        nxt = materialize(nxt)
        m = nxt.count()
        e = nxt
        if m == n:
            break
        n = m
    return e.select(F.col("a").alias("node")).distinct()
