"""Cell search: text, exact, wildcard, numeric range, rectangle, single and batch."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.functions.a1 import location_text
from gridlake.functions.values import MIN_TOKEN_BYTES, SPACES, STOP_WORDS, tokenize
from gridlake.operators.sequence import scan_sum
from gridlake.schema import LOCATION
from gridlake.session import materialize


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- text

_SPACE = re.compile("[" + "".join(SPACES) + "]+")


def query_tokens(spark: SparkSession | None, query: str) -> list[str]:
    """The distinct tokens of one query string, by the index's rules (F5): lower case, split
    on Unicode white space, keep words over 2 UTF-8 bytes that are not stop words.
    Computed on the driver (no job); ``tests/test_functions.py`` checks it against the Column
    expression."""
    out: list[str] = []
    for w in _SPACE.split(query.lower()):
        if len(w.encode("utf-8")) > MIN_TOKEN_BYTES and w not in STOP_WORDS and w not in out:
            out.append(w)
    return out


def search_text(postings: DataFrame, query: str, key: Sequence[str] = LOCATION) -> DataFrame:
    """Keys whose text holds every token of ``query`` (AND); no token -> empty.

    The tokens become an ``IN`` list, which reaches the Parquet scan of a token-sorted postings
    table as a pushed filter; postings hold one row per (token, key), so a count per key equal
    to the number of tokens means all are present.  Each key is returned once (D11).
    """
    spark = postings.sparkSession
    tokens = query_tokens(spark, query)
    key = list(key)
    if not tokens:
        return postings.select(*key).limit(0)
    return (postings.filter(F.col("token").isin(tokens)).groupBy(*key)
            .agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(tokens)).select(*key))


def batch_text_search(queries: DataFrame, postings: DataFrame, query_id: str = "query_id",
                      text: str = "text", key: Sequence[str] = LOCATION, materialize_used: bool = True) -> DataFrame:
    """J3 (text): AND search of many queries at once -> (query_id, key…).

    Plan, exact and without a candidate cap:
    1. postings are cut to the tokens some query uses (semi join);
    2. each query picks its rarest token (fewest keys) and takes those keys as candidates, so a
       frequent token never fans out to all its keys for every query that uses it;
    3. every candidate is checked against all of the query's tokens by an equi join on
       (token, key) and kept when the match count equals the query's token count.
    A query with a token absent from the index has no candidates, as in the reference.
    The postings of the used tokens are checkpointed once (``materialize_used``), since
    three branches read them and column pruning keeps Spark from reusing one exchange.
    """
    key = list(key)
    qtok = (queries.select(query_id, F.explode(F.array_distinct(tokenize(text))).alias("token")))
    used = postings.select("token", *key).join(qtok.select("token").distinct(), "token", "left_semi")
    # read three times below: written once to the checkpoint folder instead of recomputed
    used = materialize(used) if materialize_used else used
    df_tok = used.groupBy("token").agg(F.count(F.lit(1)).alias("_df"))
    ranked = qtok.join(df_tok, "token", "left")
    rare = (ranked.groupBy(query_id)
            .agg(F.count(F.lit(1)).alias("_n"), F.count("_df").alias("_known"),
                 F.min_by("token", F.struct("_df", "token")).alias("token"))
            .filter(F.col("_n") == F.col("_known")))
    cand = rare.join(used, "token").select(query_id, "_n", *key)
    checks = cand.join(qtok, query_id).join(used, ["token", *key], "left_semi")
    return (checks.groupBy(query_id, "_n", *key).agg(F.count(F.lit(1)).alias("_m"))
            .filter(F.col("_m") == F.col("_n")).select(query_id, *key))


def exact_gate(cells: DataFrame, probes: DataFrame, probe_col: str = "value") -> DataFrame:
    """Cells whose whole value equals one of the probe strings (case-sensitive).

    The reference tests a Bloom filter on the whole query; a semi join gives the same answer
    without false positives, and Spark adds a runtime Bloom filter on the join when it pays.
    """
    return cells.join(probes.select(F.col(probe_col).alias("value")).distinct(), "value", "left_semi")


def glob_to_like(pattern: str) -> str:
    """``*`` -> ``%``, ``?`` -> ``_``; LIKE metacharacters in the text are escaped."""
    out = []
    for ch in pattern:
        if ch == "*":
            out.append("%")
        elif ch == "?":
            out.append("_")
        elif ch in "%_\\":
            out.append("\\" + ch)
        else:
            out.append(ch)
    return "".join(out)


def search_wildcard(cells: DataFrame, pattern: str) -> DataFrame:
    """Cells whose value matches a glob pattern, case-insensitive, over the whole value."""
    return cells.filter(F.col("value").ilike(glob_to_like(pattern)))


def search_contains(cells: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring scan of values (the reference's scan path)."""
    return cells.filter(F.instr(F.upper("value"), text.upper()) > 0)


# ---------------------------------------------------------------- numbers

def compare(col, op: str, a=None, b=None) -> Column:
    """P5: a typed comparison predicate: ``=, <>, <, <=, >, >=, between`` (inclusive)."""
    c = _c(col)
    ops = {"=": lambda: c == a, "<>": lambda: c != a, "<": lambda: c < a, "<=": lambda: c <= a,
           ">": lambda: c > a, ">=": lambda: c >= a, "between": lambda: c.between(a, b)}
    if op.lower() not in ops:
        raise ValueError(f"unknown operator {op!r}")
    return ops[op.lower()]()


def in_range(col, lo=None, hi=None, lo_inclusive: bool = True, hi_inclusive: bool = False) -> Column:
    """P4 predicate: ``[lo, hi)`` by default (the reference's range); open ends when None."""
    c = _c(col)
    cond = F.lit(True)
    if lo is not None:
        cond = cond & ((c >= lo) if lo_inclusive else (c > lo))
    if hi is not None:
        cond = cond & ((c <= hi) if hi_inclusive else (c < hi))
    return cond


def search_numeric(cells: DataFrame, lo=None, hi=None, lo_inclusive: bool = True,
                   hi_inclusive: bool = False, ordered: bool = False) -> DataFrame:
    """Numeric cells in a range; ``ordered`` sorts ascending by (num, workbook, sheet,
    row, col) like the reference's B-tree walk (a range-partitioned sort; on a
    ``numeric_index`` written by ``write_index`` the files are already in that order)."""
    out = cells.filter(F.col("num").isNotNull() & in_range("num", lo, hi, lo_inclusive, hi_inclusive))
    return out.orderBy("num", *LOCATION) if ordered else out


#: A shape covers at most SPAN + 1 cells of its level's grid along each axis; each level's cells are SPAN times wider.
SPAN = 8


def _level(extent, width: float) -> Column:
    """Grid level of a shape: the smallest on which it is at most SPAN cells wide."""
    cells = F.greatest(extent / F.lit(float(width)), F.lit(1.0))
    return F.greatest(F.ceil(F.log(cells) / math.log(SPAN)) - 1, F.lit(0)).cast("int")


def _levels_of(shapes: DataFrame) -> list[int]:
    """The levels in use: at most about a hundred, since widths are doubles."""
    return sorted(r[0] for r in shapes.select("_level").distinct().collect() if r[0] is not None)


def _cell(x, level, width: float) -> Column:
    return F.floor(_c(x) / (F.lit(float(width)) * F.pow(F.lit(float(SPAN)), level))).cast("bigint")


def range_join(ranges: DataFrame, values: DataFrame, lo: str, hi: str, value: str, width: float,
               lo_inclusive: bool = True, hi_inclusive: bool = False) -> DataFrame:
    """J3 (numbers): all (range, value) pairs with value inside the range.

    Bucketed equi join instead of a nested loop: each range is exploded to the buckets it covers, at most nine
    of a grid whose width (``width`` times a power of eight) suits the range; each value falls in one bucket of
    each grid in use; then the exact residual test.  A very wide range costs no more than a narrow one.
    """
    r = ranges.filter(F.col(hi) >= F.col(lo)).withColumn("_level", _level(F.col(hi) - F.col(lo), width))
    levels = _levels_of(r)
    r = r.withColumn("_b", F.explode(F.sequence(_cell(lo, F.col("_level"), width), _cell(hi, F.col("_level"), width))))
    v = values.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")))
    v = v.withColumn("_b", _cell(value, F.col("_level"), width))
    return (r.join(v, ["_level", "_b"]).filter(in_range(value, F.col(lo), F.col(hi), lo_inclusive, hi_inclusive))
            .drop("_level", "_b"))


def range_count(ranges: DataFrame, values: DataFrame, range_id: Sequence[str], lo: str, hi: str,
                value: str, lo_inclusive: bool = True, hi_inclusive: bool = False, buckets: int = 1024) -> DataFrame:
    """J3 (numbers), counting form: number of values per range (ranges without values are absent).

    Linear in ranges plus distinct values, however many pairs there are: values and range ends are put in one
    order, a bucketed running sum counts the values before each end, and a range's number is the difference of
    its ends' counts.  Values are first reduced to (value, count).  Values and ends are compared in their common
    type (long ids and decimals exactly); a double, which keeps their order, only chooses the bucket.
    """
    range_id = list(range_id)
    kind = (values.select(F.col(value).alias("x")).unionByName(ranges.select(F.col(lo).alias("x")))
            .unionByName(ranges.select(F.col(hi).alias("x"))).schema["x"].dataType)
    counted = (values.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast(kind).alias("_x"))
               .agg(F.count(F.lit(1)).alias("_k")))
    ok = ranges.filter(F.col(lo).isNotNull() & F.col(hi).isNotNull() & (F.col(lo) <= F.col(hi)))
    # an end counts the values before it (place 0) or up to it (place 2); values have place 1
    ends = F.array(F.struct(F.col(lo).cast(kind).alias("x"), F.lit(0 if lo_inclusive else 2).alias("o"), F.lit(-1).alias("s")),
                   F.struct(F.col(hi).cast(kind).alias("x"), F.lit(2 if hi_inclusive else 0).alias("o"), F.lit(1).alias("s")))
    ids = F.struct(*[F.col(c) for c in range_id]).alias("_id")
    points = ok.select(ids, F.inline(ends)).select("_id", F.col("x").alias("_x"), F.col("o").alias("_o"), F.col("s").alias("_s"),
                                                   F.lit(0).cast("bigint").alias("_k"))
    line = points.unionByName(counted.select("_x", "_k", F.lit(1).alias("_o")), allowMissingColumns=True)
    line = line.withColumn("_d", F.col("_x").cast("double"))
    found = counted.agg(F.percentile_approx(F.col("_x").cast("double"), [i / buckets for i in range(1, buckets)], 4 * buckets)).first()[0]
    bounds = sorted(set(found or [0.0]))
    from pyspark.ml.feature import Bucketizer

    cut = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="_d", outputCol="_bucket", handleInvalid="keep")
    line = scan_sum(cut.transform(line), [], ["_x", "_o"], "_bucket", {"_before": (F.col("_k"), False)})
    n = F.sum(F.col("_s") * F.col("_before")).cast("bigint")
    return (line.filter(F.col("_s").isNotNull()).groupBy("_id").agg(n.alias("n")).filter("n > 0")
            .select(*[F.col(f"_id.{c}").alias(c) for c in range_id], "n"))


# ---------------------------------------------------------------- rectangles

def in_rect(x_col, y_col, x, y, w, h) -> Column:
    """Point (x, y) inside the half-open rectangle [x, x+w) × [y, y+h)."""
    xc, yc = _c(x_col), _c(y_col)
    return (xc >= x) & (xc < x + w) & (yc >= y) & (yc < y + h)


def rects_intersect(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Two rectangles overlap (open edges, as the reference's quad-tree test)."""
    return ~((_c(ax) + _c(aw) <= _c(bx)) | (_c(bx) + _c(bw) <= _c(ax))
             | (_c(ay) + _c(ah) <= _c(by)) | (_c(by) + _c(bh) <= _c(ay)))


def search_rect(cells: DataFrame, x, y, w, h) -> DataFrame:
    """Cells in a rectangle of 0-based coordinates (x = col-1, y = row-1).  The constants are shifted, not the
    columns, so the filters reach the scan."""
    return cells.filter(in_rect("col", "row", x + 1, y + 1, w, h))


def rect_join(rects: DataFrame, cells: DataFrame, x: str = "x", y: str = "y", w: str = "w", h: str = "h",
              tile_rows: int = 10, tile_cols: int = 10, same_sheet: bool = False, salts: int = 8) -> DataFrame:
    """J3 (rectangles): every (rectangle, cell) pair with the cell inside the rectangle.

    Rectangles explode to the tiles they cover, at most nine by nine of a grid whose tiles suit their size; cells
    get their tile in each grid in use (A12); equi join on tile and exact P7 residual.  With ``same_sheet`` the
    tile key has workbook and sheet; otherwise the sheets are dealt over ``salts`` copies of each rectangle,
    since the first tiles of all sheets would share a key.  AQE's skew join splits a tile that holds very many cells.
    """
    c0, r0 = F.col("col") - 1, F.col("row") - 1
    first_c, last_c = F.ceil(F.col(x)), F.ceil(F.col(x) + F.col(w)) - 1
    first_r, last_r = F.ceil(F.col(y)), F.ceil(F.col(y) + F.col(h)) - 1
    tr = rects.filter((F.col(w) > 0) & (F.col(h) > 0)).withColumn(
        "_level", F.greatest(_level(F.col(w), tile_cols), _level(F.col(h), tile_rows)))
    levels = _levels_of(tr)
    lev = F.col("_level")
    tr = tr.select("*", F.explode(F.sequence(_cell(first_r, lev, tile_rows), _cell(last_r, lev, tile_rows))).alias("_tr"))
    tr = tr.select("*", F.explode(F.sequence(_cell(first_c, lev, tile_cols), _cell(last_c, lev, tile_cols))).alias("_tc"))
    tc = cells.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>")))
    tc = tc.withColumn("_tr", _cell(r0, lev, tile_rows)).withColumn("_tc", _cell(c0, lev, tile_cols))
    keys = ["_level", "_tr", "_tc"]
    if same_sheet:
        keys += ["workbook", "sheet"]
    else:
        tr = tr.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        tc = tc.withColumn("_salt", F.pmod(F.hash("workbook", "sheet"), F.lit(salts)))
        keys += ["_salt"]
    return (tr.join(tc, keys).filter(in_rect(c0, r0, F.col(x), F.col(y), F.col(w), F.col(h)))
            .drop("_level", "_tr", "_tc", "_salt"))


#: Meetings of two rectangles that a task of :func:`rects_join` is meant to test, and most tasks of one join.
MEETINGS_PER_TASK, MAX_TASKS = 2_000_000, 20_000


def rects_join(left: DataFrame, right: DataFrame, on: Sequence[str], tile_w: int, tile_h: int) -> DataFrame:
    """Pairs of overlapping rectangles (columns x, y, w, h of each, whole numbers) of equal ``on`` columns; the
    right side's columns come as ``r_...``.

    Each rectangle is dealt to the tiles it covers (choose a tile near the usual size) and meets only those of its
    tiles.  A pair is given by one tile alone, that of the overlap's first corner, so nothing is made twice and
    no distinct follows; a crowded place is many tiles, and AQE splits a crowded tile.  The work is the meetings within
    tiles, which grow faster than the rows, so they are counted first and dealt over as many tasks as they ask for."""

    def tiled(df: DataFrame) -> DataFrame:
        side = lambda a, n, size: F.explode(F.sequence(F.floor(a / size), F.floor((a + n - 1) / size)))
        return (df.filter((F.col("w") > 0) & (F.col("h") > 0)).withColumn("_tx", side(F.col("x"), F.col("w"), tile_w))
                .withColumn("_ty", side(F.col("y"), F.col("h"), tile_h)))

    a, b = tiled(left), tiled(right)
    b = b.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], F.col("_tx").alias("r__tx"), F.col("_ty").alias("r__ty"))
    keys = [*on, "_tx", "_ty"]
    same = [F.col(c) == F.col(f"r_{c}") for c in keys]
    n_a = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("_na"))
    n_b = b.groupBy(*[f"r_{c}" for c in keys]).agg(F.count(F.lit(1)).alias("_nb"))
    met = n_a.join(n_b.hint("merge"), reduce(Column.__and__, same)).agg(F.sum(F.col("_na").cast("double") * F.col("_nb"))).first()[0] or 0
    tasks = int(min(max(met // MEETINGS_PER_TASK, int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))), MAX_TASKS))
    a, b = a.repartition(tasks, *keys), b.repartition(tasks, *[f"r_{c}" for c in keys]).hint("merge")
    corner = ((F.floor(F.greatest("x", "r_x") / tile_w) == F.col("_tx")) & (F.floor(F.greatest("y", "r_y") / tile_h) == F.col("_ty")))
    return (a.join(b, reduce(Column.__and__, same))
            .filter(corner & rects_intersect("x", "y", "w", "h", "r_x", "r_y", "r_w", "r_h")).drop("_tx", "_ty", "r__tx", "r__ty"))


# ---------------------------------------------------------------- sheets, caps, context

def scan_sheets(cells: DataFrame, name_query: str, max_sheets: int = 10, max_rows: int = 1000) -> DataFrame:
    """P2 + L2 + L3: sheets whose name contains ``name_query`` (case-insensitive) among the first
    ``max_sheets`` of each workbook; per sheet the cells kept under the row cap and a
    ``truncated`` flag when the sheet has more rows than the cap."""
    hit = cells.filter(F.upper("sheet").contains(name_query.upper()) & (F.col("sheet_idx") < max_sheets))
    return (hit.groupBy("workbook", "sheet", "sheet_idx")
            .agg((F.max("row") > max_rows).alias("truncated"),
                 F.count_if(F.col("row") <= max_rows).alias("n")))


def top_hits(hits: DataFrame, n: int = 100, order: Sequence[str] = LOCATION) -> DataFrame:
    """L1: the first ``n`` hits in a total order (TakeOrderedAndProject, no global sort)."""
    return hits.orderBy(*order).limit(n)


def fetch_cells(cells: DataFrame, page: DataFrame, max_locations: int = 1000) -> DataFrame:
    """L1 + P11: the cells of a page of hits (at most ``max_locations``).  The page's
    locations come to the driver (a result page is small by definition): their sheets and row
    numbers become ``IN`` filters that reach the Parquet scan (a table sorted by (workbook,
    sheet, row) reads only the row groups holding the hits), and the exact locations are
    matched by a semi join with the page, broadcast with its proven bound."""
    locs = page.select(*LOCATION).limit(max_locations + 1).collect()
    if len(locs) > max_locations:
        raise ValueError(f"a page holds at most {max_locations} locations")
    if not locs:
        return cells.limit(0)
    spark = cells.sparkSession
    exact = spark.createDataFrame([tuple(r) for r in locs], page.select(*LOCATION).schema)
    cand = cells.filter(F.col("sheet").isin(sorted({r["sheet"] for r in locs}))
                        & F.col("row").isin(sorted({r["row"] for r in locs})))
    return cand.join(F.broadcast(exact), list(LOCATION), "left_semi")


def with_location_text(hits: DataFrame) -> DataFrame:
    """``Sheet!B7`` text of each hit (needs ``sheet`` and ``ref``)."""
    return hits.withColumn("location", location_text("sheet", "ref"))


def hit_context(hits: DataFrame, cells: DataFrame, k: int = 1) -> DataFrame:
    """Each hit with its column heading (row 1 of the same column, null if absent) and its
    same-row neighbours within ``k`` columns, one row per neighbour.  Equi joins on
    (workbook, sheet, col) and (workbook, sheet, row), so no nested loop."""
    heading = cells.filter(F.col("row") == 1).select("workbook", "sheet", "col", F.col("value").alias("heading"))
    near = cells.select("workbook", "sheet", "row", F.col("col").alias("_ncol"), F.col("value").alias("nearby"))
    return (hits.join(heading, ["workbook", "sheet", "col"], "left")
            .join(near, ["workbook", "sheet", "row"])
            .filter(F.abs(F.col("_ncol") - F.col("col")).between(1, k))
            .withColumnRenamed("_ncol", "nearby_col"))


def union_hits(*frames: DataFrame, key: Sequence[str] = LOCATION) -> DataFrame:
    """Hits of several strategies, each location once (the reference appended duplicates)."""
    out = frames[0].select(*key)
    for f in frames[1:]:
        out = out.unionByName(f.select(*key))
    return out.distinct()


def intersect_hits(a: DataFrame, b: DataFrame, key: Sequence[str] = LOCATION) -> DataFrame:
    """Locations present in both (the reference kept the left list's duplicates)."""
    return a.select(*key).join(b.select(*key).distinct(), list(key), "left_semi").distinct()
