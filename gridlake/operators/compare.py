"""Change detection and change application."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.functions.a1 import parse_location
from gridlake.operators.index import build_numeric_index, build_postings
from gridlake.operators.sequence import null_safe_join
from gridlake.schema import LOCATION

# Fixed value of the reference: a bulk change over this many cells asks for a partial rebuild.
BULK_REBUILD_CELLS = 1000


def changed_checksums(current: DataFrame, known: DataFrame, key: Sequence[str] = ("path",),
                      checksum: str = "checksum") -> DataFrame:
    """Each current item with ``changed`` = unknown key or different checksum."""
    key = list(key)
    k = known.select(*key, F.col(checksum).alias("_known"))
    return (current.join(k, key, "left")
            .withColumn("changed", F.col("_known").isNull() | (F.col("_known") != F.col(checksum)))
            .drop("_known"))


def validated_lookup(requests: DataFrame, entries: DataFrame, key: Sequence[str] = ("key",), now: str = "now",
                     expected: str = "expected_checksum", checksum: str = "checksum",
                     expires_at: str = "expires_at") -> DataFrame:
    """Requests that find a live entry: ``now <= expires_at`` and, unless the expected
    checksum is empty, an equal checksum.  Missing, expired or stale entries drop out."""
    key = list(key)
    e = entries.select(*key, F.col(checksum).alias("_sum"), F.col(expires_at).alias("_exp"))
    ok = (F.col(now) <= F.col("_exp")) & (F.coalesce(F.col(expected), F.lit("")).isin("") | (F.col(expected) == F.col("_sum")))
    return requests.join(e, key).filter(ok).drop("_sum", "_exp")


def compare_sheets(a: DataFrame, b: DataFrame, label: str, value: str) -> DataFrame:
    """Two labelled value columns side by side (full outer join on the label), with
    ``diff = a − b`` and ``ratio = a / b`` (null on division by zero or a missing side)."""
    x = a.select(F.col(label).alias("_la"), F.col(value).alias("v_a"))
    y = b.select(F.col(label).alias("_lb"), F.col(value).alias("v_b"))
    return (x.join(y, F.col("_la") == F.col("_lb"), "full_outer")
            .select(F.coalesce("_la", "_lb").alias(label), "v_a", "v_b",
                    (F.col("v_a") - F.col("v_b")).alias("diff"), F.try_divide("v_a", "v_b").alias("ratio")))


def diff_snapshots(old: DataFrame, new: DataFrame, key: Sequence[str] = LOCATION) -> DataFrame:
    """Changed cells between two snapshots keyed by location: 'added', 'removed',
    'cell_update' (value differs) or 'formula_change' (only the formula differs).
    A full outer join with null-safe comparisons; unchanged cells are dropped."""
    key = list(key)
    o = old.select(*key, F.col("value").alias("old_value"), F.col("formula").alias("old_formula"), F.lit(True).alias("_o"))
    n = new.select(*key, F.col("value").alias("new_value"), F.col("formula").alias("new_formula"), F.lit(True).alias("_n"))
    j = o.join(n, key, "full_outer")
    change = (F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed")
              .when(~F.col("old_value").eqNullSafe(F.col("new_value")), "cell_update")
              .when(~F.col("old_formula").eqNullSafe(F.col("new_formula")), "formula_change"))
    return j.withColumn("change", change).filter(F.col("change").isNotNull()).drop("_o", "_n")


def last_per_key(deltas: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The latest delta per key by ``order`` (``max_by`` of a struct: a partial aggregate, so
    a key with a billion updates is reduced map-side)."""
    key, order, values = list(key), list(order), list(values)
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    return deltas.groupBy(*key).agg(last).select(*key, *[F.col(f"_last.{v}").alias(v) for v in values])


def apply_deltas(base: DataFrame, deltas: DataFrame, key: Sequence[str], order: Sequence[str],
                 values: Sequence[str], deleted: str | None = None) -> DataFrame:
    """A snapshot after applying changes: the last change per key replaces the key's
    row (``left_anti`` + union, null keys equal); a change whose ``deleted`` column is true (null: not), or whose
    values are all null, removes it.  Idempotent: applying the same deltas twice gives the same snapshot."""
    key, values = list(key), list(values)
    cols = values + ([deleted] if deleted else [])
    last = last_per_key(deltas, key, order, cols)
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    some = reduce(lambda a, b: a | b, [F.col(v).isNotNull() for v in values])
    alive = last.filter(~gone & some)
    kept = null_safe_join(base, last.select(*key), key, "left_anti")
    return kept.select(*key, *values).unionByName(alive.select(*key, *values))


def cell_deltas(deltas: DataFrame) -> DataFrame:
    """S8 -> cells: a delta file's ``Sheet!B2`` locations parsed (F3); malformed ones are
    returned with ``bad_location`` so the caller can route them to an error table."""
    loc = parse_location("location")
    return (deltas.withColumn("_loc", loc)
            .withColumn("bad_location", F.col("_loc").isNull())
            .withColumn("sheet", F.coalesce(F.col("_loc.sheet"), F.col("sheet")))
            .withColumn("row", F.col("_loc.row")).withColumn("col", F.col("_loc.col")).drop("_loc"))


def apply_cell_deltas(cells: DataFrame, deltas: DataFrame) -> DataFrame:
    """T1/J9 on ``cells``: changes of a location apply in (event_ts, seq) order.  A ``cell_update`` writes a value and
    takes the formula away (empty: the cell goes); a ``formula_change`` writes a formula (empty: none) and leaves
    the value as it is.  Malformed locations change nothing (:func:`bad_deltas` lists them).  Returns the new
    cells (value, num, kind recomputed)."""
    from gridlake.sources.tables import with_cell_fields

    d = cell_deltas(deltas).filter(~F.col("bad_location") & F.col("type").isin("cell_update", "formula_change"))
    at, is_value = F.struct("event_ts", "seq"), F.col("type") == "cell_update"
    new = F.struct(F.when(F.col("new_value") != "", F.col("new_value")).alias("v"))
    last = d.groupBy(*LOCATION).agg(F.max_by("type", at).alias("_type"), F.max_by(new, at).alias("_new"),
                                    F.max_by(F.when(is_value, new), F.when(is_value, at)).alias("_value"))
    base = cells.select(*LOCATION, F.col("value").alias("_old"))
    hit = null_safe_join(last, base, LOCATION, "left")
    formula_last = F.col("_type") == "formula_change"
    changed = hit.select(
        *LOCATION,
        F.when(F.col("_value").isNotNull(), F.col("_value.v")).otherwise(F.col("_old")).alias("value"),
        F.when(formula_last, F.col("_new.v")).alias("formula"))
    kept = null_safe_join(cells.select(*LOCATION, "value", "formula"), last.select(*LOCATION), LOCATION, "left_anti")
    out = kept.unionByName(changed).filter(F.col("value").isNotNull() | F.col("formula").isNotNull())
    sheet_idx = cells.select("workbook", "sheet", "sheet_idx").distinct()
    return with_cell_fields(null_safe_join(out, sheet_idx, ["workbook", "sheet"], "left")).select(
        "workbook", "sheet", "sheet_idx", "row", "col", "ref", "value", "num", "formula", "kind")


def bad_deltas(deltas: DataFrame) -> DataFrame:
    """The changes of cells whose location cannot be read, as they came."""
    return (cell_deltas(deltas).filter(F.col("bad_location") & F.col("type").isin("cell_update", "formula_change"))
            .select(*deltas.columns))


def update_numeric(numeric: DataFrame, new_cells: DataFrame, touched: DataFrame) -> DataFrame:
    """J9 for the numeric index: entries of touched locations go and come back from those locations' new values."""
    t = touched.select(*LOCATION).distinct()
    fresh = build_numeric_index(null_safe_join(new_cells, t, LOCATION, "left_semi"))
    return null_safe_join(numeric, t, LOCATION, "left_anti").unionByName(fresh)


def update_postings(postings: DataFrame, new_cells: DataFrame, touched: DataFrame) -> DataFrame:
    """U3 + J9 for the inverted index: postings of touched locations are removed
    (``left_anti``; empty tokens simply vanish) and rebuilt from those locations' new values."""
    t = touched.select(*LOCATION).distinct()
    kept = postings.join(t, LOCATION, "left_anti")
    fresh = build_postings(new_cells.join(t, LOCATION, "left_semi"))
    return kept.unionByName(fresh)


def bulk_impact(deltas: DataFrame, group: Sequence[str], affected: str | None = None,
                threshold: int = BULK_REBUILD_CELLS) -> DataFrame:
    """Affected cells per group and the action.  With ``affected``, a column of counts, each change is
    tested by itself, as in the reference: 'rebuild' if any is above the threshold, else 'incremental'; without it
    a group's number of changes is tested."""
    total = F.sum(F.col(affected)) if affected else F.count(F.lit(1))
    tested = F.max(F.col(affected)) if affected else F.count(F.lit(1))
    return (deltas.groupBy(*group).agg(total.cast("bigint").alias("affected"), tested.alias("_tested"))
            .withColumn("action", F.when(F.col("_tested") > threshold, "rebuild").otherwise("incremental")).drop("_tested"))
