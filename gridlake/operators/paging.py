"""Paging: navigation pages, chunk cursors, keyset pages, has-more."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions.a1 import idiv

# Fixed value of the reference: estimated seconds per remaining chunk.
SECONDS_PER_CHUNK = 2


def nav_page(sheets: DataFrame, offset: int = 0, window_size: int = 1000) -> DataFrame:
    """The sheets of one navigation page ``[offset, offset+window_size)`` with the
    workbook's page count ``ceil(n / window_size)``."""
    totals = sheets.groupBy("workbook").agg(F.ceil(F.count(F.lit(1)) / window_size).alias("total_pages"))
    return (sheets.filter(F.col("sheet_idx").between(offset, offset + window_size - 1))
            .join(totals, "workbook"))


def sheet_pages(sheets: DataFrame, window_size: int = 1000) -> DataFrame:
    """Page number of every sheet and the next/previous sheet in ordinal order
    (window partitioned by workbook: a workbook's sheet list is small)."""
    w = Window.partitionBy("workbook").orderBy("sheet_idx")
    return (sheets.withColumn("page", idiv("sheet_idx", window_size))
            .withColumn("next_sheet", F.lead("sheet").over(w))
            .withColumn("prev_sheet", F.lag("sheet").over(w)))


def chunk_cursors(chunks: DataFrame) -> DataFrame:
    """next/previous chunk ids, chunks remaining after each one and the reference's ETA
    (2 s per remaining chunk)."""
    w = Window.partitionBy("workbook").orderBy("first_sheet")
    rest = Window.partitionBy("workbook").orderBy("first_sheet").rowsBetween(1, Window.unboundedFollowing)
    return (chunks.withColumn("next_chunk", F.lead("chunk_id").over(w))
            .withColumn("prev_chunk", F.lag("chunk_id").over(w))
            .withColumn("remaining", F.count(F.lit(1)).over(rest))
            .withColumn("eta_seconds", F.col("remaining") * SECONDS_PER_CHUNK))


def _order(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc() if asc else F.col(c).desc() for c, asc in order]


def after_key(order: Sequence[tuple[str, bool]], key: dict) -> Column:
    """Rows strictly after ``key`` in the lexicographic ``order`` (keyset predicate)."""
    cond, prefix = F.lit(False), F.lit(True)
    for c, asc in order:
        v = F.lit(key[c])
        step = (F.col(c) > v) if asc else (F.col(c) < v)
        cond = cond | (prefix & step)
        prefix = prefix & (F.col(c) == v)
    return cond


def keyset_page(df: DataFrame, order: Sequence[tuple[str, bool]], n: int, after: dict | None = None) -> DataFrame:
    """L4: the ``n`` rows following the cursor key ``after`` in a total ``order``.

    A filter plus a top-n (TakeOrderedAndProject): no global sort, no offset scan, and the
    predicate on the leading key reaches the Parquet scan.  ``order`` must be total (unique).
    """
    if after is not None:
        df = df.filter(after_key(order, after))
    return df.orderBy(*_order(order)).limit(n)


def last_key(page: DataFrame, order: Sequence[tuple[str, bool]]) -> dict | None:
    """The cursor of a page: its last row's key (one row to the driver)."""
    row = page.orderBy(*_order([(c, not a) for c, a in order])).select(*[c for c, _ in order]).first()
    return row.asDict() if row else None


def offset_page(df: DataFrame, order: Sequence[tuple[str, bool]], offset: int, n: int) -> DataFrame:
    """L4 for small offsets: ``orderBy().offset().limit()``."""
    return df.orderBy(*_order(order)).offset(offset).limit(n)


def with_has_more(df: DataFrame, order: Sequence[tuple[str, bool]], n: int, mode: str = "probe") -> DataFrame:
    """A page of ``n`` rows with a ``has_more`` flag.

    ``probe`` (default) reads ``n+1`` rows and flags when the extra one exists;
    ``at_least`` reproduces the reference (``count >= n``, also true on an exact fit).
    """
    probe = df.orderBy(*_order(order)).limit(n + 1)
    w = Window.partitionBy(F.lit(0))  # over at most n+1 rows
    cnt = F.count(F.lit(1)).over(w)
    flag = (cnt > n) if mode == "probe" else (F.least(cnt, F.lit(n)) >= n)
    rn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*_order(order)))
    return probe.withColumn("has_more", flag).withColumn("_rn", rn).filter(F.col("_rn") <= n).drop("_rn")
