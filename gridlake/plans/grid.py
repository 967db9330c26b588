"""The driver tables seen as sheets of one workbook (input of the cell-level queries)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.session import write_table
from gridlake.sources.tables import table_to_cells, to_decimal, with_cell_fields

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MEMO: dict = {}


def grid_cells(spark: SparkSession, sf_dir: str, workbook: str = "tables") -> DataFrame:
    """The grid, built once per session and folder and written as a Parquet table in the
    shared checkpoint folder (sorted by sheet, row, col), so every query — and every branch of
    a query that reads the cells several times — scans the written table with pushdown
    instead of recomputing the numbering.  See :func:`build_grid_cells`."""
    key = (spark.sparkContext.applicationId, spark.sparkContext.startTime, sf_dir, workbook)
    if key not in _MEMO:
        _MEMO[key] = write_table(build_grid_cells(spark, sf_dir, workbook), "grid",
                                 ["workbook", "sheet", "row", "col"])
    return _MEMO[key]


def build_grid_cells(spark: SparkSession, sf_dir: str, workbook: str = "tables") -> DataFrame:
    """Five tables as sheets: region 0, nation 1, supplier 2, customer 3, part 4.

    Row = rank by primary key; doubles as two-decimal text; a few blanks are introduced on
    purpose (a rule on the key or size) so densities are not all 1.
    """
    t = lambda n: load(spark, sf_dir, n)
    c = F.col
    sheets = [
        table_to_cells(t("region"), "region", "r_regionkey", [c("r_name")], 0, workbook),
        table_to_cells(t("nation"), "nation", "n_nationkey", [c("n_name"), c("n_regionkey")], 1, workbook),
        table_to_cells(t("supplier"), "supplier", "s_suppkey",
                       [c("s_name"), c("s_nationkey"), to_decimal("s_acctbal")], 2, workbook),
        table_to_cells(t("customer"), "customer", "c_custkey",
                       [c("c_name"), F.when(c("c_nationkey") % 4 != 0, c("c_nationkey")), c("c_mktsegment")],
                       3, workbook),
        table_to_cells(t("part"), "part", "p_partkey",
                       [c("p_name"), c("p_brand"), F.when(c("p_partkey") % 5 != 0, c("p_type")),
                        F.when(c("p_size") % 3 != 0, c("p_size")),
                        F.when(c("p_partkey") % 7 != 0, to_decimal("p_retailprice"))], 4, workbook),
    ]
    return reduce(DataFrame.unionByName, sheets)


def big_grid_cells(spark: SparkSession, sf_dir: str, workbook: str = "sales") -> DataFrame:
    """A larger workbook for benchmarks: orders and lineitem as sheets on top of the five above."""
    t = lambda n: load(spark, sf_dir, n)
    c = F.col
    # lineitem has no unique key: order by every column, so equal rows are interchangeable.
    li_order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    extra = [
        table_to_cells(t("orders"), "orders", "o_orderkey",
                       [c("o_custkey"), c("o_orderstatus"), to_decimal("o_totalprice"),
                        F.date_format("o_orderdate", "yyyy-MM-dd"), c("o_orderpriority")], 5, workbook),
        table_to_cells(t("lineitem"), "lineitem", li_order,
                       [c("l_orderkey"), c("l_partkey"), c("l_suppkey"), c("l_quantity").cast("int"),
                        to_decimal("l_extendedprice"), to_decimal("l_discount"), c("l_returnflag"),
                        c("l_linestatus")], 6, workbook),
    ]
    return reduce(DataFrame.unionByName, [build_grid_cells(spark, sf_dir, workbook)] + extra)


def formula_cells(spark: SparkSession, sf_dir: str, workbook: str = "book") -> DataFrame:
    """``part`` as sheets ``calc0``, ``calc1``, ... of 500 rows with formulas, in groups of 100 rows (row = key + 1, so
    every sheet begins where the one before ends).

    Column A: ``SUM`` of a range of column B of the same group, as long as the part's size; column B: the size, and in
    every tenth row a formula that reads a cell of column A of the group; column C: the brand.  So each group has
    cycles, all of them through ranges.  Of two groups, one B cell of the first also reads the first A cell of the second:
    a path between cycles, at times to another sheet.
    """
    # a small file is one task's, whatever its rows become
    p = load(spark, sf_dir, "part").repartition("p_partkey")
    i, base = F.col("p_partkey") % 100, F.col("p_partkey") - F.col("p_partkey") % 100
    lo = (i * 7 + 3) % 100
    sums = F.concat(F.lit("SUM(B"), base + lo + 1, F.lit(":$B$"), base + F.least(lo + F.col("p_size"), F.lit(99)) + 1, F.lit(")"))
    back = F.concat(F.lit("A"), base + (i * 3 + 11) % 100 + 1, F.lit("*2"))
    onward = F.concat(F.lit("+calc"), F.floor((base + 100) / 500), F.lit("!A"), base + 101)
    back = F.when((i == 90) & (F.floor(base / 100) % 2 == 0), F.concat(back, onward)).otherwise(back)
    cells = F.array(F.struct(F.lit(1).alias("col"), F.col("p_partkey").cast("string").alias("value"), sums.alias("formula")),
                    F.struct(F.lit(2).alias("col"), F.col("p_size").cast("string").alias("value"), F.when(i % 10 == 0, back).alias("formula")),
                    F.struct(F.lit(3).alias("col"), F.col("p_brand").alias("value"), F.lit(None).cast("string").alias("formula")))
    sheet = F.floor(base / 500).cast("int")
    return with_cell_fields(p.select(F.lit(workbook).alias("workbook"), F.concat(F.lit("calc"), sheet).alias("sheet"), sheet.alias("sheet_idx"),
                                     (F.col("p_partkey") + 1).alias("row"), F.inline(cells)))
