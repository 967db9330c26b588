"""Strongly connected components of a large directed graph.

1. Trimming: nodes without predecessors or without successors are on no cycle; a few rounds take most of a typical
   dependency graph away.
2. Colouring, forward and backward at once: with random priorities, every node learns the greatest node that reaches
   it and the greatest that it reaches.  Two nodes of one component agree in both, so edges whose ends differ are cut.
   What hangs together afterwards and had no edge cut is strongly connected: its greatest node reaches all and is
   reached by all.  Otherwise the next round has new priorities; a path is cut at every record of its priorities, so
   few outer rounds are needed.
3. Pieces (nodes of the same two colours) of at most ``max_local_edges`` edges are finished where they are: a linear
   search inside one task per piece.  A graph of no more edges than that is a single piece from the start.  Larger
   ones go on with 2, so the bound moves work, not results.

Labels move one edge a round and jump to what their holder has learned; a long chain of large pieces therefore takes
rounds in proportion to its length in the worst case.  Every round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.operators.sequence import join_side
from gridlake.session import write_table

#: Edges of a piece that one task may hold: some 100 bytes each.
MAX_LOCAL_EDGES = 500_000


def tarjan(out: dict[int, list[int]]) -> Iterator[list[int]]:
    """The strongly connected components of a graph {node: successors}, without recursion."""
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    open_: list[int] = []
    on: set[int] = set()
    for start in out:
        if start in index:
            continue
        work = [(start, iter(out[start]))]
        index[start] = low[start] = len(index)
        open_.append(start)
        on.add(start)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    open_.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(out.get(nxt, ()))))
                    break
                if nxt in on:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    found = []
                    while True:
                        found.append(open_.pop())
                        on.discard(found[-1])
                        if found[-1] == node:
                            break
                    yield found


def _local(edges: DataFrame) -> DataFrame:
    """(v, c) of the pieces (column piece) that are small enough, one piece a task at a time: components of two nodes
    or more, c their smallest node number."""

    def solve(pdf):
        import pandas as pd

        out: dict[int, list[int]] = {}
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            out.setdefault(a, []).append(b)
        rows = [(v, min(found)) for found in tarjan(out) if len(found) > 1 for v in found]
        return pd.DataFrame(rows, columns=["v", "c"]).astype("int64")

    return edges.groupBy("piece").applyInPandas(solve, "v long, c long")


def _trimmed(edges: DataFrame, rounds: int) -> tuple[DataFrame, int]:
    """The edges left after a few rounds of taking away nodes without predecessors or successors, and their number."""
    n = edges.count()
    for _ in range(rounds):
        has_out = join_side(edges.select(F.col("a").alias("b")).distinct(), n)
        has_in = join_side(edges.select(F.col("b").alias("a")).distinct(), n)
        edges = write_table(edges.join(has_out, "b", "left_semi").join(has_in, "a", "left_semi").select("a", "b"), "trimmed")
        left = edges.count()
        if left == n:
            break
        n = left
    return edges, n


def _coloured(edges: DataFrame, n: int, seed: int) -> DataFrame:
    """(v, f, b): the node of greatest priority that reaches v, and that v reaches.  ``n`` edges have at most 2 * n nodes."""
    top = F.struct(F.xxhash64("v", F.lit(seed)).alias("p"), F.col("v").alias("v"))
    state = write_table(edges.select(F.explode(F.array("a", "b")).alias("v")).distinct().select("v", top.alias("f"), top.alias("b")), "colours")
    while True:
        at = join_side(state.select(F.col("v").alias("u"), F.col("f").alias("uf"), F.col("b").alias("ub")), 2 * n)
        none = F.lit(None).cast("struct<p:bigint,v:bigint>")
        told = (edges.join(at, F.col("a") == F.col("u")).select(F.col("b").alias("v"), F.col("uf").alias("f"), none.alias("b"))
                .unionByName(edges.join(at, F.col("b") == F.col("u")).select(F.col("a").alias("v"), none.alias("f"), F.col("ub").alias("b")))
                .unionByName(state.join(at, F.col("f.v") == F.col("u")).select("v", F.col("uf").alias("f"), none.alias("b")))
                .unionByName(state.join(at, F.col("b.v") == F.col("u")).select("v", none.alias("f"), F.col("ub").alias("b")))
                .groupBy("v").agg(F.max("f").alias("nf"), F.max("b").alias("nb")).withColumnRenamed("v", "w"))
        grown = state.join(join_side(told, 2 * n), F.col("v") == F.col("w"), "left")
        new = write_table(grown.select("v", F.greatest("f", "nf").alias("f"), F.greatest("b", "nb").alias("b"),
                                       ((F.col("nf") > F.col("f")) | (F.col("nb") > F.col("b"))).alias("grew")), "colours")
        state = new.drop("grew")
        if not new.filter("grew").head(1):
            return state


def strongly_connected(edges: DataFrame, src: str = "src", dst: str = "dst", max_local_edges: int = MAX_LOCAL_EDGES,
                       trim_rounds: int = 6) -> DataFrame:
    """(node, component) of every node on a cycle; the component is its smallest node.  A node alone is on a cycle
    only with an edge to itself.  Nodes may be of any type with an order and a hash; null ends are ignored."""
    raw = write_table(edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).filter("s is not null and d is not null").distinct(), "edges")
    loops = raw.filter("s = d").select(F.col("s").alias("node"))
    # numbers instead of nodes from here on; 2**33 of them per partition
    names = write_table(raw.select(F.explode(F.array("s", "d")).alias("node")).distinct().select(
        "node", F.monotonically_increasing_id().alias("v")), "nodes")
    n_names = names.count()
    a = join_side(names.select(F.col("node").alias("s"), F.col("v").alias("a")), n_names)
    b = join_side(names.select(F.col("node").alias("d"), F.col("v").alias("b")), n_names)
    left, n = _trimmed(write_table(raw.filter("s <> d").join(a, "s").join(b, "d").select("a", "b"), "numbered"), trim_rounds)
    found: list[DataFrame] = []
    seed = 0
    while n:
        if n <= max_local_edges:
            found.append(write_table(_local(left.withColumn("piece", F.lit(0))), "components"))
            break
        seed += 1
        colour = _coloured(left, n, seed)
        one = join_side(colour.select(F.col("v").alias("a"), F.col("f.v").alias("af"), F.col("b.v").alias("ab")), 2 * n)
        two = join_side(colour.select(F.col("v").alias("b"), F.col("f.v").alias("bf"), F.col("b.v").alias("bb")), 2 * n)
        kept = write_table(left.join(one, "a").join(two, "b").filter("af = bf and ab = bb").select(
            "a", "b", F.struct("af", "ab").alias("piece")), "pieces")
        m = kept.count()
        if m == n:  # every piece is a component
            nodes = kept.select("piece", F.explode(F.array("a", "b")).alias("v")).distinct()
            low = nodes.groupBy("piece").agg(F.min("v").alias("c")).withColumnRenamed("piece", "_piece")
            found.append(nodes.join(join_side(low, m), F.col("piece") == F.col("_piece")).select("v", "c"))
            break
        size = kept.groupBy("piece").agg(F.count("*").alias("k")).withColumnRenamed("piece", "_piece")
        sized = kept.join(join_side(size, m), F.col("piece") == F.col("_piece"))
        found.append(write_table(_local(sized.filter(F.col("k") <= max_local_edges).select("a", "b", "piece")), "components"))
        left, n = _trimmed(write_table(sized.filter(F.col("k") > max_local_edges).select("a", "b"), "large"), trim_rounds)
    out = loops.select("node", F.col("node").alias("component"))
    if found:
        parts = found[0]
        for f in found[1:]:
            parts = parts.unionByName(f)
        member = parts.join(join_side(names, n_names), "v").select("node", "c")
        low = member.groupBy("c").agg(F.min("node").alias("component")).withColumnRenamed("c", "_c")
        member = write_table(member.join(join_side(low, n_names), F.col("c") == F.col("_c")).select("node", "component"), "members")
        alone = out.join(join_side(member.select(F.col("node").alias("_n")), n_names), F.col("node") == F.col("_n"), "left_anti")
        out = member.unionByName(alone)
    return out
