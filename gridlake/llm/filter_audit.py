"""Filter interaction audit: what each of several filters removes in every order they can be applied in.

The state of an order is the set of filters applied so far; states and the filters that may come next form the lattice
of subsets.  Which documents an edge (state, next filter) removes depends on the edge alone, so all n! orders share
n * 2**(n-1) edges.  Orders are counted on the lattice: forward, the orders that reach a state; backward, the ways to go
on from it.  An edge lies on forward * backward orders; its removals times that, summed over a filter's edges, are the
filter's removals over all orders (Shapley).  The steps of a single order read the counts of their edges.

Each document gives one mask, the filters that it fails: four are judged from its text in one pass (words, distinct
words, capital letters, symbols); the fifth, being identical to the text of a smaller doc_id, from the smallest doc_id
per digest, a partial aggregate, joined on (doc_id, digest), so that a large group of copies is spread by its doc_ids.
Documents are then counted per (part, mask); nothing later depends on their number.

Defined cases: a null text is empty; a null source is the part '' like an empty one; null doc_ids are neither smaller
nor larger, so such a document fails E never and makes no other fail it, and has no label; rows with the same doc_id
are documents of their own, and rows of the same doc_id and text do not fail E by each other; a document is good (or
toxic) if any label row of its doc_id says so; null labels say nothing; other columns are ignored; an empty table gives
an empty result, empty labels zeros.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import sliced
from gridlake.session import write_table

FILTERS = "ABCDE"
CAPITALS = bytes(range(65, 91))
SYMBOL = re.compile(rb"[#$%&*|]")


def text_mask(data: bytes, n_chars: int) -> int:
    """The bits of the filters A to D that a text fails."""
    words = data.split()
    capitals = len(data) - len(data.translate(None, CAPITALS))
    return ((len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * capitals > 5 * n_chars) << 2
            | bool(SYMBOL.search(data)) << 3)


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask) of each row, filters A to D."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch["text"].to_pylist()]
        data = [t.encode() for t in texts]
        masks = [text_mask(d, len(t)) for d, t in zip(data, texts, strict=True)]
        digests = [hashlib.sha256(d).digest() for d in data]
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["part"], pa.array(digests, pa.binary()), pa.array(masks, pa.int32())],
                                          ["doc_id", "part", "digest", "mask"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), "text")
    return rows.mapInArrow(sliced(step), "doc_id long, part string, digest binary, mask int")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and set of failed filters, one bit each."""
    counts = write_table(judged(docs).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n")), "judged")
    named = counts.where("doc_id is not null")
    label = labels.select(F.col("doc_id").cast("long").alias("l_id"), "quality", "toxic").where("l_id is not null").groupBy("l_id").agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    first = named.groupBy("digest").agg(F.min("doc_id").alias("f_id")).withColumnRenamed("digest", "f_digest")
    own = (named.join(first, (F.col("doc_id") == F.col("f_id")) & (F.col("digest") == F.col("f_digest")), "left")
           .join(label, F.col("doc_id") == F.col("l_id"), "left"))
    copy = F.when(F.col("f_id").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    known = own.select("part", (F.col("mask") + copy).alias("mask"), "n", (F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
                       (F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    nameless = counts.where("doc_id is null").select("part", "mask", "n", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return known.unionByName(nameless).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def lattice(n: int) -> list[tuple[int, int, int]]:
    """(state, filter, orders through the edge) of every edge of the subset lattice, by counting paths both ways."""
    full = (1 << n) - 1
    forward, backward = [0] * (full + 1), [0] * (full + 1)
    forward[0] = backward[full] = 1
    for state in range(full + 1):
        for f in range(n):
            if not state >> f & 1:
                forward[state | 1 << f] += forward[state]
    for state in range(full, -1, -1):
        for f in range(n):
            if not state >> f & 1:
                backward[state] += backward[state | 1 << f]
    return [(state, f, forward[state] * backward[state | 1 << f])
            for state in range(full + 1) for f in range(n) if not state >> f & 1]


def edge_counts(masks: DataFrame, n: int) -> DataFrame:
    """Per part and edge (state, filter): what is removed, kept, redundant and lost there, and the orders through it."""
    edges = ", ".join(f"struct({s} as state, {f} as filter, {p}L as orders)" for s, f, p in lattice(n))
    rows = masks.select("*", F.explode(F.expr(f"array({edges})")).alias("e")).select("*", "e.*")
    passed = rows["mask"].bitwiseAND(rows["state"]) == 0
    fails = F.expr("(mask & shiftleft(1, filter)) <> 0")
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    lost = lambda c: F.coalesce(F.sum(F.when(passed & fails, F.col(c))), F.lit(0))
    return rows.groupBy("part", "state", "filter", "orders").agg(
        total(passed & ~fails).alias("kept"), total(passed & fails).alias("removed"), total(~passed & fails).alias("redundant"),
        total(F.expr("mask = shiftleft(1, filter)")).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"))


def _steps(names: str) -> Column:
    """All steps of all orders, each with its edge: array of struct(filter_order, step, state, filter)."""
    found = []
    for order in permutations(range(len(names))):
        state = 0
        for step, f in enumerate(order):
            found.append(f"struct('{''.join(names[x] for x in order)}' as filter_order, {step + 1} as step, {state} as state, {f} as filter)")
            state |= 1 << f
    return F.expr(f"array({', '.join(found)})")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost at
    that step, and the step's filter's shapley in that part."""
    edges = edge_counts(mask_counts(docs, labels), len(FILTERS))
    shapley = edges.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    steps = docs.sparkSession.range(1).select(F.explode(_steps(FILTERS)).alias("s")).select("s.*")
    return (edges.drop("orders").join(shapley, ["part", "filter"]).join(F.broadcast(steps), ["state", "filter"])
            .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
