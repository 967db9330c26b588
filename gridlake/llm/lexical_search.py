"""Ranked lexical search by NRA (no random access) over impact-sorted lists, exact to the last tie.

Terms are ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z in lower case.  A document's score for an item is
the sum, over the item's terms with repeats, of ``w * ((1000000000 * tf) div (1000 * tf + 8 * m))``.

One pass over the texts writes a forward table (row, terms of the items with their counts, length); its sums give N, L
and df.  A second pass reads it in chunks of at most CHUNK_ENTRIES entries, so a task's memory is bounded whatever its
share of the rows.  A chunk's entries become one list per term, sorted by impact.  For an item the lists are read from
their heads, in blocks of doubling depth, and never out of order.  A document's lower score is the sum of what was
read of it; its upper score adds, for every list in which it was not met, the impact at which that list now stands.
Reading goes on until (a) documents not met at all cannot reach the k-th best lower score, (b) no other document can,
and (c) lower and upper score of every remaining one agree, so that members, ties and scores are final.  The k best of
a task's earlier chunks raise the bar for its later ones.  Each task gives at most k rows per item; they are reduced in
two steps, first per item and slice of tasks, then per item.

Items are searched in blocks of about ``block_bytes`` bytes of text (one item is never split); a block's terms are what
is sent to the tasks.

Defined cases: null or empty texts have no terms; a document without terms counts in neither N nor L; items without
terms, or whose documents all score 0, give no row; rows of ``benchmark`` with the same item_id are one item with all
their terms, identical rows counted once; a null item_id is an item of its own; every row of ``docs`` is a document, so
repeated doc_ids may rank one after the other; a null doc_id ranks before others of the same score; other columns are
ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlake.llm.common import batch_of, hashed_counts, sliced
from gridlake.session import write_table

#: A-Z to a-z, other ASCII characters that are not letters or digits to a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Entries (document, term) that a task holds at once: some 40 bytes each.
CHUNK_ENTRIES = 2_000_000
#: Depth of the first block that is read of a list.
FIRST_DEPTH = 128
#: Slices of tasks whose best rows are reduced apart before they meet.
SLICES = 256

FORWARD = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
FOUND = "item int, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def forward_table(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of each row: its length and the counts of those terms that have a number in ``known``."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        number = sent.value
        lengths, terms, tfs = [], [], []
        for text in batch["text"].to_pylist():
            words = terms_of(text)
            found = Counter(filter(number.__contains__, words))
            lengths.append(len(words))
            terms.append([number[w] for w in found])
            tfs.append(list(found.values()))
        return pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(v, f.type) for v, f in zip(
            (lengths, terms, tfs), list(FORWARD)[1:], strict=True))], schema=FORWARD)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(sliced(step), "doc_id long, n long, terms array<int>, tfs array<int>")


def document_frequencies(forward: DataFrame, n_terms: int) -> np.ndarray:
    """Documents per term number."""

    def count(batches):
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(batch["terms"].flatten().to_numpy(zero_copy_only=False), minlength=n_terms)
        return total

    return hashed_counts(forward.select("terms"), count, n_terms)


class ImpactLists:
    """One list per term of a chunk of documents, highest ``(10**9 * tf) div (1000 * tf + 8 * m)`` first."""

    def __init__(self, n: np.ndarray, terms: np.ndarray, tfs: np.ndarray, sizes: np.ndarray, n_docs: int, total: int):
        m = 100 - 75 + 75 * n * n_docs // max(total, 1)
        owner = np.repeat(np.arange(len(n)), sizes)
        impact = 1_000_000_000 * tfs // (1000 * tfs + 8 * m[owner])
        order = np.lexsort((-impact, terms))
        self.docs, self.impact = owner[order], impact[order]
        present, first = np.unique(terms[order], return_index=True)
        self.places = dict(zip(present.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True), strict=True))
        self.n = len(n)

    def __getitem__(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.places.get(term, (0, 0))
        return self.docs[a:b], self.impact[a:b]


def nra(lists: ImpactLists, weights: list[tuple[int, int]], k: int, bar: int, depth: int = FIRST_DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the chunk that may be among the k best: final scores, all of at least the k-th of them
    and of ``bar``, and over 0.  ``weights``: (term, weight with repeats); ``depth``: of the first block read."""
    read = [(d, w * c) for t, w in weights if w > 0 for d, c in [lists[t]] if len(d)]
    lower = np.zeros(lists.n, np.int64)
    met = np.zeros((len(read), lists.n), bool)
    done = 0
    while True:
        stand = np.zeros(len(read), np.int64)  # no unread entry of a list is above it
        for i, (d, c) in enumerate(read):
            lower[d[done:depth]] += c[done:depth]
            met[i, d[done:depth]] = True
            if depth < len(d):
                stand[i] = c[depth - 1]
        floor = max(bar, 1)
        if lists.n >= k:
            floor = max(floor, int(np.partition(lower, lists.n - k)[lists.n - k]))
        unread = int(stand.sum())
        if unread < floor:
            alive = np.flatnonzero(lower + unread >= floor)
            rest = unread - stand @ met[:, alive]
            keep = lower[alive] + rest >= floor
            if not rest[keep].any():
                return alive[keep], lower[alive[keep]]
        done, depth = depth, 2 * depth


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The batches of a task in tables of about ``most`` entries; rows of at most 2,048 documents go together."""
    held, entries = [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, 2048):
            part = batch.slice(k, 2048)
            held.append(part)
            entries += len(part["terms"].flatten())
            if entries >= most:
                yield pa.Table.from_batches(held)
                held, entries = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _search(forward: DataFrame, queries: list[list[tuple[int, int]]], n_docs: int, total: int, k: int,
            chunk_entries: int, depth: int) -> DataFrame:
    """(item, doc_id, score): of each task the rows that may be among an item's k best."""
    sent = forward.sparkSession.sparkContext.broadcast(queries)

    def search(batches):
        best: dict[int, list] = defaultdict(list)  # item -> (-score, has doc_id, doc_id), sorted
        for chunk in _chunks(batches, chunk_entries):
            flat = lambda c: c.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.diff(np.concatenate([[0], np.cumsum(chunk["terms"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False))]))
            lists = ImpactLists(chunk["n"].to_numpy(), flat(chunk["terms"]), flat(chunk["tfs"]), sizes, n_docs, total)
            ids = chunk["doc_id"].to_pylist()
            for item, weights in enumerate(sent.value):
                own = best[item]
                docs, scores = nra(lists, weights, k, -own[k - 1][0] if len(own) >= k else 0, depth)
                found = [(-s, ids[d] is not None, ids[d] or 0) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)]
                best[item] = sorted(own + found)[:k]
        rows = [(item, d if has else None, -s) for item, own in best.items() for s, has, d in own]
        for a in range(0, len(rows), 10_000):
            items, ids, scores = zip(*rows[a:a + 10_000], strict=True)
            yield batch_of({"item": (list(items), pa.int32()), "doc_id": (list(ids), pa.int64()), "score": (list(scores), pa.int64())})

    return forward.where(F.size("terms") > 0).mapInArrow(search, FOUND)


def _best(rows: DataFrame, k: int) -> DataFrame:
    """item, rank, doc_id, score of the k best rows of each item."""
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    sliced_ = rows.withColumn("slice", F.spark_partition_id() % SLICES)
    few = sliced_.withColumn("rank", F.row_number().over(Window.partitionBy("item", "slice").orderBy(*order))).where(F.col("rank") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, Counter]]]:
    """The items, (item_id, terms with repeats), dealt by hash into blocks of about ``block_bytes`` bytes of text."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").dropna(subset=["text"]).distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    rows = rows if n == 1 else write_table(rows, "items")
    for b in range(n):
        items: dict[int | None, Counter] = defaultdict(Counter)
        for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).collect():
            items[r["item_id"]].update(terms_of(r["text"]))
        if found := [(i, t) for i, t in items.items() if t]:
            yield found


def search(docs: DataFrame, benchmark: DataFrame, k: int = 10, block_bytes: int = 4 << 20,
           chunk_entries: int = CHUNK_ENTRIES, depth: int = FIRST_DEPTH) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents with a score above 0 of every item."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for items in _blocks(benchmark, block_bytes):
        number = {t: i for i, t in enumerate(sorted(set().union(*(t for _, t in items))))}
        forward = write_table(forward_table(docs, number), "forward")
        n_docs, total = forward.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = document_frequencies(forward, len(number))
        weight = [term_weight(n_docs, int(x)) for x in df]
        queries = [sorted((number[t], times * weight[number[t]]) for t, times in terms.items()) for _, terms in items]
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(items)], "item int, item_id long")
        best = _best(_search(forward, queries, n_docs, total, k, chunk_entries, depth), k)
        out = out.unionByName(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out
