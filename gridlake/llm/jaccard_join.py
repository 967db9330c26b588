"""Exact n-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set holds its distinct ``size``-word shingles (64-bit hashes); two documents link when
100 * |A and B| >= percent * |A or B|.  Equal sets are one class and only its smallest doc_id is joined.

Each set is ordered rare first.  Two linked sets share a shingle among the first n - ceil(percent * n / 100) + 1 of
each, so only these are joined.  A candidate pair must pass the length filter, the positional filter (the places of
the shared shingle among those that several documents hold bound the overlap; what only one holds adds nothing) and the
suffix filter (the sets are cut at fixed points of the hash range; the
smaller counts per part bound the overlap) before its sets are brought together, once.

1. Documents that stand alone.  One that has a prefix full of shingles no other document holds links with nothing.  To
   see it, the shingles of a fixed SHARE of the hash range (more than a prefix needs) are packed per chunk of documents
   and hash range, eight bytes each, and shuffled by range; the owners of those that occur once go back by chunk.  A
   hash cut to 48 bits can only hide such a shingle, never invent one.  Most documents end here.
2. The others' sets are written.  How many of them hold a shingle is counted (a partial aggregate); the shingles of one
   holder come first in the order, the others follow by count, and only those in a prefix become entries.
3. Large groups are not expanded into pairs: in each hub round every document meets one hub per shingle (the most
   typical document, then a random one), the verified links become components, and only documents that are still in
   different components meet in the last round.  That round has no cap, so every link between components is found.

Stage 1 holds a hash range of about RANGE_KEYS shingles in one task.  Ranges are at most MAX_RANGES; an input of over
four times as many shingles (some terabytes of text) skips it, and all documents go on with 2: more is shuffled, but
the result is the same.

Defined cases: a null or empty text has the empty set, links with nothing and is its own component; fewer words
than ``size`` make one shingle of the whole sequence; rows with the same doc_id are one document that links if
any of its texts does; rows with a null doc_id keep a null component and link with nothing; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import SLICE_ROWS, sliced
from gridlake.llm.components import connected_components
from gridlake.session import drop_table, write_table

#: Eighths of the hash range whose shingles are looked at to find documents that stand alone.
SHARE = 3
#: Sampled shingles per chunk of documents and, on average, per hash range; documents per chunk; hash ranges.
CHUNK_KEYS, RANGE_KEYS, CHUNK_DOCS, MAX_RANGES = 1 << 20, 1 << 22, 1 << 15, 1 << 14
#: Parts of the hash range for the suffix filter.
PARTS = 64
#: Shingles before an entry's own that it carries.
BEFORE = 64
#: Up to this many document ids are broadcast to pick documents; beyond it they are joined.
BROADCAST_IDS = 1_000_000

_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                   0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


class _WordHashes(dict):
    """64-bit hashes of words; forgets everything when ``limit`` words are held."""

    limit = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


#: One for all steps of a Python worker.
_KNOWN = _WordHashes()


def _mixed(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return keys ^ (keys >> np.uint64(29))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Distinct shingle hashes of a text, ascending.  A shingle is its words in order, so the hash weighs each
    word by its place; a shorter sequence also counts its length in."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    n = len(words) - width + 1
    keys = np.full(n, width, np.uint64)
    for k in range(width):
        keys += ids[k:k + n] * _PLACE[k % 8] * np.uint64(2 * (k // 8) + 1)
    return np.unique(_mixed(keys))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def least_overlap(n: Column, m: Column, percent: int) -> Column:
    """ceil(percent * (n + m) / (100 + percent))."""
    return F.floor((percent * (n + m) + (99 + percent)) / F.lit(100 + percent)).cast("long")


def _n_ranges(docs: DataFrame) -> int:
    """Hash ranges, a power of two, for the sampled shingles of all texts at five bytes a word; 0: too many."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    need = size // 5 * SHARE // 8 // RANGE_KEYS
    return 0 if need > 4 * MAX_RANGES else min(MAX_RANGES, 1 << int(need).bit_length())


BLOCK = pa.schema([("chunk", pa.string()), ("part", pa.int32()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
                   ("digests", pa.list_(pa.binary())), ("keys", pa.binary()), ("owners", pa.binary())])
BLOCK_SQL = "chunk string, part int, ids array<long>, sizes array<long>, digests array<binary>, keys binary, owners binary"


def _blocks(docs: DataFrame, size: int, ranges: int) -> DataFrame:
    """Chunks of documents: one row of part -1 with doc_ids, set sizes and digests, and a row per hash range with the
    sampled shingles in it (six bytes each) and their places in the chunk (two bytes each)."""
    bits = max(ranges, 1).bit_length() - 1

    def flush(ids, sizes, digests, sampled):
        chunk = uuid.uuid4().hex
        keys = np.concatenate(sampled)
        owner = np.repeat(np.arange(len(ids), dtype="<u2"), [len(k) for k in sampled])
        order = np.argsort(keys)
        keys, owner = keys[order], owner[order]
        ends = np.searchsorted(keys, np.arange(1, ranges, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.empty(0, np.int64)
        raw = np.ascontiguousarray((keys >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
        rows = [(chunk, -1, ids, sizes, digests, None, None)]
        for part, (a, b) in enumerate(zip([0, *ends], [*ends, len(keys)], strict=True)):
            if a < b:
                rows.append((chunk, part, None, None, None, raw[a:b].tobytes(), owner[a:b].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), BLOCK, strict=True)], schema=BLOCK)

    def run(batches):
        ids, sizes, digests, sampled, held = [], [], [], [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(k, SLICE_ROWS)
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    keys = shingles(text, size)
                    ids.append(doc_id)
                    sizes.append(len(keys))
                    digests.append(xxhash.xxh3_128_digest(keys.tobytes()))
                    sampled.append(keys[(keys & np.uint64(7)) < SHARE] if ranges and doc_id is not None else keys[:0])
                    held += len(sampled[-1])
                    if held >= CHUNK_KEYS or len(ids) >= CHUNK_DOCS:
                        yield flush(ids, sizes, digests, sampled)
                        ids, sizes, digests, sampled, held = [], [], [], [], 0
        if ids:
            yield flush(ids, sizes, digests, sampled)

    return docs.mapInArrow(run, BLOCK_SQL)


def _single_owners(table: pa.Table) -> pa.Table:
    """Of the rows of one hash range: per chunk the places of the shingles that occur once in all chunks."""
    keys = []
    for raw in table["keys"].to_pylist():
        wide = np.zeros((len(raw) // 6, 8), np.uint8)
        wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
        keys.append(wide.view("<u8").ravel())
    ends = np.cumsum([0] + [len(k) for k in keys])
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    once = np.empty(len(keys), bool)
    once[order] = ~(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
    owners = [np.frombuffer(raw, "<u2")[once[a:b]].tobytes() for raw, a, b in zip(table["owners"].to_pylist(), ends, ends[1:], strict=False)]
    return pa.table({"chunk": table["chunk"], "owners": pa.array(owners, pa.binary())})


def signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Per row: doc_id, n (set size), the set's 128-bit digest, and whether the document is sure to stand alone."""
    blocks = write_table(_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), size, _n_ranges(docs)), "blocks")
    single = blocks.where("part >= 0").select("part", "chunk", "keys", "owners").groupBy("part").applyInArrow(
        _single_owners, "chunk string, owners binary")

    def judge(table: pa.Table) -> pa.Table:
        found = [np.frombuffer(raw, "<u2") for raw in table["owners"].to_pylist() if raw is not None]
        (k,) = [i for i, x in enumerate(table["ids"].to_pylist()) if x is not None]
        ids, sizes, digests = (table[c][k].as_py() for c in ("ids", "sizes", "digests"))
        seen = np.bincount(np.concatenate([np.empty(0, np.int64), *found]).astype(np.int64), minlength=len(ids))
        alone = [bool(n) and int(u) >= prefix_length(n, percent) for n, u in zip(sizes, seen, strict=True)]
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(sizes, pa.int64()), "digest": pa.array(digests, pa.binary()),
                         "alone": pa.array(alone, pa.bool_())})

    chunks = blocks.where("part = -1").select("chunk", "ids", "sizes", "digests").unionByName(single, allowMissingColumns=True)
    out = write_table(chunks.groupBy("chunk").applyInArrow(judge, "doc_id long, n long, digest binary, alone boolean"), "signatures")
    drop_table(blocks)
    return out


def shingle_sets(docs: DataFrame, open_: DataFrame, size: int) -> DataFrame:
    """(sid, doc_id, n, keys, parts) of the documents' sets in ``open_`` (doc_id, digest): a number, the shingles and the
    counts per part of the hash range of the suffix filter.  To be written at once, as the numbers are the tasks'."""
    ids = open_.select("doc_id").distinct()
    rows = _picked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids, "left_semi")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = [shingles(t, size) for t in batch["text"].to_pylist()]
        parts = [np.bincount((k >> np.uint64(58)).astype(np.int64), minlength=PARTS) for k in keys]
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array([xxhash.xxh3_128_digest(k.tobytes()) for k in keys], pa.binary()), pa.array([len(k) for k in keys], pa.int64()),
             pa.array([k.astype(np.int64) for k in keys], pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.int32()))],
            ["doc_id", "digest", "n", "keys", "parts"])

    made = rows.mapInArrow(sliced(step), "doc_id long, digest binary, n long, keys array<long>, parts array<int>")
    return (made.join(open_, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"]).drop("digest")
            .withColumn("sid", F.monotonically_increasing_id()))


def _meets(a: str, b: str, percent: int, first: bool = False) -> Column:
    """Length and positional filters of two prefix entries (columns n, m and place with the given prefixes): m shingles
    are held by several documents, ``place`` of them come before the one that is met.

    With ``first`` the pair meets at the first shingle that both prefixes hold, as far as their columns ``before`` tell
    (the first BEFORE of those places), and nothing before that counts."""
    n, o = F.col(f"{a}n"), F.col(f"{b}n")
    left, right = F.col(f"{a}m") - F.col(f"{a}place"), F.col(f"{b}m") - F.col(f"{b}place")
    passed = F.least(f"{a}place", f"{b}place")
    if first:
        passed = F.when(F.greatest(f"{a}place", f"{b}place") > BEFORE, passed).otherwise(0)
    fits = (100 * F.least(n, o) >= percent * F.greatest(n, o)) & (passed + F.least(left, right) >= least_overlap(n, o, percent))
    return fits & ~F.arrays_overlap(f"{a}before", f"{b}before") if first else fits


def _side(df: DataFrame, k: str, *cols: str) -> DataFrame:
    return df.select(F.col("doc_id").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in cols])


def suffix_filter(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose counts per part of the hash range leave room for enough shared shingles."""
    bound = F.aggregate(F.zip_with("a_parts", "b_parts", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    both = pairs.join(_side(parts, "a", "n", "parts"), "a").join(_side(parts, "b", "n", "parts"), "b")
    return both.where(bound >= least_overlap(F.col("a_n"), F.col("b_n"), percent)).select("a", "b")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    both = pairs.join(_side(sets, "a", "keys"), "a").join(_side(sets, "b", "keys"), "b")
    shared = F.size(F.array_intersect("a_keys", "b_keys"))
    return both.where(shared >= least_overlap(F.size("a_keys"), F.size("b_keys"), percent)).select("a", "b")


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, hub_rounds: int = 1) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = signatures(docs, size, percent)
    named = rows.where("doc_id is not null and n > 0")
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    member = write_table(named.groupBy("doc_id", "digest").agg(F.min("alone").alias("alone")).join(classes, "digest")
                         .select("doc_id", "rep", "digest", "alone"), "members")
    # a doc_id with several texts ties their classes together
    many = member.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    links = write_table(member.join(many, "doc_id").where("rep > low").select(F.col("rep").alias("a"), F.col("low").alias("b"))
                        .distinct(), "links")
    sets = write_table(shingle_sets(docs, member.where("doc_id = rep and not alone").select("doc_id", "digest"), size), "sets")
    entries = write_table(_entries(sets, percent), "entries")
    tried = None
    for r in range(hub_rounds + 1):
        at = _with_component(entries, links)
        pairs = _hub_pairs(at, r, percent) if r < hub_rounds else _cross_pairs(at, percent)
        met = write_table(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "met")
        pairs = met if tried is None else met.join(tried, ["a", "b"], "left_anti")
        pairs = write_table(suffix_filter(pairs, sets, percent), "pairs")
        drop_table(met)
        links = write_table(links.unionByName(verify(pairs, sets, percent)), "links")
        tried = pairs if tried is None else tried.unionByName(pairs)
    component = connected_components(links)
    rep = member.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    found = rep.join(component, rep["rep"] == component["node"], "left").select(
        "doc_id", F.coalesce("component", "rep").alias("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


ENTRIES = "s long, doc_id long, n long, m long, place long, typical int, before array<long>"


def _prefixes(percent: int):
    """A mapInArrow function from rows (sid, doc_id, n, s, f), sorted by sid, to the prefix entries of each set."""
    names = [c.split()[0] for c in ENTRIES.split(", ")]

    def entries(columns: list[np.ndarray]) -> pa.RecordBatch:
        sid, doc_id, n, s, f = columns
        order = np.lexsort((s, f, sid))
        first = np.flatnonzero(np.diff(sid, prepend=sid[0] - 1))
        sizes = np.diff(np.append(first, len(sid)))
        m = np.repeat(sizes, sizes)
        place = np.arange(len(sid)) - np.repeat(first, sizes)
        typical = np.add.reduceat(np.log2(f.astype(float)), first) / n[first]
        keep = place < (n - -(-percent * n // 100) + 1) - (n - m)
        s = s[order]
        out = [pa.array(x[keep]) for x in (s, doc_id, n, m, place, np.repeat((1000 * typical).astype(np.int32), sizes))]
        held = np.minimum(place[keep], BEFORE)
        ends = np.concatenate([[0], np.cumsum(held)])
        at = np.repeat(np.repeat(first, sizes)[keep] - ends[:-1], held) + np.arange(ends[-1])
        out.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(s[at])))
        return pa.RecordBatch.from_arrays(out, names)

    def run(batches):
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch[c].to_numpy(zero_copy_only=False) for c in ("sid", "doc_id", "n", "s", "f")]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            whole = int(np.searchsorted(held[0], held[0][-1]))  # the last set may go on in the next batch
            if whole:
                yield entries([x[:whole] for x in held])
                held = [x[whole:] for x in held]
        if held is not None:
            yield entries(held)

    return run


def _entries(sets: DataFrame, percent: int) -> DataFrame:
    """Prefix entries (s, doc_id, n, m, place, typical, before) whose shingle another set has too.

    A set's order is: shingles of one holder, then its m others by their number of holders.  The first kind is only
    counted, so a set with a prefix of them has no entry.  ``typical``: how often its shingles occur, on average of
    their logarithms."""
    held = sets.select("sid", "doc_id", "n", F.explode("keys").alias("s"))
    repeated = held.groupBy("s").agg(F.count("*").alias("f")).where("f > 1").withColumnRenamed("s", "t")
    shared = held.join(repeated, F.col("s") == F.col("t")).select("sid", "doc_id", "n", "s", "f")
    return shared.repartition("sid").sortWithinPartitions("sid").mapInArrow(_prefixes(percent), ENTRIES)


def _with_component(entries: DataFrame, links: DataFrame) -> DataFrame:
    component = connected_components(links)
    return entries.join(component, F.col("doc_id") == F.col("node"), "left").select(
        "s", "doc_id", "n", "m", "place", "typical", "before", F.coalesce("component", "doc_id").alias("c"))


_MET = ("doc_id", "n", "m", "place", "c")


def _hub_pairs(entries: DataFrame, turn: int, percent: int) -> DataFrame:
    """Every entry with its shingle's hub: the most typical document in the first turn, a random one later."""
    by = F.col("typical").cast("long") if turn == 0 else F.xxhash64("doc_id", F.lit(turn))
    hubs = entries.groupBy("s").agg(F.max(F.struct(by.alias("by"), *_MET)).alias("h"))
    hubs = hubs.select("s", *[F.col(f"h.{c}").alias(f"h_{c}") for c in _MET])
    return (entries.join(hubs, "s").where((F.col("c") != F.col("h_c")) & _meets("", "h_", percent))
            .select(F.col("doc_id").alias("a"), F.col("h_doc_id").alias("b")))


def _band(n: Column) -> Column:
    """Sizes in bands of two hundredths."""
    return F.floor(F.log(n.cast("double")) / math.log(1.02)).cast("int")


def _cross_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Entries of a shingle whose documents are still in different components and could link.

    Of two such entries one at least is outside the shingle's largest component; it looks for the other among the
    sizes o with 100 * m >= percent * (n + o) / (1 + percent / 100), since it can share no more than its m shingles,
    and within the length filter: the sizes' bands are part of the join's key.  A pair is given where it first meets."""
    sizes = entries.groupBy("s", "c").agg(F.count("*").alias("k"))
    top = sizes.groupBy("s").agg(F.max(F.struct("k", "c")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select(
        "s", F.col("top.c").alias("top"))
    open_ = write_table(entries.join(top, "s"), "open")
    least = F.ceil(percent * F.col("n") / 100)
    most = F.least(F.floor(100 * F.col("n") / percent), F.floor(F.col("m") * (100 + percent) / percent) - F.col("n"))
    lone = open_.where(F.col("c") != F.col("top")).withColumns({"_low": least, "_high": most}).where("_low <= _high")
    lone = lone.withColumn("band", F.explode(F.sequence(_band(F.col("_low")), _band(F.col("_high")))))
    other = open_.select("s", _band(F.col("n")).alias("band"), *[F.col(c).alias(f"o_{c}") for c in (*_MET, "before")])
    return (lone.join(other, ["s", "band"]).where((F.col("c") != F.col("o_c")) & _meets("", "o_", percent, first=True))
            .select(F.col("doc_id").alias("a"), F.col("o_doc_id").alias("b")))


def _picked(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """A semi or anti join of ``docs`` with ids; up to BROADCAST_IDS of them are broadcast, so that no text moves."""
    ids = ids.select(F.col("doc_id").alias("_id"))
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, docs["doc_id"].cast("long") == ids["_id"], how)


def first_of_each_component(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns, without the documents that another one of their component stands for: the row with
    the component's smallest doc_id stays, once if rows repeat.  Rows with a null doc_id and rows without words
    stay."""
    found = write_table(jaccard_components(docs, size, percent).where("doc_id is not null and n_shingles > 0"), "components")
    gone = write_table(found.where("component_id < doc_id").select("doc_id").distinct(), "gone")
    again = write_table(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    kept = _picked(docs, gone, "left_anti")
    if not again.head(1):
        return kept
    words = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    repeated = _picked(kept, again, "left_semi")
    return (_picked(kept, again, "left_anti").unionByName(repeated.where(~words))
            .unionByName(repeated.where(words).dropDuplicates(["doc_id"])))
