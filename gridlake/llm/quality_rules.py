"""Quality rules judged by an isolation forest over rule statistics.

Each text gets its rule statistics; two base rules reject outright, and an isolation forest isolates the rest:
random splits of random statistics part an unusual document from the others after few steps, so a short mean
path is a high anomaly score.  The score above which a document goes is calibrated on labelled rows.

Words are ``[^\\x20\\x09-\\x0D]+``.  Defined cases: a null or empty text has no words and fails the base rules;
labels that are missing, null, repeated or of unknown documents are ignored (a document labelled both ways
counts as bad); without labelled rows of both kinds only the base rules reject; rows are judged one by one, so
repeated or null doc_ids, very long texts and extra columns do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import sliced
from gridlake.operators.sequence import scan_sum
from gridlake.session import write_table

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5

#: Share of good labelled rows that the forest must keep.
KEEP_GOOD = 0.998

#: The forest's statistics and the share from which a rule minds them; a statistic enters as the root of what
#: lies above its limit, so that harmless variation isolates nothing.
RULES = {"symbols": 0.02, "repeated_words": 0.15, "duplicate_lines": 0.5, "upper_case": 0.3, "marks": 0.05,
         "word_repeats_next": 0.1}
FEATURES = tuple(RULES)
LIMITS = tuple(RULES.values())

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xA0761D6478BD642F], np.uint64)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a window of ``window`` words that occurs at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    keys = np.zeros(n, np.uint64)
    for k in range(window):
        keys += ids[k:k + n] * _MIX[k]
    _, place, times = np.unique(keys, return_inverse=True, return_counts=True)
    twice = times[place] > 1
    if not twice.any():
        return 0
    marks = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + window, -1)
    return int((np.cumsum(marks) > 0).sum())


def base_stats(text: str | None) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the forest's features of a text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS.encode()))
    lines, seen, n_dup = raw.split(b"\n"), set(), 0
    n_lines = 0
    for line in lines:
        if line.strip():
            n_lines += 1
            n_dup += line in seen
            seen.add(line)
    n_repeat = repeated_words(words)
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = raw.count(b"!") + raw.count(b"?")
    letters = max(1, word_chars)
    echo = sum(a == b for a, b in zip(words, words[1:], strict=False))
    shares = (n_symbols / letters, n_repeat / max(1, n), n_dup / max(1, n_lines), upper / letters, marks / letters,
              echo / max(1, n))
    return ((n, word_chars, n_symbols, n_dup, n_repeat),
            [max(0.0, a - b) ** 0.5 for a, b in zip(shares, LIMITS, strict=True)])


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words


@dataclass
class Forest:
    """Trees as arrays [tree, node]: split feature (-1: leaf), split value, and path length at a leaf.
    The children of node k are 2k + 1 and 2k + 2; ``norm`` is the mean path length of the sample size."""

    feature: np.ndarray
    value: np.ndarray
    path: np.ndarray
    depth: int
    norm: float


def _mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a random binary tree of n rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def grow_tree(rows: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Split features, split values and path lengths of one tree over all ``rows``."""
    nodes = 2 ** (depth + 1) - 1
    feature, value, path = np.full(nodes, -1, np.int16), np.zeros(nodes), np.zeros(nodes)
    todo = [(0, 0, rows)]
    while todo:
        k, at, rows = todo.pop()
        low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
        open_ = np.flatnonzero(high > low)
        if at == depth or len(rows) <= 1 or not len(open_):
            path[k] = at + _mean_path(len(rows))
            continue
        c = int(rng.choice(open_))
        cut = rng.uniform(low[c], high[c])
        feature[k], value[k] = c, cut
        left = rows[:, c] < cut
        todo += [(2 * k + 1, at + 1, rows[left]), (2 * k + 2, at + 1, rows[~left])]
    return feature, value, path


def _depth(rows: int) -> int:
    return max(1, int(np.ceil(np.log2(max(2, rows)))))


def fit_forest(x: np.ndarray, trees: int = 128, sample: int = 256, seed: int = 0) -> Forest:
    rng = np.random.default_rng(seed)
    sample = min(sample, len(x))
    depth = _depth(sample)
    grown = [grow_tree(x[rng.choice(len(x), sample, replace=False)], depth, rng) for _ in range(trees)]
    return Forest(*(np.array(part) for part in zip(*grown, strict=True)), depth, max(_mean_path(sample), 1e-9))


def fit_forest_on_all(rows: DataFrame, n: int, trees: int = 128, least: int = 256, seed: int = 0) -> Forest:
    """A forest over every one of the ``n`` ``rows`` (doc_id, x): each is dealt to one tree, or to several until a tree has
    some ``least`` rows, and each tree is grown by a task of its own.  Only the trees, of at most ``2 * least`` nodes,
    reach the driver."""
    copies = min(trees, -(-trees * least // n))
    depth = _depth(min(least, n))
    first = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(trees))
    dealt = rows.select("x", F.explode(F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda k: F.pmod(
        first + F.floor(k * F.lit(trees / copies)), F.lit(trees)))).alias("tree"))

    def grow(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x = np.array(frame["x"].tolist(), float)
        x = x[np.lexsort(x.T)]  # the same tree however the rows were dealt
        grown = grow_tree(x, depth, np.random.default_rng([seed, int(key[0])]))
        return pd.DataFrame([(int(key[0]), *(p.tolist() for p in grown))], columns=["tree", "feature", "value", "path"])

    found = dealt.groupBy("tree").applyInPandas(grow, "tree long, feature array<int>, value array<double>, path array<double>")
    grown = sorted(found.collect(), key=lambda r: r["tree"])
    return Forest(np.array([r["feature"] for r in grown], np.int16), np.array([r["value"] for r in grown]),
                  np.array([r["path"] for r in grown]), depth, max(_mean_path(-(-n * copies // trees)), 1e-9))


def score_forest(f: Forest, x: np.ndarray) -> np.ndarray:
    """Anomaly scores in (0, 1): 2 to the minus mean path length over the expected one."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for t in range(len(f.feature)):
        at = np.zeros(len(x), np.int64)
        for _ in range(f.depth):
            c = f.feature[t, at]
            on = c >= 0
            right = x[rows, np.maximum(c, 0)] >= f.value[t, at]
            at = np.where(on, 2 * at + 1 + right, at)
        total += f.path[t, at]
    return 2.0 ** (-total / len(f.feature) / f.norm)


def calibrate(scores: np.ndarray, good: np.ndarray, keep_good: float = KEEP_GOOD) -> float:
    """The largest score a document may have: of all cuts that keep ``keep_good`` of the good rows, the one with
    the most bad rows above it less good rows above it; 1.0 (nothing goes) without rows of both kinds."""
    if not (good == 1).any() or not (good == 0).any():
        return 1.0
    cuts = np.unique(scores)
    kept = np.searchsorted(np.sort(scores[good == 1]), cuts, "right") / (good == 1).sum()
    caught = 1 - np.searchsorted(np.sort(scores[good == 0]), cuts, "right") / (good == 0).sum()
    gain = np.where(kept >= keep_good, caught - (1 - kept), -1.0)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    low, high = best[0], best[-1] + 1
    top = cuts[high] if high < len(cuts) else cuts[-1] + 1e-9
    return float((cuts[low] + top) / 2) if gain.max() > 0 else 1.0


@dataclass
class Rules:
    """What a fit gives: the forest and the largest score of a document that stays."""

    forest: Forest | None
    threshold: float


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, whether the base rules fail, and the forest's features x of each row of ``docs``."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [base_stats(t) for t in batch["text"].to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array([base_failed(b[0], b[4]) for b, _ in found], pa.bool_()),
             pa.array([x for _, x in found], pa.list_(pa.float64()))], ["doc_id", "failed", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        sliced(step), "doc_id long, failed boolean, x array<double>")


def calibrate_all(rows: DataFrame, forest: Forest, keep_good: float = KEEP_GOOD) -> float:
    """:func:`calibrate` over all ``rows`` (x, quality): running counts by score, added up in tasks."""
    sent = rows.sparkSession.sparkContext.broadcast(forest)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array(batch["x"].to_pylist(), float).reshape(-1, len(FEATURES))
        return pa.RecordBatch.from_arrays([pa.array(score_forest(sent.value, x)), batch["quality"]], ["score", "quality"])

    counts = write_table(rows.select("x", "quality").mapInArrow(sliced(step), "score double, quality int").groupBy("score").agg(
        F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")), "scores")
    n = counts.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    if not n["good"] or not n["bad"]:
        return 1.0
    run = scan_sum(counts.withColumn("_all", F.lit(0)).withColumn("_bucket", F.floor(F.col("score") * 4096)), ["_all"], ["score"],
                   "_bucket", {"n_good": (F.col("good"), True), "n_bad": (F.col("bad"), True)})
    kept, caught = F.col("n_good") / n["good"], 1 - F.col("n_bad") / n["bad"]
    gains = write_table(run.select("score", F.when(kept >= keep_good, caught - (1 - kept)).otherwise(-1.0).alias("gain")), "gains")
    top = gains.agg(F.max("gain")).first()[0]
    if top <= 0:
        return 1.0
    low, high = gains.where(F.col("gain") >= top - 1e-12).agg(F.min("score"), F.max("score")).first()
    above = gains.where(F.col("score") > high).agg(F.min("score")).first()[0]
    return float((low + (high + 1e-9 if above is None else above)) / 2)


def fit_rules(docs: DataFrame, labels: DataFrame, keep_good: float = KEEP_GOOD) -> Rules:
    """Forest and threshold from all labelled rows that the base rules do not reject.  Only the trees and the threshold
    reach the driver."""
    known = (labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.min("quality").cast("int").alias("quality")))
    kinds = {r["quality"] for r in known.select("quality").distinct().collect()}
    if len(kinds) < 2:
        return Rules(None, 1.0)
    rows = write_table(measure(docs).where(~F.col("failed")).join(known, "doc_id").select("doc_id", "x", "quality"), "measured")
    n = rows.count()
    if not n:
        return Rules(None, 1.0)
    forest = fit_forest_on_all(rows, n)
    return Rules(forest, calibrate_all(rows, forest, keep_good))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judge(texts: list, rules: Rules) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Base statistics, anomaly scores (0 without a forest), base_failed and kept of each text."""
    found = [base_stats(t) for t in texts]
    base = [b for b, _ in found]
    scores = score_forest(rules.forest, np.array([x for _, x in found])) if rules.forest and found else np.zeros(len(found))
    failed = np.array([base_failed(b[0], b[4]) for b in base], bool)
    return base, scores, failed, ~failed & (scores <= rules.threshold)


def judge_quality(docs: DataFrame, rules: Rules) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base statistics, base_failed, kept and the anomaly score."""
    sent = docs.sparkSession.sparkContext.broadcast(rules)  # at most trees * 511 nodes

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, scores, failed, kept = _judge(batch["text"].to_pylist(), sent.value)
        columns = [pa.array([b[k] for b in base], pa.int64()) for k in range(len(BASE))]
        return pa.RecordBatch.from_arrays([batch["doc_id"], *columns, pa.array(failed), pa.array(kept), pa.array(scores)],
                                          ["doc_id", *BASE, "base_failed", "kept", "anomaly"])

    schema = ("doc_id long, " + ", ".join(f"{n} long" for n in BASE)
              + ", base_failed boolean, kept boolean, anomaly double")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sliced(step), schema)


def keep_good(docs: DataFrame, rules: Rules) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep."""
    sent = docs.sparkSession.sparkContext.broadcast(rules)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(_judge(batch["text"].to_pylist(), sent.value)[3]))

    return docs.mapInArrow(sliced(step), docs.schema)
