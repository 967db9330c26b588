"""Importance resampling: documents drawn by the ratio of two hashed n-gram models, target over raw text.

Words and pairs of words are hashed into ``buckets`` buckets.  The raw model counts them in all documents, the
target model in documents labelled as good.  A document's log weight is the sum of the log ratios of its
n-grams; with Gumbel noise added (a function of doc_id, so the same on every run), the k largest are a sample
without replacement in proportion to the weights.  The k-th largest value is found by counting, not sorting.

Defined cases: a null or empty text has no n-grams and the weight 0; labels that are null, repeated or of unknown
documents are ignored (a document labelled both ways is not target); without target rows all weights are 0;
equal values at the threshold are all sampled; rows are judged one by one, so repeated or null doc_ids, very
long texts and extra columns do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import hash_sample, hashed_counts, sliced
from gridlake.session import write_table

#: Buckets of the models: 512 KB of counts, whatever the input.
BUCKETS = 1 << 16
#: Labelled rows that the target model may be fitted on; the raw model counts every row.
MAX_TARGET = 100_000


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def ngram_buckets(text: str | None, known: dict, buckets: int) -> np.ndarray:
    """The bucket of every word and of every pair of neighbouring words of a text (A-Z in lower case)."""
    words = (text or "").encode().lower().split()
    ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    pairs = ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    return (np.concatenate([ids, pairs ^ (pairs >> np.uint64(32))]) & np.uint64(buckets - 1)).astype(np.int64)


def ngram_counts(docs: DataFrame, buckets: int) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        known, total = _Ids(), np.zeros(buckets, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                found = [ngram_buckets(t, known, buckets) for t in batch["text"].slice(k, 512).to_pylist()]
                if found:
                    total += np.bincount(np.concatenate(found), minlength=buckets)
        return total

    return hashed_counts(docs.select("text"), count, buckets)


def target_ids(labels: DataFrame, max_target: int = MAX_TARGET) -> tuple[set, float]:
    """doc_ids labelled as good (at most ``max_target``, smallest hash of doc_id), and the share of good labels."""
    named = (labels.where("doc_id is not null and quality in (0, 1)")
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")))
    share = named.agg(F.avg("quality")).first()[0]
    ids = hash_sample(named.where("quality = 1").select("doc_id"), "doc_id", max_target)
    return {r["doc_id"] for r in ids.collect()}, 1.0 if share is None else float(share)


def log_weight(own: np.ndarray, target: np.ndarray, raw: np.ndarray, in_target: bool) -> float:
    """Sum of the log ratios, target over raw, of a text's n-grams (given as buckets).

    The text's own n-grams are taken out of the counts that hold them, else a text would speak for itself.  Both
    models are smoothed by the raw rates, so an unseen bucket is even."""
    if not len(own) or not target.any():
        return 0.0
    bucket, times = np.unique(own, return_counts=True)
    out = times if in_target else 0
    rate = (np.maximum(raw[bucket] - times, 0) + 0.5) / (raw[-1] - len(own) + 0.5 * (len(raw) - 1))
    strength = 8.0 * (len(raw) - 1)
    seen = np.maximum(target[bucket] - out, 0)
    return float((times * np.log((seen + strength * rate) / (target[-1] - np.sum(out) + strength) / rate)).sum())


def log_weights(docs: DataFrame, target: np.ndarray, raw: np.ndarray, target_ids: set) -> DataFrame:
    """doc_id and log_weight of every row."""
    tables = [np.append(t, t.sum()) for t in (target, raw)]  # the last entry is the total
    sent = docs.sparkSession.sparkContext.broadcast((*tables, target_ids))  # a number per bucket; a bounded set
    known: list[_Ids] = []

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not known:
            known.append(_Ids())
        target, raw, ids = sent.value
        values = [log_weight(ngram_buckets(t, known[0], len(raw) - 1), target, raw, i in ids)
                  for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(values, pa.float64())], ["doc_id", "log_weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        sliced(step), "doc_id long, log_weight double")


def gumbel(key: Column, seed: int) -> Column:
    """Standard Gumbel noise as a function of ``key``."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 2_048) -> float:
    """The k-th largest value of a column without nulls, by counting into ever finer bins: each round brings at most
    ``bins`` counts to the driver and narrows the range by that factor."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    left = k
    while low < high:
        step = (high - low) / bins
        if step <= abs(high) * 1e-15 + 1e-300:
            break
        place = F.least(F.floor((F.col(column) - low) / step), F.lit(bins - 1)).cast("int")
        found = (df.where(F.col(column).between(low, high)).groupBy(place.alias("bin"))
                 .agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect())
        for r in sorted(found, key=lambda r: -r["bin"]):
            if left <= r["n"]:
                low, high = r["low"], r["high"]
                break
            left -= r["n"]
    return low


def resample(docs: DataFrame, labels: DataFrame, fraction: float | None = None, buckets: int = BUCKETS,
             seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: doc_id, log_weight, gumbel_key and sampled.  ``fraction`` of the rows are
    sampled; by default the share of good rows among the labelled ones."""
    chosen, share = target_ids(labels)
    ids = docs.sparkSession.createDataFrame([(i,) for i in sorted(chosen)], "doc_id long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    target = ngram_counts(rows.join(F.broadcast(ids), "doc_id"), buckets)
    scored = log_weights(rows, target, ngram_counts(rows, buckets), chosen)
    scored = scored.withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("doc_id"), seed))
    scored = write_table(scored, "weights")
    k = int(round((share if fraction is None else fraction) * scored.count()))
    if k <= 0:
        return scored.withColumn("sampled", F.lit(False))
    return scored.withColumn("sampled", F.col("gumbel_key") >= F.lit(kth_largest(scored, "gumbel_key", k)))
