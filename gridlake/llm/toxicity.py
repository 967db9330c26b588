"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme-value statistics.

Every word has a log-odds of occurring in toxic documents.  Its rate has a Dirichlet prior centred on the rate
of the word's own beginning (six letters, then four, then the overall rate), so a rare word leans on its stem
and an unknown one has the log-odds of the stem alone.  Less a drift, the log-odds are negative on average, and
the linear-time scan of Ruzzo and Tompa finds all maximal scoring segments of a text.  By the theory of Karlin
and Altschul, a segment of score S in m words has an expected K * m * exp(-lambda * S) equals by chance; a
document's evidence is the sum of -ln P over its significant segments, and a logistic curve, fitted on labelled
rows that the log-odds have not seen, makes a score from 0 to 1 of it.

Learning uses only rows whose crc32(doc_id as text) mod 5 is not 0: remainders 1 to 3 for the log-odds, 4 for
the calibration.

Defined cases: null or empty texts have no segments and get the score of evidence 0; labels that are null,
repeated or of unknown documents are ignored (a document labelled both ways counts as toxic); without rows of
both kinds every score is the share of toxic rows seen (0 without any); a null doc_id is not held out; rows are
scored one by one, so repeated doc_ids, very long texts and extra columns do no harm.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import hash_sample, sliced
from gridlake.llm.importance import kth_largest
from gridlake.session import write_table

WORD = re.compile(r"[^\W\d_]+")

#: Labelled rows to learn from, and entries of the log-odds table: bounds of what is collected and broadcast.
MAX_LABELLED, MAX_ENTRIES = 60_000, 200_000
#: Weight of the prior, in documents; what is taken off every log-odds; largest chance of a significant segment.
PRIOR, DRIFT, SIGNIFICANT = 4.0, 1.0, 0.05
STEMS = (4, 6)


def words_of(text: str | None) -> list[str]:
    return [w.lower() for w in WORD.findall(text or "")]


def keys_of(word: str) -> list[str]:
    """Table keys from the most general to the word itself; stems end in an asterisk."""
    return [word[:n] + "*" for n in STEMS if len(word) > n] + [word]


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score), in order, by one pass."""
    found: list[list] = []  # start, end, sum before the start, sum up to the end
    total = 0.0
    for k, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        own = [k, k + 1, total, total + s]
        total += s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= own[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= own[3]:
                found.append([*own, j])
                break
            own = [found[j][0], own[1], found[j][2], own[3]]
            del found[j:]
    return [(a, b, r - left) for a, b, left, r, _ in found]


@dataclass
class Model:
    """Scores by table key, the extreme-value parameters and the logistic curve (intercept, slope)."""

    entries: dict[str, float]
    lam: float = 1.0
    k: float = 1.0
    curve: tuple[float, float] = (-50.0, 0.0)
    _known: dict[str, float] = field(default_factory=dict, repr=False)

    def word(self, word: str) -> float:
        value = self._known.get(word)
        if value is None:
            value = next((self.entries[k] for k in reversed(keys_of(word)) if k in self.entries), 0.0) - DRIFT
            if len(self._known) > 400_000:
                self._known.clear()
            self._known[word] = value
        return value

    def scores(self, words: list[str]) -> list[float]:
        """Log-odds less the drift; a word that repeats the one before it says nothing new."""
        return [-DRIFT if w == v else self.word(w) for v, w in zip([None, *words], words, strict=False)]

    def significant(self, words: list[str]) -> list[tuple[int, int, float]]:
        """(first word, last + 1, -ln of the chance) of the significant segments."""
        out = []
        for a, b, s in segments(self.scores(words)):
            expected = self.k * len(words) * np.exp(-self.lam * s)
            chance = -np.expm1(-expected)
            if chance <= SIGNIFICANT:
                out.append((a, b, float(-np.log(max(chance, 1e-300)))))
        return out

    def evidence(self, words: list[str]) -> float:
        return min(60.0, sum(x for _, _, x in self.significant(words)))

    def score(self, evidence: float) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.curve[0] + self.curve[1] * evidence, -500, 500))))


def log_odds(counts: DataFrame, toxic: int, rows: int) -> DataFrame:
    """key, odds (log-odds against the overall rate) and gain (how far they are from those of the key's stem) of
    ``counts`` (key, toxic, n: documents, all and toxic), with a key's prior taken from its stem."""
    overall = toxic / rows
    size = F.length("key") - F.col("key").endswith("*").cast("int")
    rate = lambda: (F.col("toxic") + PRIOR * F.col("prior")) / (F.col("n") + PRIOR)
    known = counts.withColumn("prior", F.lit(overall))
    for n in STEMS:
        stems = known.where(F.col("key").endswith("*") & (size == n)).select(F.col("key").alias("_stem"), rate().alias("_rate"))
        stem = F.when(size > n, F.concat(F.substring("key", 1, n), F.lit("*"))).otherwise(F.concat("key", F.lit(" ")))  # of none
        known = (known.withColumn("_stem", stem).join(stems, "_stem", "left")
                 .withColumn("prior", F.coalesce("_rate", "prior")).drop("_stem", "_rate"))
    logit = lambda p: F.log(F.least(p, F.lit(1 - 1e-6)) / (1 - F.least(p, F.lit(1 - 1e-6))))
    return known.select("key", (logit(rate()) - logit(F.lit(overall))).alias("odds"),
                        F.abs(logit(rate()) - logit(F.col("prior"))).alias("gain"))


def _lambda(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(weight * exp(root * value)) = 1, by halving."""
    if not (values > 0).any() or (values * weights).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    over = lambda x: (weights * np.exp(np.minimum(x * values, 700))).sum() > 1
    while not over(high) and high < 1e3:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if over(mid) else (mid, high)
    return (low + high) / 2


def calibrate(model: Model, held: DataFrame) -> None:
    """Sets lambda and K from the clean rows of ``held`` (toxic, text), and the curve from all.  Texts stay in the
    tasks: the driver gets how often each score of a word or a segment, rounded to 0.01, occurs, and two numbers a row."""
    spark = held.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def tally(batch: pa.RecordBatch) -> pa.RecordBatch:
        times: dict[tuple[str, float], int] = {}
        for text in batch["text"].to_pylist():
            scores = sent.value.scores(words_of(text))
            for kind, own in (("word", scores), ("segment", [s for _, _, s in segments(scores)])):
                for key in zip([kind] * len(own), np.round(own, 2).tolist(), strict=True):
                    times[key] = times.get(key, 0) + 1
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in times], pa.string()), pa.array([v for _, v in times], pa.float64()),
                                           pa.array(list(times.values()), pa.int64())], ["kind", "value", "n"])

    found = (held.where("toxic = 0").mapInArrow(sliced(tally), "kind string, value double, n long").groupBy("kind", "value")
             .agg(F.sum("n").alias("n")).orderBy("kind", "value").collect())
    values, times, scores, often = (np.array([r[c] for r in found if r["kind"] == kind], float)
                                    for kind in ("word", "segment") for c in ("value", "n"))
    if not len(values):
        values, times = np.array([-DRIFT]), np.array([1.0])
    model.lam = _lambda(values, times / times.sum())
    m = max(1.0, times.sum())
    if often.sum() >= 20:
        middle = int(np.searchsorted(often.cumsum(), often.sum() / 2))
        model.k = float(often[middle:].sum() * np.exp(model.lam * scores[middle]) / m)
    else:
        model.k = float(max(1, often.sum()) / m)
    sent = spark.sparkContext.broadcast(model)

    def weigh(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [sent.value.evidence(words_of(t)) for t in batch["text"].to_pylist()]
        return pa.RecordBatch.from_arrays([batch["toxic"], pa.array(x, pa.float64())], ["toxic", "evidence"])

    pairs = sorted((r["toxic"], r["evidence"]) for r in held.mapInArrow(sliced(weigh), "toxic int, evidence double").collect())
    if len({t for t, _ in pairs}) < 2:
        pairs += [(0, 0.0), (1, 0.0)]
    y, x = (np.array(v, float) for v in zip(*pairs, strict=True))
    design, beta = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(50):  # Newton steps with a slight pull of the slope to 0
        p = 1 / (1 + np.exp(-design @ beta))
        w = np.maximum(p * (1 - p), 1e-9)
        pull = np.diag([1e-6, 1e-2])
        beta = beta + np.linalg.solve(design.T @ (design * w[:, None]) + pull, design.T @ (y - p) - pull @ beta)
    model.curve = (float(beta[0]), float(max(beta[1], 0.0)))


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED,
          max_entries: int = MAX_ENTRIES) -> Model:
    """A model from at most ``max_labelled`` labelled rows (smallest hash of doc_id).  Document frequencies are
    counted and turned into log-odds by Spark; the driver gets all keys, however rare, and where they are more than
    ``max_entries`` those whose log-odds differ most from their stem's, which the others then have."""
    named = (labels.where("doc_id is not null and toxic in (0, 1)").where(remainder(F.col("doc_id")) != 0)
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")))
    ids = hash_sample(named, "doc_id", max_labelled)
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
            .withColumn("part", remainder(F.col("doc_id")).cast("int")).select("part", "toxic", "text"))
    seen: dict[tuple[bool, int], int] = {}
    for r in rows.groupBy((F.col("part") == 4).alias("last"), "toxic").agg(F.count("*").alias("n")).collect():
        seen[r["last"], r["toxic"]] = r["n"]
    toxic, clean = seen.get((False, 1), 0), seen.get((False, 0), 0)
    if not toxic or not clean:
        every = sum(seen.values())
        share = sum(n for (_, t), n in seen.items() if t) / every if every else 0.0
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Model({}, curve=(float(np.log(share / (1 - share))), 0.0))

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list[int]] = {}
        for t, text in zip(batch["toxic"].to_pylist(), batch["text"].to_pylist(), strict=True):
            for key in {k for w in set(words_of(text)) for k in keys_of(w)}:
                own = out.setdefault(key, [0, 0])
                own[0] += t
                own[1] += 1
        return pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array([v[0] for v in out.values()], pa.int64()),
                                           pa.array([v[1] for v in out.values()], pa.int64())], ["key", "toxic", "n"])

    counted = write_table(rows.where("part < 4").mapInArrow(sliced(keys), "key string, toxic long, n long").groupBy("key")
                          .agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")), "toxicity_counts")
    odds = write_table(log_odds(counted, toxic, toxic + clean), "toxicity_odds")
    model = Model({r["key"]: r["odds"] for r in _widest(odds, max_entries)})
    calibrate(model, rows.where("part = 4").select("toxic", "text"))
    return model


def _widest(odds: DataFrame, most: int) -> list:
    """The rows of ``odds``, or the ``most`` of largest gain (and then first key)."""
    if odds.count() <= most:
        return odds.select("key", "odds").collect()
    least = kth_largest(odds, "gain", most)
    over = odds.where(F.col("gain") > least).select("key", "odds").collect()
    return over + odds.where(F.col("gain") == least).orderBy("key").limit(most - len(over)).select("key", "odds").collect()


def find_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, score, predicted and the significant passages (start, end as code
    points of the text, end exclusive, and -ln of their chance)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most max_entries short strings and numbers
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("surprise", pa.float64())]))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = sent.value
        scores, passages = [], []
        for text in batch["text"].to_pylist():
            found = model.significant(words_of(text))
            scores.append(model.score(min(60.0, sum(x for _, _, x in found))))
            places = [m.span() for m in WORD.finditer(text)] if found else []
            passages.append([{"start": places[a][0], "end": places[b - 1][1], "surprise": x} for a, b, x in found])
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()),
             pa.array(passages, kind)], ["doc_id", "score", "predicted", "passages"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        sliced(step), "doc_id long, score double, predicted int, passages array<struct<start:long,end:long,surprise:double>>")
