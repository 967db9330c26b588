"""Secret scans: base patterns, and character Markov models of random strings and ordinary identifiers.

Base patterns find assignments of long values, access keys and long runs of hexadecimal digits.  Beyond them,
two first-order character Markov models, one of random strings and one of ordinary identifiers, are compared by
the log-likelihood ratio of every other long token, and of its parts between equals signs and slashes; what looks
random enough is a span of kind ``random``, which may hold a shorter access key or run of digits.

Each model is the even mixture of two sources: random strings of fixed alphabets and what the base patterns find in a
bounded sample of documents; identifiers of the usual words of program names and of that sample's ordinary words, in
many styles (camel, snake and kebab case, constants, paths, media types, dates, versions, acronyms).  Counts are
turned into shares before they are mixed and smoothed, so the models do not depend on how large the sample is.  The
least ratio is set per length of token, where 0.9995 of held-out identifiers of that length stay below it, and
MARGIN above that; it is never under LEAST.

Defined cases: null or empty texts have no spans; rows are scanned one by one, so repeated or null doc_ids,
very long texts and extra columns do no harm; with no document to train from, the seeded strings alone are
used; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import hash_sample, sliced

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ASSIGN_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Tokens that the models judge: long whole runs of the letters of keys, whatever other letters stand beside them.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

#: Documents that the models may be trained on, and tokens taken from them, the longest part of a token included.
TRAIN_DOCS, TRAIN_TOKENS, TRAIN_CHARS = 4_000, 20_000, 64
#: Share of the even distribution in a model, distance of the least ratio from held-out identifiers, and its floor.
SMOOTH, MARGIN, LEAST = 0.02, 0.1, 0.3
#: Lengths of tokens from which each least ratio holds.
LENGTHS = (0, 20, 28, 44)

#: States of the models: 26 + 26 letters, 10 digits, other key characters, everything else, begin.
_STATE = {c: k for k, c in enumerate(string.ascii_letters + string.digits + "+/_=-.")}
_OTHER, _BEGIN = len(_STATE), len(_STATE) + 1
_N = _BEGIN + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base patterns, by start and kind.

    The runs of ACCESS and HEX are whole runs because both are greedy over one class, so dropping short ones
    afterwards or asking for the length at once gives the same matches."""
    out = [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    low = text.lower()
    if any(k in low for k in ASSIGN_KEYS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    return sorted((a, b, k) for a, b, k in out)


@dataclass
class Markov:
    """Log-likelihood ratio table (random over ordinary) by state and next state, and the least ratio per LENGTHS."""

    table: np.ndarray
    least: list[float]

    def ratio(self, token: str) -> float:
        """Mean log-likelihood ratio per character."""
        states = [_STATE.get(c, _OTHER) for c in token]
        return float(self.table[[_BEGIN, *states[:-1]], states].mean()) if states else 0.0

    def excess(self, token: str) -> float:
        """How far the ratio is above the least one for a token of that length."""
        return self.ratio(token) - self.least[bisect_right(LENGTHS, len(token)) - 1]


def _shares(tokens: list[str]) -> np.ndarray | None:
    """Shares of the next states of each state; None without tokens."""
    counts = np.zeros((_N, _N))
    for token in tokens:
        states = [_STATE.get(c, _OTHER) for c in token]
        np.add.at(counts, ([_BEGIN, *states[:-1]], states), 1)
    total = counts.sum(1, keepdims=True)
    return np.where(total > 0, counts / np.maximum(total, 1), 1 / _N) if tokens else None


def _log_model(*sources: list[str]) -> np.ndarray:
    """Logarithms of the even mixture of the sources' shares, smoothed."""
    shares = [s for s in map(_shares, sources) if s is not None]
    return np.log((1 - SMOOTH) * sum(shares) / len(shares) + SMOOTH / _N)


def seeded_random(count: int, seed: int = 7) -> list[str]:
    """Random strings over the usual alphabets of keys."""
    rng = np.random.default_rng(seed)
    alphabets = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/",
                 string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, "0123456789abcdef",
                 string.ascii_letters + string.digits + "_-"]
    out = []
    for k in range(count):
        letters = alphabets[k % len(alphabets)]
        out.append("".join(letters[i] for i in rng.integers(0, len(letters), int(rng.integers(16, 48)))))
    return out


#: Fixed list: words that names in programs are made of.
NAME_WORDS = (
    "account action add address admin after all app apply array async attribute author auth base batch before begin block body "
    "buffer build button by byte cache call cancel case category change channel char check child class clean clear click client "
    "close code collection color column command comment commit common complete component config connect connection constant "
    "container content context control convert copy core count create current custom data database date day default delete "
    "description detail device dialog directory disable display document domain download edit element email empty enable end "
    "entity entry error event exception execute export extension factory field file filter find first flag format found from "
    "function generate get global graph group handler hash header height host image import index info init input insert instance "
    "integer interface internal item iterator job join key label language last layer layout length level library limit line link "
    "list listener load local location lock log login loop main manager map mark master max memory menu merge message method min "
    "mode model module month move name native network new next node notification number object offset on open option order output "
    "package page parent parse part path pattern payment plugin point policy position post prefix previous process product profile "
    "property provider proxy public query queue random range read record reference region register remote remove render report "
    "request reset resource response rest result retry return role root route row rule run sample save schema scope script search "
    "section select sequence server service session set setting shape share show size sort source space start state status step "
    "stop storage store stream string style submit system table tag target task template test text thread time timeout title to "
    "token tool total trace transaction transform tree trigger type unique unit update upload url user util valid validate value "
    "variable vector version video view visible wait watch week width window with word worker write year zone").split()


def identifiers(words: list[str], count: int, seed: int) -> list[str]:
    """Identifiers made of words, in many styles."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(count):
        few = [words[i].lower() for i in rng.integers(0, len(words), 2 + k // 16 % 4)]
        title = [w.title() for w in few]
        n, d = int(rng.integers(0, 10_000)), f"{rng.integers(1970, 2040)}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}"
        out.append((
            "_".join(few), "-".join(few), "".join(title), few[0] + "".join(title[1:]), "_".join(few).upper(), "/".join(few), "/" + "/".join(few),
            f"{'_'.join(few)}_{n}", f"{d}-{'-'.join(few)}", f"{'-'.join(few)}-{d}", f"{few[0]}/x-{'-'.join(few[1:])}", "=".join(few),
            f"{few[0].upper()[:2 + n % 3]}{''.join(title)}", f"/usr/{'/'.join(few)}{n % 20}", f"https-www-{'-'.join(few)}",
            f"{''.join(title)}{n % 100}{title[0]}")[k % 16])
    return out


def fit_markov(positives: list[str], words: list[str], count: int = 16_000) -> Markov:
    """Both models, and the least ratios from ``count`` more identifiers of each source."""
    words = sorted(set(words))
    table = _log_model(seeded_random(6_000), sorted(set(positives))) - _log_model(
        identifiers(NAME_WORDS, count, 11), identifiers(words, count, 13) if words else [])
    model = Markov(table, [LEAST] * len(LENGTHS))
    held = identifiers(NAME_WORDS, count, 17) + (identifiers(words, count, 19) if words else [])
    for k, (low, high) in enumerate(zip(LENGTHS, [*LENGTHS[1:], 1 << 30], strict=True)):
        ratios = [model.ratio(t) for t in held if max(low, 16) <= len(t) < high]
        if ratios:
            model.least[k] = max(LEAST, float(np.quantile(ratios, 0.9995)) + MARGIN)
    return model


def train(docs: DataFrame, max_docs: int = TRAIN_DOCS, max_tokens: int = TRAIN_TOKENS) -> Markov:
    """Models from at most ``max_docs`` documents (smallest hash of doc_id) and ``max_tokens`` of their tokens, of which
    the first TRAIN_CHARS characters count."""
    ids = hash_sample(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(),
                      "doc_id", max_docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")

    def tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = set()
        for text in batch["text"].to_pylist():
            text = text or ""
            at, plain = 0, []
            for a, b, kind in base_spans(text):
                m = ASSIGN.match(text, a) if kind == 0 else None
                out.add((True, (m[2] if m else text[a:b]).strip("=.")[:TRAIN_CHARS]))
                plain.append(text[at:a])
                at = max(at, b)
            plain.append(text[at:])
            for part in plain:
                out.update((False, w[:TRAIN_CHARS]) for w in re.findall(r"[A-Za-z]{3,}", part))
        pairs = sorted(out)
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.bool_()),
                                           pa.array([t for _, t in pairs], pa.string())], ["random", "token"])

    found = (rows.mapInArrow(sliced(tokens), "random boolean, token string").distinct()
             .orderBy(F.desc("random"), F.xxhash64("token"), "token").limit(max_tokens).collect())
    return fit_markov([r["token"] for r in found if r["random"]], [r["token"] for r in found if not r["random"]])


def _merged(spans: list[tuple[int, int, int]]) -> list[list[int]]:
    """The places that spans in order cover, without overlaps."""
    out: list[list[int]] = []
    for a, b, _ in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _outside(a: int, b: int, cover: list[list[int]]) -> list[tuple[int, int]]:
    """The parts of a place that ``cover`` leaves."""
    out = []
    k = max(0, bisect_right(cover, [a]) - 1)
    while k < len(cover) and cover[k][0] < b:
        if cover[k][1] > a:
            if cover[k][0] > a:
                out.append((a, cover[k][0]))
            a = cover[k][1]
        k += 1
    return [*out, (a, b)] if a < b else out


def _random_parts(text: str, a: int, b: int, cover: list[list[int]], model: Markov) -> list[tuple[int, int, int]]:
    """The place itself if it looks random, also without its base spans; or else its parts that do."""
    rest = _outside(a, b, cover) if b - a >= 16 else []
    if not rest:
        return []
    if model.excess(text[a:b]) > 0 and (rest == [(a, b)] or sum(model.excess(text[x:y]) * (y - x) for x, y in rest) > 0):
        return [(a, b, 3)]
    for sign in "=/":
        if sign in text[a:b]:
            parts = [(a + m.start(), a + m.end()) for m in re.finditer(f"[^{sign}]+", text[a:b])]
            return [s for x, y in parts for s in _random_parts(text, x, y, cover, model)]
    return []


def all_spans(text: str, model: Markov) -> list[tuple[int, int, int]]:
    """Base spans and random tokens or parts of tokens, which reach into no assignment but may hold other base spans."""
    spans = base_spans(text)
    cover, assigned = _merged(spans), _merged([s for s in spans if s[2] == 0])
    out = list(spans)
    for m in TOKEN.finditer(text):
        for a, b in _outside(m.start(), m.end(), assigned):
            out += _random_parts(text, a, b, cover, model)
    return sorted(out)


def find_secrets(docs: DataFrame, model: Markov) -> DataFrame:
    """One row per row of ``docs``: doc_id and its spans (start, end, kind), code points, end exclusive."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one table of _N x _N numbers
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[{"start": a, "end": b, "kind": KINDS[k]} for a, b, k in all_spans(t or "", sent.value)]
                 for t in batch["text"].to_pylist()]
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        sliced(step), "doc_id long, spans array<struct<start:long,end:long,kind:string>>")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every secret replaced by its kind; what overlaps goes as one.  Of an assignment only the
    value goes."""
    cuts: list[list] = []
    for a, b, k in spans:
        m = ASSIGN.match(text, a) if k == 0 else None
        a = m.start(2) if m else a
        if cuts and a < cuts[-1][1]:
            cuts[-1][1] = max(cuts[-1][1], b)
        else:
            cuts.append([a, b, k])
    out, at = [], 0
    for a, b, k in cuts:
        out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Markov) -> DataFrame:
    """``docs``, all rows and columns, with secrets replaced in ``text`` (and ``n_chars`` following, if there)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch["text"].to_pylist()
        new = []
        for t in texts:
            spans = all_spans(t, sent.value) if t else []
            new.append(redacted(t, spans) if spans else t)
        k = batch.schema.get_field_index("text")
        out = batch.set_column(k, batch.schema.field(k), pa.array(new, batch.schema.field(k).type))
        if "n_chars" in batch.schema.names:
            k = batch.schema.get_field_index("n_chars")
            size = [n if a is b or b is None else len(b) for n, a, b in
                    zip(batch["n_chars"].to_pylist(), texts, new, strict=True)]
            out = out.set_column(k, batch.schema.field(k), pa.array(size, batch.schema.field(k).type))
        return out

    return docs.mapInArrow(sliced(step), docs.schema)
