"""Token budget columns (F11-F19, F27-F29) and the model limits dimension table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the reference: model limits (context, safe buffer, output max).
MODEL_LIMITS = [
    ("sonnet-4", 200_000, 180_000, 64_000),
    ("sonnet-4-beta", 1_000_000, 950_000, 64_000),
    ("opus-4-1", 200_000, 180_000, 32_000),
]
DEFAULT_MODEL = "sonnet-4"
DEFAULT_UTILISATION = 0.8
CHARS_PER_TOKEN = 4
TRUNCATION_MARK = "... [truncated]"

# Fixed values of the reference: response profile per model family (max results, window rows, compression).
RESPONSE_PROFILES = [
    ("beta", 500, 5000, "light"),
    ("standard", 100, 1000, "medium"),
    ("opus", 100, 800, "aggressive"),
]
# Cache TTL seconds (checksum mismatch / match).
CACHE_TTL = 300
CACHE_TTL_MATCH = 600


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def estimate_tokens(text) -> Column:
    """``ceil(characters / 4)``, the reference's own rule of thumb; null text counts 0."""
    return F.ceil(F.coalesce(F.length(_c(text)), F.lit(0)) / CHARS_PER_TOKEN).cast("bigint")


def bpe_token_count(encoding: str = "cl100k_base"):
    """F11 exact form: a pandas UDF counting BPE tokens with ``tiktoken``.

    Off by default: the encoding's vocabulary must already be available locally (tiktoken's
    cache, ``TIKTOKEN_CACHE_DIR``); it is loaded once per Python worker.  Raises at call time
    when the package or vocabulary is missing, so callers fall back to :func:`estimate_tokens`.
    """
    import pandas as pd
    import tiktoken  # noqa: F401  (checked here, loaded in the workers)

    tiktoken.get_encoding(encoding)  # fails fast on the driver when the vocabulary is absent
    cache = {}

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        enc = cache.get(encoding)
        if enc is None:
            import tiktoken as tk

            enc = cache[encoding] = tk.get_encoding(encoding)
        return pd.Series([len(enc.encode(t, disallowed_special=())) if t is not None else 0 for t in texts])

    return count


def json_tokens(col) -> Column:
    """F11 + F30: tokens of a value's JSON text (non-strings are JSON-encoded first)."""
    return estimate_tokens(F.to_json(F.struct(_c(col).alias("v"))))


def model_limits(spark: SparkSession) -> DataFrame:
    """the three-row limits table (joined by broadcast: it has a fixed size)."""
    return spark.createDataFrame(MODEL_LIMITS, "model string, context bigint, safe_buffer bigint, output_max bigint")


def with_model_limits(df: DataFrame, model: str = "model") -> DataFrame:
    """limits for each row's model; an unknown model gets the default model's limits.

    Unknown names are mapped to the default before an equi join with the fixed three-row table.
    """
    known = [m for m, *_ in MODEL_LIMITS]
    key = F.when(_c(model).isin(known), _c(model)).otherwise(F.lit(DEFAULT_MODEL))
    limits = model_limits(df.sparkSession).withColumnRenamed("model", "_model_key")
    return df.withColumn("_model_key", key).join(F.broadcast(limits), "_model_key", "left").drop("_model_key")


def optimal_chunk_tokens(safe_buffer, utilisation: float = DEFAULT_UTILISATION) -> Column:
    """``int(safe_buffer · utilisation)``."""
    return F.floor(_c(safe_buffer) * utilisation).cast("bigint")


def over_limit(tokens, limit) -> Column:
    """true when the count exceeds the safe buffer."""
    return _c(tokens) > _c(limit)


def ladder_a(tokens, limit) -> Column:
    """codec by ratio to a limit: <0.5 none, <0.8 gzip, <1.0 brotli-4, else brotli-11-truncated."""
    r = _c(tokens) / _c(limit)
    return (F.when(r < 0.5, "none").when(r < 0.8, "gzip").when(r < 1.0, "brotli-4")
            .otherwise("brotli-11-truncated"))


def ladder_b(tokens, safe_buffer) -> Column:
    """F16: codec by ratio to the safe buffer: <0.5 none, <0.7 gzip, <0.9 brotli, else brotli-aggressive."""
    r = _c(tokens) / _c(safe_buffer)
    return F.when(r < 0.5, "none").when(r < 0.7, "gzip").when(r < 0.9, "brotli").otherwise("brotli-aggressive")


# Fixed values of the reference: estimated size factor per codec.
COMPRESSION_FACTORS = {"gzip": 0.7, "brotli": 0.6, "brotli-4": 0.6, "brotli-aggressive": 0.5, "brotli-11": 0.5}


def estimate_compressed(tokens, method: str) -> Column:
    """tokens after compression, truncated to an integer."""
    f = COMPRESSION_FACTORS.get(method, 1.0)
    return (_c(tokens).cast("double") * F.lit(f)).cast("bigint")


def chunks_needed(tokens, limit) -> Column:
    """``ceil(tokens / limit)``, and 1 when it fits."""
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(_c(tokens) / _c(limit)).cast("bigint"))


def truncate_text(text, target_tokens: int) -> Column:
    """text over ``target_tokens`` is cut at ``4·target`` characters, back to the last
    space when that space lies past half of the cut, and marked ``... [truncated]``."""
    t = _c(text)
    n = target_tokens * CHARS_PER_TOKEN
    cut = F.substring(t, 1, n)
    last_space = F.length(cut) - F.instr(F.reverse(cut), " ")  # 0-based index of the last space
    trimmed = F.when((F.instr(cut, " ") > 0) & (last_space > n // 2), F.substring(cut, F.lit(1), last_space)).otherwise(cut)
    return F.when(estimate_tokens(t) <= target_tokens, t).otherwise(F.concat(trimmed, F.lit(TRUNCATION_MARK)))


def response_profiles(spark: SparkSession) -> DataFrame:
    """the per-model-family response profile table."""
    return spark.createDataFrame(RESPONSE_PROFILES, "family string, max_results int, window_rows int, compression string")


def model_family(model) -> Column:
    """beta / opus / standard family of a model name."""
    m = F.lower(_c(model))
    return F.when(m.contains("beta"), "beta").when(m.contains("opus"), "opus").otherwise("standard")


def cache_control(checksum, checksum_match) -> dict[str, Column]:
    """TTL (600 s when the checksum matched, else 300 s) and cache key ``nav_{checksum}``."""
    return {"ttl": F.when(_c(checksum_match), CACHE_TTL_MATCH).otherwise(CACHE_TTL),
            "cache_key": F.concat(F.lit("nav_"), _c(checksum))}


def token_tracking(used, safe_buffer) -> dict[str, Column]:
    """tokens used, remaining = safe buffer − used, and the ladder-B codec."""
    return {"used": _c(used), "remaining": _c(safe_buffer) - _c(used), "compression": ladder_b(used, safe_buffer)}
