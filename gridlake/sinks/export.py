"""K4: budgeted export — each item's codec chosen by its token ratio, over-budget items cut.

Spark's text writers have gzip but no Brotli, so the Brotli classes are written with gzip
(documented deviation); each written line keeps the chosen ``method``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.functions.budget import estimate_tokens, ladder_a, truncate_text

# Fixed value of the reference: an over-limit item is cut to 0.7 of the limit first.
TRUNCATE_TO = 0.7


def plan_export(items: DataFrame, text: str, limit: int) -> DataFrame:
    """Per item: ``tokens``, ``method`` (ladder A) and the ``payload`` to write (cut to
    0.7·limit tokens when the method is ``brotli-11-truncated``)."""
    tok = estimate_tokens(text)
    method = ladder_a(tok, F.lit(limit))
    cut = truncate_text(F.col(text), int(limit * TRUNCATE_TO))
    return (items.withColumn("tokens", tok).withColumn("method", method)
            .withColumn("payload", F.when(F.col("method") == "brotli-11-truncated", cut).otherwise(F.col(text))))


def write_budgeted(items: DataFrame, text: str, limit: int, path: str, ids: Sequence[str] = ()) -> None:
    """Write one JSON line per item (the ``ids`` columns, tokens, method, payload): ``none`` items uncompressed
    to ``{path}/none``, the others gzip-compressed to ``{path}/gzip``.  JSON keeps line ends inside a payload, so
    :func:`read_budgeted` gives every item back."""
    planned = plan_export(items, text, limit).select(*ids, "tokens", "method", "payload")
    planned.filter(F.col("method") == "none").write.mode("overwrite").json(f"{path}/none")
    planned.filter(F.col("method") != "none").write.mode("overwrite").option("compression", "gzip").json(f"{path}/gzip")


def read_budgeted(spark: SparkSession, path: str, ids: str = "") -> DataFrame:
    """The items of :func:`write_budgeted` (``ids``: schema of the id columns) and their ``codec``."""
    schema = ", ".join(x for x in (ids, "tokens BIGINT, method STRING, payload STRING") if x)
    parts = [spark.read.schema(schema).json(f"{path}/{c}").withColumn("codec", F.lit(c)) for c in ("none", "gzip")]
    return parts[0].unionByName(parts[1])
