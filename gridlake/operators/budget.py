"""Token-budget truncation of item lists and field maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions.budget import estimate_tokens
from gridlake.operators.sequence import null_safe_join, scan_sum

# Fixed values of the reference: fields kept first when a map is cut, in this order.
PRIORITY_FIELDS = ["metadata", "summary", "index", "pagination"]
# Fixed values of the reference: query-log tags.
HIGH_VOLUME_RESULTS = 50
AGGREGATION_WORDS = ["SUM", "COUNT"]


def token_totals(df: DataFrame, group: Sequence[str], text: str = "text") -> DataFrame:
    """Estimated tokens and item count per group."""
    return df.groupBy(*group).agg(F.sum(estimate_tokens(text)).cast("bigint").alias("tokens"),
                                  F.count(F.lit(1)).alias("n"))


def cut_to_tokens(text, tokens_left) -> Column:
    """F19 with a per-row budget: cut at ``4·tokens_left`` characters, back to the last space
    when it lies past half of the cut, and mark ``... [truncated]``."""
    t = F.col(text) if isinstance(text, str) else text
    n_chars = tokens_left * 4
    head = F.substring(t, F.lit(1), n_chars.cast("int"))
    last_space = F.length(head) - F.instr(F.reverse(head), " ")
    trimmed = F.when((F.instr(head, " ") > 0) & (last_space > F.floor(n_chars / 2)),
                     F.substring(head, F.lit(1), last_space)).otherwise(head)
    return F.concat(trimmed, F.lit("... [truncated]"))


def _bucket_of(order_col: str, width: int):
    return F.floor(F.col(order_col) / width).cast("bigint")


def running_budget(df: DataFrame, group: Sequence[str], order: Sequence[str], tokens: str, target: int,
                   bucket_width: int = 4096) -> DataFrame:
    """Cumulative tokens per group in ``order`` and ``kept`` = cumulative ≤ target.

    The running sum is a bucketed scan (``scan_sum``): a list is cut into buckets of
    ``bucket_width`` positions of its first (numeric) order column, so one very long list is
    spread over many tasks.  Ties in ``order`` count together, like SQL's default RANGE frame.
    """
    group, order = list(group), list(order)
    d = df.withColumn("_bucket", _bucket_of(order[0], bucket_width))
    peers = d.groupBy(*group, "_bucket", *order).agg(F.sum(tokens).alias("_peer_tok"))
    cum = scan_sum(peers, group, order, "_bucket", {"cum_tokens": (F.col("_peer_tok"), True)})
    return (null_safe_join(d, cum.select(*group, *order, "cum_tokens"), [*group, *order])
            .withColumn("kept", F.col("cum_tokens") <= target).drop("_bucket"))


def truncate_items(df: DataFrame, group: Sequence[str], order: Sequence[str], text: str, target: int,
                   bucket_width: int = 4096) -> DataFrame:
    """the reference's list truncation.  Items are kept while the running total stays
    within ``target``; the first item that overflows is cut to the tokens left (F19; with none
    left only the mark ``... [truncated]`` stays); when items follow it, one summary row per group carries
    ``_truncated_items`` and ``_total_items``.  Output: group, ``pos`` (0-based), text,
    ``is_summary``, ``_truncated_items``, ``_total_items``.  ``order`` must be unique within
    a group.  Positions and running totals are bucketed scans (a long list is spread over many
    tasks); list sizes and the first overflow are per-group aggregates joined back."""
    group, order = list(group), list(order)
    d = df.withColumn("_tok", estimate_tokens(text)).withColumn("_bucket", _bucket_of(order[0], bucket_width))
    d = scan_sum(d, group, order, "_bucket", {"pos": (F.lit(1).cast("bigint"), False), "_cum": (F.col("_tok"), True)})
    n = d.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"),
                              F.min(F.when(F.col("_cum") > target, F.col("pos"))).alias("_first_over"))
    t = null_safe_join(d, n, group).filter(F.col("_first_over").isNull() | (F.col("pos") <= F.col("_first_over")))
    is_over = F.col("pos") == F.coalesce(F.col("_first_over"), F.lit(-1))
    left = F.lit(target) - (F.col("_cum") - F.col("_tok"))
    out_text = F.when(is_over, cut_to_tokens(text, left)).otherwise(F.col(text))
    null_long = F.lit(None).cast("bigint")
    item = F.struct(F.col("pos").alias("pos"), out_text.alias(text), F.lit(False).alias("is_summary"),
                    null_long.alias("_truncated_items"), null_long.alias("_total_items"))
    summary = F.struct((F.col("pos") + 1).alias("pos"), F.lit(None).cast("string").alias(text),
                       F.lit(True).alias("is_summary"), (F.col("_n") - F.col("pos") - 1).cast("bigint").alias("_truncated_items"),
                       F.col("_n").cast("bigint").alias("_total_items"))
    rows = F.array(item, F.when(is_over & (F.col("pos") < F.col("_n") - 1), summary))
    return t.select(*group, F.inline(F.filter(rows, lambda x: x.isNotNull())))


def truncate_fields(fields: DataFrame, group: Sequence[str], field: str = "field", value: str = "value",
                    target: int = 1000) -> DataFrame:
    """the reference's map truncation, made deterministic (D23: other fields in name order).

    1. priority fields (metadata, summary, index, pagination — at most four per map) are added
       in that order when they fit: a bounded ``aggregate`` fold;
    2. all other fields, priority fields that did not fit included, follow in name order while the
       running total fits (a bucketed scan by first letter); the first that does not is cut to the
       tokens left (with none left only the mark stays) and the rest dropped;
    3. one marker row per map: ``_truncated`` true, ``_original_size``, ``_included_fields``.
    """
    group = list(group)
    f = fields.withColumn("_tok", estimate_tokens(value))
    is_pri = F.col(field).isin(PRIORITY_FIELDS)
    pri_rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITY_FIELDS]), F.col(field))
    pri = (f.filter(is_pri).groupBy(*group)
           .agg(F.array_sort(F.collect_list(F.struct(pri_rank.alias("r"), F.col(field).alias("f"), F.col("_tok").alias("t")))).alias("_p")))
    init = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<string>").alias("keep"))
    fold = F.aggregate("_p", init, lambda acc, x: F.when(
        acc["used"] + x["t"] <= target,
        F.struct((acc["used"] + x["t"]).alias("used"), F.array_append(acc["keep"], x["f"]).alias("keep"))).otherwise(acc))
    pri = pri.select(*group, fold.alias("_fold"))
    f = null_safe_join(f, pri, group, "left").withColumn("_used", F.coalesce(F.col("_fold.used"), F.lit(0)))
    first = F.coalesce(is_pri & F.array_contains(F.col("_fold.keep"), F.col(field)), F.lit(False))
    keep_pri = f.filter(first)
    others = f.filter(~first).withColumn("_bucket", F.ascii(field))
    others = scan_sum(others, group, [field], "_bucket", {"_cum": (F.col("_tok"), True)})
    others = others.withColumn("_cum", F.col("_cum") + F.col("_used"))
    over = others.groupBy(*group).agg(F.min(F.when(F.col("_cum") > target, F.col(field))).alias("_first_over"))
    others = null_safe_join(others, over, group)
    left = F.lit(target) - (F.col("_cum") - F.col("_tok"))
    is_over = F.col(field).eqNullSafe(F.col("_first_over"))
    rest = others.filter(F.col("_first_over").isNull() | (F.col(field) <= F.col("_first_over"))).withColumn(
        value, F.when(F.col("_first_over").isNotNull() & is_over, cut_to_tokens(value, left)).otherwise(F.col(value)))
    body = keep_pri.select(*group, field, value).unionByName(rest.select(*group, field, value))
    sizes = fields.groupBy(*group).agg(F.count(F.lit(1)).alias("_original_size"))
    inc = body.groupBy(*group).agg(F.count(F.lit(1)).alias("_included_fields"))
    markers = null_safe_join(sizes, inc, group, "left").select(
        *group, F.lit("_truncated").alias(field), F.lit("true").alias(value),
        F.col("_original_size").cast("bigint").alias("_original_size"),
        F.coalesce(F.col("_included_fields"), F.lit(0)).cast("bigint").alias("_included_fields"))
    return body.unionByName(markers, allowMissingColumns=True)


def query_tags(query, result_count, high_volume: int = HIGH_VOLUME_RESULTS) -> Column:
    """``high_volume_query`` when more than ``high_volume`` results; ``aggregation_query``
    when the query text contains SUM or COUNT (case-sensitive, as the reference)."""
    q = F.col(query) if isinstance(query, str) else query
    n = F.col(result_count) if isinstance(result_count, str) else result_count
    agg = F.exists(F.array(*[F.lit(w) for w in AGGREGATION_WORDS]), lambda w: F.instr(q, w) > 0)
    tags = F.array(F.when(n > high_volume, F.lit("high_volume_query")), F.when(agg, F.lit("aggregation_query")))
    return F.filter(tags, lambda x: x.isNotNull())
