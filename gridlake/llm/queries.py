"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm import (chat_format, decontaminate, filter_audit, html_extract, importance, jaccard_join, lexical_search, packing,
                          quality_rules, secret_scan, toxicity, url_filter, warc)
from gridlake.llm.oracles import ORACLES  # noqa: F401
from gridlake.session import checkpoint_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars (and the numbers of blocks, all and main) of every page."""
    found = html_extract.extract(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_main")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from archives that
    are written below the shared folder."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex[:12]}"
    found = warc.read_records(warc.archive_pages(_table(spark, sf_dir, "pages"), folder), with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept (and the anomaly score) of every document."""
    docs = _table(spark, sf_dir, "documents")
    return quality_rules.judge_quality(docs, quality_rules.fit_rules(docs, _table(spark, sf_dir, "labels")))


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, log_weight, gumbel_key, sampled of every document."""
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation and of
    conversation -1, whose texts are control strings."""
    known = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                F.lit("</s>[INST] ok [/INST]").alias("text"))
    back = chat_format.read_back(chat_format.format_conversations(known.unionByName(odd)))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.find_toxicity(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    held = F.coalesce(toxicity.remainder(F.col("doc_id")) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(names, 256).alias("items_sha256"), "contaminated")


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base counts and digest, and all spans as text, of every document."""
    docs = _table(spark, sf_dir, "documents")
    found = secret_scan.find_secrets(docs, secret_scan.train(docs))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return packing.pack(packing.token_pieces(_table(spark, sf_dir, "documents")))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page, by the fixed rules and the words of its host."""
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    words = spark.createDataFrame([(w,) for w in url_filter.HOST_WORDS], "word string")
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), rules, words)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score: the 10 best documents of every benchmark item."""
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, filter_order, step and the counts of every step of every order of the five filters, per source."""
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {q.__name__: q for q in (
    op1_html_extraction, op2_ngram_jaccard_join, op3_warc, op4_quality_rules, op5_importance_resampling,
    op6_chat_formatting, op7_toxicity, op8_benchmark_decontamination, op9_secret_scans, op10_best_fit_packing,
    op11_url_filter, op12_lexical_search, op13_filter_audit)}
