"""The training-data pipeline: five stages over ``documents``, each written and read again as the next one's input.

Defined cases: null and empty texts fail the base rules, so they go at the first stage; of rows with the same doc_id and
text, and of each group of near copies, one row stays; rows with a null doc_id are judged by the other stages, but have no
copies; other columns pass all stages but the last, whatever their names; an empty table passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlake.llm import decontaminate, jaccard_join, packing, quality_rules, secret_scan
from gridlake.session import write_table


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the isolation forest reject go."""
    rules = quality_rules.fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.keep_good(docs, rules)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard_join.first_of_each_component(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts."""
    return secret_scan.redact(docs, secret_scan.train(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the remaining texts, each with its sequence and place."""
    return packing.pack(packing.token_pieces(docs))


STAGES = [
    ("quality rules", quality_rules_stage),
    ("jaccard join", jaccard_stage),
    ("decontamination", decontaminate_stage),
    ("secret scan", secrets_stage),
    ("best-fit packing", packing_stage),
]

#: The stages use trained models and a tokeniser, which SQL cannot express; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage gives is written to the shared folder and read by the next."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        rows = stage(spark, rows, sf_dir)
        if k < len(STAGES) - 1:
            rows = write_table(rows, f"stage{k}")
    return rows
