"""The document pipeline: a fixed order of corpus operators over the documents table.

Each stage is written and read back before the next one starts. Rejected documents, lines,
copies and contaminated documents leave; the last stage packs what is left. Stages that run
Python get their texts in batches of bounded bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneleffects.llm import decontamination, jaccard_join, line_dedup, packing, quality
from paneleffects.llm.queries import tokenizer_path
from paneleffects.llm.tasks import bounded_batches, read_table
from paneleffects.sources.stages import stage_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; the model learns from the labels table."""
    bounded_batches(spark)
    model = quality.fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; n_chars follows the text."""
    bounded_batches(spark)
    kept = line_dedup.drop_repeated_lines(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        kept = kept.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))
    return kept


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the smallest doc_id; texts without words stay.

    Five words a shingle and a similarity of 0.8.
    """
    bounded_batches(spark)
    return jaccard_join.keep_one(docs, jaccard_join.Limit(5, 80, 100))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark window."""
    return decontamination.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents and their places in sequences."""
    bounded_batches(spark)
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: Segment joins, learned scores and packing have no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and reread."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{stage_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, apply) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        apply(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


PIPELINE_QUERIES = {"pipeline": run}
PIPELINE_SQL: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
