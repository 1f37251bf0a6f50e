"""From raw documents to packed training sequences, stage by stage.

Each stage works on all that the one before kept, and its output is written as Parquet and
read again; all but the last return the columns of documents. No stage can be said whole in
SQL (the join's components and the field's spans are iterative or learned), so ORACLE_SQL is None and the
stages are tested against brute-force versions.

Defined results for odd input: a null or empty text is rejected by the quality stage; should later stages meet one, it
stays as it is (null stays null) and the packing stage takes it as empty, which is its end id alone. A null doc_id is kept; of rows equal in doc_id and text the
near-duplicate stage keeps one, and of each group of near copies the first by doc_id (nulls last), then by a hash of its text. A null source is a host of its own.
Very long texts are one chunk of work each. An empty table gives an empty result of the same columns. Columns beyond those of documents
are kept by all stages but the last, whatever their names, and n_chars is counted anew where it is there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.llm import jaccard, linededup, packing, pii, quality
from textloom.llm.common import materialise

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ORACLE_SQL: str | None = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean_documents(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.cut_documents(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one_of_each(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("personal data", personal_data_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
