"""A corpus pipeline of five stages; each reads what its predecessor kept, as written Parquet.

toxicity: documents that the severity model rejects go. near_duplicates: one document of each
class stays. decontamination: documents that hold a benchmark item go. secrets: secrets in the
texts are replaced by their kinds. bpe: the texts' token ids, and the text decoded from them.

Every stage takes empty tables, null and empty texts (they are kept, and give no tokens), texts of
any length, and columns beyond those of documents, whatever their names; all but the last return
their input's columns. Rows without an id stay, near_duplicates keeps one row of an id that
repeats, and the other stages treat each row by itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessaloom.llm import bpe, decontam, jaccard, secrets, toxicity
from tessaloom.llm.queries import tokenizer_path
from tessaloom.llm.runtime import remove, shared_folder, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("bpe", bpe_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Intermediate tables go under spark.checkpoint.dir; each is
    deleted when the next is written, the last stays."""
    top = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{top}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
