"""A corpus pipeline of five stages, each written as Parquet and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ripplemark.llm.bpe import tokenise
from ripplemark.llm.decontam import decontaminate
from ripplemark.llm.jaccard import keep_first
from ripplemark.llm.pii import mask_pii
from ripplemark.llm.toxicity import keep_clean
from ripplemark.llm.words import cut

STAGES = [
    ("toxicity", keep_clean),
    ("jaccard_join", keep_first),
    ("decontamination", decontaminate),
    ("pii", mask_pii),
    ("bpe", tokenise),
]

#: SQL can express neither the trained models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, on documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
