"""Corpus pipeline: quality, exact dedup, near dedup, mixing, token ids.

Each stage reads what the one before kept, as a stored table.  ``run`` writes every
stage but the last as Parquet into the folder that ``spark.checkpoint.dir`` names.

Defined results, by the rules of the stages' operators: a null text is the empty text
(all empty texts are one group of copies, and an empty text is taken by the mix no time,
as its size is 0); a row without doc_id is kept like others, and of copies the largest
doc_id stays, a null one only if there is no other; repeated rows are copies, so one
stays; a very long text is processed whole; extra columns, whatever their names, pass
through all stages but the last unchanged; an empty table gives an empty table at every
stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sigwin.llm import byte_bpe, exact_dedup, mixing, ngram_join, quality
from sigwin.llm.common import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, n=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", byte_bpe_stage),
]

#: The classifier and the tokenizer are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
