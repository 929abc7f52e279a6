"""The corpus pipeline: five stages over ``documents``, each one of the operators in ``lumenrank.llm``.

Every stage gets the table that its predecessor kept, written and read again, and works on
all of it. All but the last return the columns of ``documents``.

1. Quality: documents that the classifier rejects go.
2. Lines: later copies of repeated line runs are deleted; what is then blank goes.
3. Near duplicates: one document of each class of similar texts stays (five-word grams,
   Jaccard similarity 0.8).
4. Decontamination: documents with benchmark passages go.
5. Tokens: the kept texts are encoded and decoded by the byte-level BPE ranks.

Null texts count as empty: they are judged like any text, have no lines, near duplicates or
benchmark words, and encode to no ids. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenrank.llm import bpe, decontaminate, line_dedup, near_dup, quality
from lumenrank.llm.common import documents, written


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean(docs)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.clean(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs)


STAGES = [
    ("quality classifier", accept_quality),
    ("line dedup", delete_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_class),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode_tokens),
]

#: The classifier, the near-duplicate classes and BPE are beyond SQL; the tests compare the
#: run with brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; one row of token digests per kept document."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
