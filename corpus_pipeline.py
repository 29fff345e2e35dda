"""A corpus pipeline of the operators in ``tracelake.llm``.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``. Near duplicates
are documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import decontaminate, jaccard, packing, pii, quality
from tracelake.llm.common import discard, materialise, table

PACKING_TOKENIZER = "byte_bpe_50k.json"
#: Pieces that a worker remembers; other stages share the executors' memory with it.
PACKING_MEMO = 300_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and empty texts are rejected as too short; repeated rows are judged each."""
    return quality.keep_good(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Documents without words and rows of null ids stay; of rows that repeat an id one stays.
    """
    return jaccard.keep_one(docs, n=5, num=80, den=100)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark. Null and empty texts are clean; repeated rows are judged each."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text. Null texts stay null, with a null n_chars."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed by source. Null texts are empty and have their end id; null sources are one queue."""
    return packing.pack(docs, public_tokenizers.path(PACKING_TOKENIZER), memo=PACKING_MEMO)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: Set joins to a fixed point, suffix arrays and tokenizers have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents`` in turn; what a stage keeps is written before the next reads it, and deleted after."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
            if before is not None:
                discard(before)
            before = docs
    return docs
