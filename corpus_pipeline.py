"""A training corpus from raw documents in five stages; each takes what the one before it kept.

All stages but the last return the columns they were given, whatever else they are called. Null texts count as empty and null ids are ids like any
other; such documents, empty and very
long ones pass through all stages whole. An empty table of documents gives an empty result; without labels nothing is toxic, without benchmark nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from volumetra.llm import decontamination, mixing, neardup, tokenids, toxicity
from volumetra.llm.common import delete, scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that it rejects go. Repeated rows are judged alike; a score at the threshold is toxic; the least text of a repeated id trains; empty texts stay."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of each group of near duplicates one document stays, that with the least id (null ids last); of rows equal in id and text the one with the least hash of all columns. Empty texts are one group."""
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that hold a copy of a test item go, and all rows with the same text. Null and empty items match nothing."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: every document as many times as the mix takes it, three times at most. A null source is one of its own; equal rows are taken together."""
    return mixing.take(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: ids written to shards and read back, one row per document: doc_id, start, n_tokens, ids_crc32. An empty text has the end id alone; null ids come last; copies get rows of their own."""
    return tokenids.encode_and_read(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix_sources),
    ("token_ids", write_token_ids)]

#: Signatures, a trained classifier and a tokenizer are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next; what a stage wrote on its way and the input it no longer needs are deleted."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(table(stage(spark, docs, sf_dir), f"stage-{name}"))
        if last is not None:
            delete(spark, last)
        last = docs.table_path
    return STAGES[-1][1](spark, docs, sf_dir)
