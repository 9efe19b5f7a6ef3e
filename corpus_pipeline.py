"""The corpus pipeline: five of the training-data operators, one after another.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next one's documents. All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import decontam, linededup, packing, simhash, toxicity
from tidewell.llm.common import compact, shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects go."""
    return compact(toxicity.accepted(docs.select(COLUMNS), table(spark, sf_dir, "labels")), docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and near-repeated lines are cut from the texts."""
    return compact(linededup.deduplicated(docs.select(COLUMNS)).select(COLUMNS), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints one document stays."""
    return compact(simhash.keep_one(docs.select(COLUMNS)), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut from the texts."""
    return compact(decontam.decontaminated(docs.select(COLUMNS), table(spark, sf_dir, "benchmark")), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token pieces placed in sequences."""
    return compact(packing.packed(docs), docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(made.schema).parquet(f"{base}/{name}")
    return docs


#: A trained network and fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
