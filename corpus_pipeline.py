"""A training corpus from `documents`.

Stages: language identification (rows whose language is not identified go), SimHash near-duplicates (one document
of each group stays), benchmark decontamination (documents with a benchmark passage go), best-fit packing (the
pieces of what is left, with their places in sequences). All but the last return the columns of `documents`.

Cases: null and empty texts, and texts without a letter, go in the first stage; a null id is a document like any other
(kept as the representative of a group only if the group has no other); repeated rows are one group; texts of any
length are processed whole, and only packing cuts them; without a benchmark nothing is contaminated; no documents give no
rows; further columns, whatever their names, pass through up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshfold.llm import decontamination, language_id, packing, text_dedup
from meshfold.llm.common import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.fit_documents(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return text_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("language_id", identify_language), ("simhash_near_dedup", drop_near_duplicates), ("decontamination", decontaminate), ("best_fit_packing", pack)]
#: No stage of these can be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
