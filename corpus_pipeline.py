"""A training-data pipeline: five stages over the table documents, each written before the next reads it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ticklattice.llm import bpe, leaks, minmax, secrets, toxicity
from ticklattice.llm.common import shared_folder, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("near_duplicates", minmax.stage),
    ("decontamination", leaks.stage),
    ("secrets", secrets.stage),
    ("tokens", bpe.stage),
]

#: The classifiers have no SQL; the stages are tested against plain forms of them instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
