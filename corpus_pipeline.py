"""Corpus pipeline: stages that each read what the one before wrote.

A stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
The last one adds ``copy`` and ``place`` to the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trunkline.llm import decontaminate, jaccard_join, poisson_mix, quality_gam, suffix_dedup
from trunkline.llm.common import documents, stored

STAGES = [
    ("quality classifier", quality_gam.stage),
    ("n-gram Jaccard join", jaccard_join.stage),
    ("suffix-array dedup", suffix_dedup.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("mixing sources to target weights", poisson_mix.stage),
]

#: SQL can't express the classifier or the removal of byte runs at a bearable cost; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
