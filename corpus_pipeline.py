"""A training corpus from ``documents``: quality rules, near-duplicate removal,
repeated-passage removal, benchmark decontamination, packing.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir)
and returns the next stage's documents (the last one: packed pieces).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hourglass.llm import common, stages

STAGES = [
    ("quality_rules", stages.quality),
    ("near_dedup", stages.near_duplicates),
    ("suffix_dedup", stages.repeated_passages),
    ("decontaminate", stages.decontaminate),
    ("pack", stages.pack),
]

#: Stages of hashing, tokenizers and packing have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written to the shared
    folder and read again as the next stage's input."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
