"""Stages of corpus_pipeline: each takes (spark, docs, sf_dir) and returns a
DataFrame with the columns of ``docs`` (the last one: packed pieces)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate as contaminated, host_quality, near_dedup, packing, suffix_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep and whose host is kept."""
    return host_quality.judge(docs).where("_hgl_kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    return near_dedup.groups(docs).where("_hgl_kept").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur earlier; one of which nothing is left goes."""
    out = suffix_dedup.cut_repeats(docs).where("_hgl_n_removed = 0 or _hgl_n_removed < _hgl_n_bytes")
    changed = {"text": F.col("_hgl_kept_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_hgl_n_removed") > 0, F.char_length("_hgl_kept_text").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return contaminated.remove(docs, common.table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their token ids, in sequences of at most 4096 tokens."""
    return packing.pack(docs, keep_ids=True)
