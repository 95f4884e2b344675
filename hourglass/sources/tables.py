"""Scans and sinks.

Reads are lazy DataFrames: column pruning and filter pushdown reach the
Parquet scan because nothing here materialises data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, StructField, StructType

from ..functions.columns import as_number, finite

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables: ``<sf_dir>/<name>.parquet``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Texts that mean "missing" in a CSV cell.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-NaN", "-nan", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _typed(text: DataFrame, schema: StructType | None) -> DataFrame:
    """Text columns with the missing tokens as NULL, cast to ``schema`` or to what all
    their values parse as (BIGINT, DOUBLE, else text; one aggregate pass)."""
    clean = text.select(*[F.when(~F.trim(F.col(f"`{c}`")).isin(*NULL_TOKENS), F.col(f"`{c}`")).alias(c) for c in text.columns])
    if schema is not None:
        return finite(clean.select(*[(as_number(F.col(f"`{f.name}`"), f.dataType) if isinstance(f.dataType, NumericType) else
                                      F.col(f"`{f.name}`").try_cast(f.dataType)).alias(f.name) for f in schema.fields]))
    bad = clean.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & as_number(F.col(f"`{c}`"), t).isNull()).alias(f"{t}{i}")
                      for i, c in enumerate(clean.columns) for t in ("bigint", "double")]).first()

    def kind(i):
        return next((t for t in ("bigint", "double") if bad[f"{t}{i}"] == 0), "string")
    return finite(clean.select(*[F.col(f"`{c}`").cast(kind(i)).alias(c) for i, c in enumerate(clean.columns)]))


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None,
               fmt: str | None = None, header: bool = True) -> DataFrame:
    """Read a CSV (header, declared or inferred schema), Parquet or JSON table.

    A missing path raises ``AnalysisException`` from ``spark.read`` itself.
    Inference is used only when no schema is given (it costs an extra pass).  CSV
    cells with a missing token (``NA``, ``NaN``, empty, ...) are NULL, as are NaN and inf.
    """
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else
                  "json" if path.rstrip("/").endswith((".json", ".jsonl")) else "csv")
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    if fmt == "csv":
        text = spark.read.option("header", str(header).lower())
        if schema is not None:
            text = text.schema(StructType([StructField(f.name, StringType()) for f in schema.fields]))
        return _typed(text.csv(path), schema)
    reader = spark.read.format(fmt)
    return finite((reader.schema(schema) if schema is not None else reader).load(path))


def records_to_df(df: DataFrame, json_col: str, schema: StructType | str,
                  keep: list[str] | None = None) -> DataFrame:
    """S3: turn a column of JSON records into typed columns (one row per record).

    Works the same on a batch or a streaming DataFrame; keys absent from a
    record become NULL, malformed records give all-NULL fields.
    """
    parsed = F.from_json(F.col(json_col), schema).alias("_rec")
    out = df.select(*(keep or []), parsed)
    return out.select(*(keep or []), "_rec.*")


def require(df: DataFrame, cols) -> DataFrame:
    """Fail at plan time when a required column is missing."""
    missing = [c for c in ([cols] if isinstance(cols, str) else cols) if c not in df.columns]
    if missing:
        raise KeyError(f"required column(s) missing: {missing}")
    return df


def write_report(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Write a report table (profile, null counts, correlations, ...)."""
    df.write.mode(mode).format(fmt).save(path)
    return path


def append_metrics(df: DataFrame, path: str, partition_by: str | None = "model") -> str:
    """Append one metrics row per run, as JSON, partitioned by model name."""
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.json(path)
    return path
