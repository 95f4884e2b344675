"""Model artefacts and the model registry.

A model is an MLlib ``PipelineModel`` saved under ``<models_dir>/<name>``;
its metrics are JSON rows appended under ``<models_dir>/_metrics`` and
partitioned by model name.  The registry is a Spark read of both: the
artefact list (each saved model's ``metadata`` JSON) left-joined to the
metrics, with invalid metric files surfaced through ``_corrupt_record``.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .tables import append_metrics

METRICS_DIR = "_metrics"
MAPPINGS_DIR = "_mappings"


def save_model(model: PipelineModel, models_dir: str, name: str, metrics: dict | None = None,
               mapping: DataFrame | None = None) -> str:
    """Save the fitted pipeline and append its metrics row, marked with the run's id
    and time (the registry takes a model's latest run).  ``mapping``: the label
    codes it was trained with (F7), stored beside it for scoring (D11)."""
    path = f"{models_dir.rstrip('/')}/{name}"
    # the active session is per thread; fall back to the process's session
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    model.write().overwrite().save(path)
    if mapping is not None:
        mapping.select("column", "value", "code").write.mode("overwrite").parquet(f"{models_dir.rstrip('/')}/{MAPPINGS_DIR}/{name}")
    if metrics is not None:
        row = {"model": name, "run_id": uuid.uuid4().hex, "run_ms": time.time_ns() // 1_000_000, **{k: (json.dumps(v) if isinstance(v, (dict, list)) else v)
                                 for k, v in metrics.items()}}
        append_metrics(spark.createDataFrame([row]), f"{models_dir.rstrip('/')}/{METRICS_DIR}")
    return path


def load_model(models_dir: str, name: str) -> PipelineModel:
    """Load a model by name (raises when it does not exist)."""
    return PipelineModel.load(f"{models_dir.rstrip('/')}/{name}")


def load_mapping(spark: SparkSession, models_dir: str, name: str) -> DataFrame | None:
    """The label codes stored with a model, None if it has none."""
    try:
        return spark.read.parquet(f"{models_dir.rstrip('/')}/{MAPPINGS_DIR}/{name}")
    except AnalysisException:
        return None


def model_artefacts(spark: SparkSession, models_dir: str) -> DataFrame:
    """Saved models found under ``models_dir``: name, class, Spark version, time."""
    try:
        meta = spark.read.json(f"{models_dir.rstrip('/')}/*/metadata")
    except AnalysisException:
        return spark.createDataFrame([], "model string, model_class string, saved_at_ms long")
    return meta.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/metadata/[^/]*$", 1).alias("model"),
        F.col("class").alias("model_class"), F.col("timestamp").alias("saved_at_ms"))


def model_metrics(spark: SparkSession, models_dir: str) -> DataFrame:
    """Every metrics row with the time of its run (of its file where the row
    can't be read); bad JSON kept in ``_corrupt_record``."""
    path = f"{models_dir.rstrip('/')}/{METRICS_DIR}"
    schema = "rmse double, mae double, params string, run_id string, run_ms bigint, _corrupt_record string, model string"
    at = F.coalesce("run_ms", F.unix_millis(F.col("_metadata.file_modification_time"))).alias("at_ms")
    try:
        return (spark.read.schema(schema).option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
                .select("model", "rmse", "mae", "params", "run_id", "_corrupt_record", at))
    except AnalysisException:
        return spark.createDataFrame([], "model string, rmse double, mae double, params string, run_id string, "
                                         "_corrupt_record string, at_ms bigint")


def model_registry(spark: SparkSession, models_dir: str) -> DataFrame:
    """Artefacts left-joined to the metrics of their latest run, with a status
    per model; an unreadable latest row means ``invalid metrics``, an older one doesn't count."""
    arts = model_artefacts(spark, models_dir)
    mets = model_metrics(spark, models_dir)
    row = F.struct("rmse", "mae", F.col("_corrupt_record").isNotNull().alias("invalid"))
    last = mets.groupBy("model").agg(F.max_by(row, F.struct("at_ms", "run_id")).alias("m")).select("model", "m.*")
    reg = arts.join(last, "model", "left")
    status = (F.when(F.col("invalid"), F.lit("invalid metrics"))
              .when(F.col("rmse").isNull(), F.lit("missing metrics")).otherwise(F.lit("ok")))
    return reg.select("model", "model_class", "rmse", "mae", status.alias("status"))
