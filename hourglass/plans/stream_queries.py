"""Streaming queries (R2, R3), drained with an ``availableNow`` trigger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import round6
from ..session import ensure_utc, scratch_path
from ..streaming import drain, event_stream, score_hourly_stream, stream_hourly
from . import views
from .catalog import register

WATERMARK = "1 hour"


@register("stream_hourly", """
WITH agg AS (SELECT date_trunc('hour', ts) AS hour_ts, count(*) AS n,
                    count(*) FILTER (WHERE event_type IN ('view', 'click')) AS casual, avg(value) AS avg_value
             FROM events GROUP BY 1)
SELECT hour_ts, n, casual, n - casual AS registered, round(avg_value, 6) AS avg_value
FROM agg WHERE hour_ts + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events)""")
def stream_hourly_q(spark, sf_dir):
    """Events replayed as a file stream: closed hours only (window end at or
    before the watermark, i.e. the last event time minus one hour)."""
    ensure_utc(spark)
    path = f"{sf_dir}/events.parquet"  # a file or a folder of files
    stream = event_stream(spark, path, spark.read.parquet(path).schema)
    base = scratch_path(spark, "stream_hourly")
    out = drain(stream_hourly(stream, "ts", WATERMARK), f"{base}/sink", f"{base}/checkpoint")
    return out.withColumn("avg_value", round6("avg_value"))


@register("stream_score")
def stream_score_q(spark, sf_dir):
    """R2: events replayed as a file stream; every closed hour gets its lags
    from the static hourly history and is scored by a stored ridge model."""
    from ..operators import models, split
    from ..sources import artefacts
    from .model_queries import FEATURES, prepared
    ensure_utc(spark)
    p = prepared(spark, sf_dir)
    train, _ = split.time_split(p, "row_idx", 0.8)
    base = scratch_path(spark, "stream_score")
    artefacts.save_model(models.fit_linear(train, FEATURES, "n"), f"{base}/models", "model_ridge", None)
    model = artefacts.load_model(f"{base}/models", "model_ridge")
    # the stored hourly history: written once, so a micro-batch reads a small
    # table instead of re-aggregating the raw events for every lag join
    views.hourly(spark, sf_dir).select("hour_ts", "n").write.parquet(f"{base}/history")
    history = spark.read.parquet(f"{base}/history")
    path = f"{sf_dir}/events.parquet"  # a file or a folder of files
    stream = event_stream(spark, path, spark.read.parquet(path).schema)
    return drain(score_hourly_stream(stream, history, model, "ts", WATERMARK), f"{base}/sink", f"{base}/checkpoint")
