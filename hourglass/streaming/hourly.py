"""Structured Streaming forms of hourly resampling (R3) and scoring (R2).

Both are ordinary streaming DataFrames: a file (or Kafka) source, a
watermark on event time, a tumbling one-hour window with append output (a
window is emitted once, when the watermark passes its end, and its state is
then dropped), and a file sink with a checkpoint so a restarted query resumes
exactly where it stopped.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.views import CASUAL_TYPES


def event_stream(spark: SparkSession, directory: str, schema: StructType,
                 file_glob: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming read of Parquet files as they land in ``directory``: a table's
    folder, or one file (then its folder is watched for files of that name)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    if not file_glob and path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        directory, file_glob = path.getParent().toString(), path.getName()
    r = spark.readStream.schema(schema)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(directory)


def stream_hourly(stream: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Hourly n / casual / registered / avg_value per closed event-time hour.

    Zone-less timestamps are cast to TIMESTAMP for the watermark (session zone
    UTC) and the window start is cast back, so the hours equal the batch ones.
    """
    t = F.col(ts).cast("timestamp")
    s = stream.withColumn("_et", t).withWatermark("_et", delay)
    agg = (s.groupBy(F.window("_et", "1 hour").alias("w"))
           .agg(F.count(F.lit(1)).alias("n"),
                F.count_if(F.col("event_type").isin(*CASUAL_TYPES)).alias("casual"),
                F.avg("value").alias("avg_value")))
    return agg.select(F.col("w.start").cast("timestamp_ntz").alias("hour_ts"), "n", "casual",
                      (F.col("n") - F.col("casual")).alias("registered"), "avg_value")


def score_stream(stream: DataFrame, model: PipelineModel, keep=("hour_ts",)) -> DataFrame:
    """R2: apply a fitted pipeline to a stream of feature rows (stateless)."""
    out = model.transform(stream)
    return out.select(*keep, "pred")


def score_hourly_stream(events: DataFrame, history: DataFrame, model: PipelineModel, ts: str = "ts",
                        delay: str = "1 hour", lags=(1, 24, 168)) -> DataFrame:
    """R2 (D12): score each closed event-time hour of an event stream with a
    stored model.  R3's hourly counts get their lags from the static history
    (not zeros, not arbitrary state) and the calendar features of the hour;
    hours whose lags are not all known yet are not scored."""
    from ..operators.features import calendar_features, history_lags
    h = history_lags(stream_hourly(events, ts, delay), history, "n", lags)
    f = calendar_features(h, "hour_ts", "hourly")
    complete = F.lit(True)
    for lag in lags:
        complete = complete & F.col(f"n_lag_{lag}").isNotNull()
    return model.transform(f.where(complete)).select("hour_ts", "pred")


def drain(df: DataFrame, sink: str, checkpoint: str, output_mode: str = "append") -> DataFrame:
    """Run a streaming DataFrame over everything available now into a Parquet
    sink (with its checkpoint) and return the sink as a batch DataFrame."""
    q = (df.writeStream.format("parquet").outputMode(output_mode)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink))
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    # the schema is given: a sink without rows is an empty table of the same columns
    return df.sparkSession.read.schema(df.schema).parquet(sink)
