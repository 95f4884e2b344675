"""Scan, record and schema queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import round6
from ..operators import schema
from ..sources.tables import records_to_df
from . import views
from .catalog import register
from .oracle import with_views


@register("scan_hourly", with_views(
    "SELECT hour_ts, hour_idx, n, casual, registered, round(avg_value, 6) AS avg_value FROM hourly", "hourly"))
def scan_hourly(spark, sf_dir):
    h = views.hourly(spark, sf_dir)
    return h.withColumn("avg_value", round6("avg_value"))


@register("parse_records", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type FROM events""")
def parse_records(spark, sf_dir):
    ev = views.events(spark, sf_dir)
    return records_to_df(ev, "props", "k BIGINT", keep=["event_id", "event_type"])


@register("normalize_columns", "SELECT event_id, ts, user_id, event_type, value FROM events")
def normalize_columns(spark, sf_dir):
    ev = views.events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", "value")
    messy = ev.toDF(" Event ID", "TS ", "User Id", " Event Type ", "VALUE")
    return schema.normalize_columns(messy)


@register("detect_date_column", with_views("""
SELECT event_id, TRY_CAST(ts_txt AS TIMESTAMP) AS fecha, 'datetime' AS source_column FROM events_text_date""",
                                           "events_text_date"))
def detect_date_column(spark, sf_dir):
    d = views.events_text_date(spark, sf_dir).withColumnRenamed("ts_txt", "datetime")
    out, found = schema.detect_date_column(d)
    return out.select("event_id", "fecha", F.lit(found).alias("source_column"))


@register("parse_ts", with_views("""
SELECT event_id, TRY_CAST(ts_txt AS TIMESTAMP) AS ts FROM events_text_date""", "events_text_date"))
def parse_ts(spark, sf_dir):
    d = views.events_text_date(spark, sf_dir)
    return schema.parse_ts(d, "ts_txt", out="ts").select("event_id", "ts")


@register("narrow_integers", with_views("""
SELECT hour_ts, CAST(hour(hour_ts) AS BIGINT) AS hora, CAST(n AS BIGINT) AS n_d, round(avg_value, 6) AS avg_value
FROM hourly""", "hourly"))
def narrow_integers(spark, sf_dir):
    h = views.hourly(spark, sf_dir).select(
        "hour_ts", F.hour("hour_ts").cast("double").alias("hora"),
        F.col("n").cast("double").alias("n_d"), "avg_value")
    out = schema.narrow_integers(h)
    return out.withColumn("avg_value", round6("avg_value"))


@register("decimal_comma", with_views("""
SELECT event_id, TRY_CAST(replace(value_txt, ',', '.') AS DOUBLE) AS value_txt, amount_txt, event_type
FROM events_text_num""", "events_text_num"))
def decimal_comma(spark, sf_dir):
    return schema.strings_to_numeric(views.events_text_num(spark, sf_dir), ["value_txt", "amount_txt"])


@register("exclude_columns", with_views(
    "SELECT hour_ts, hour_idx, n, round(avg_value, 6) AS avg_value FROM hourly", "hourly"))
def exclude_columns(spark, sf_dir):
    h = schema.exclude(views.hourly(spark, sf_dir), ["casual", "registered", "not_a_column"])
    return h.withColumn("avg_value", round6("avg_value"))


EXPECTED_FEATURES = ["hour_ts", "hour", "dayofweek", "month", "is_weekend", "n_lag_1", "n_lag_24", "n_lag_168"]


@register("align_columns", with_views("""
SELECT hour_ts, CAST(hour(hour_ts) AS BIGINT) AS hour, CAST(isodow(hour_ts) - 1 AS BIGINT) AS dayofweek,
       CAST(month(hour_ts) AS BIGINT) AS month,
       CAST(CASE WHEN isodow(hour_ts) IN (6, 7) THEN 1 ELSE 0 END AS BIGINT) AS is_weekend,
       coalesce(lag(n, 1) OVER (ORDER BY hour_idx), 0) AS n_lag_1, 0 AS n_lag_24, 0 AS n_lag_168
FROM hourly""", "hourly"))
def align_columns(spark, sf_dir):
    from ..operators.features import calendar_features
    from ..operators.order import lag_columns
    h = views.hourly(spark, sf_dir).select("hour_ts", "hour_idx", "n")
    f = lag_columns(calendar_features(h, "hour_ts"), "hour_idx", "n", lags=[1])
    return schema.align_columns(f, EXPECTED_FEATURES, fill=0)


@register("known_target", with_views("SELECT hour_ts, n FROM hourly_nulls WHERE n IS NOT NULL", "hourly_nulls"))
def known_target(spark, sf_dir):
    return schema.known_target(views.hourly_nulls(spark, sf_dir), "n").select("hour_ts", "n")


@register("head_ordered", """
SELECT * FROM (SELECT 'head' AS part, event_id, ts, value FROM events ORDER BY ts, event_id LIMIT 10)
UNION ALL
SELECT * FROM (SELECT 'tail' AS part, event_id, ts, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 10)""")
def head_ordered(spark, sf_dir):
    ev = views.events(spark, sf_dir).select("event_id", "ts", "value")
    head = schema.head_ordered(ev, ["ts", "event_id"], 10).select(F.lit("head").alias("part"), "*")
    tail = schema.head_ordered(ev, ["ts", "event_id"], 10, tail=True).select(F.lit("tail").alias("part"), "*")
    return head.unionByName(tail)


@register("schema_profile", """
WITH d AS (SELECT column_name, column_type, row_number() OVER () - 1 AS pos FROM (DESCRIBE SELECT * FROM events))
SELECT CAST(pos AS INTEGER) AS position, column_name AS "column",
       CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
                        WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'DATE' THEN 'date'
                        WHEN 'BOOLEAN' THEN 'boolean' ELSE lower(column_type) END AS dtype,
       (SELECT count(*) FROM events) AS n_rows,
       CAST((SELECT count(*) FROM d) AS INTEGER) AS n_columns
FROM d""")
def schema_profile(spark, sf_dir):
    return schema.schema_profile(views.events(spark, sf_dir))
