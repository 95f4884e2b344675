"""Queries over missing values: NaN and inf in columns, NULL order keys, CSV
tokens, and the rental layout with a separate hour column."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import round6
from ..operators import clean, profile
from ..operators.features import one_hot, prepare_features
from ..operators.order import with_row_index
from ..operators.schema import narrow_integers
from ..session import scratch_path
from ..sources.tables import read_table, require, write_report
from . import views
from .catalog import register
from .clean_queries import _with_non_finite, clip_rules_sql
from .feature_queries import CAL_SQL
from .oracle import with_views

# the value where it is finite, by the rule of ``_with_non_finite``
FINITE_SQL = """
  SELECT event_id, CASE WHEN event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_id % 19 <> 0 THEN value END AS x FROM events"""


def _finite(sql: str) -> str:
    return with_views(sql, extra={"ev_f": FINITE_SQL})


def _dirty(spark, sf_dir):
    return _with_non_finite(views.events(spark, sf_dir))


def _rounded(df, *cols):
    return df.withColumns({c: round6(c) for c in cols})


DESCRIBE_SQL = """SELECT 'x' AS "column", count(x) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std,
  round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS p50,
  round(quantile_cont(x, 0.75), 6) AS p75, round(max(x), 6) AS max FROM ev_f"""


@register("describe_nan", _finite(DESCRIBE_SQL))
def describe_nan(spark, sf_dir):
    return _rounded(profile.describe(_dirty(spark, sf_dir), ["x"]), "mean", "std", "min", "p25", "p50", "p75", "max")


@register("report_roundtrip", _finite(DESCRIBE_SQL))
def report_roundtrip(spark, sf_dir):
    """A report table written and read back."""
    path = write_report(profile.describe(_dirty(spark, sf_dir), ["x"]), scratch_path(spark, "report"))
    return _rounded(read_table(spark, path, fmt="parquet"), "mean", "std", "min", "p25", "p50", "p75", "max")


@register("histogram_nan", _finite("""
WITH st AS (SELECT min(x) AS mn, max(x) AS mx FROM ev_f),
b AS (SELECT CAST(least(floor((x - mn) / (mx - mn) * 50), 49) AS BIGINT) AS bin, count(*) AS c
      FROM ev_f, st WHERE x IS NOT NULL GROUP BY 1)
SELECT g.bin, round(mn + g.bin * ((mx - mn) / 50), 6) AS lo, round(mn + (g.bin + 1) * ((mx - mn) / 50), 6) AS hi,
       coalesce(b.c, 0) AS count
FROM (SELECT range AS bin FROM range(50)) g CROSS JOIN st LEFT JOIN b ON b.bin = g.bin"""))
def histogram_nan(spark, sf_dir):
    return _rounded(profile.histogram(_dirty(spark, sf_dir), "x", 50), "lo", "hi")


@register("box_stats_nan", _finite("""
SELECT 'x' AS "column", round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
  round(min(x) FILTER (WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_lo,
  round(max(x) FILTER (WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_hi,
  count(*) FILTER (WHERE x IS NOT NULL AND NOT (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS n_outliers
FROM ev_f, (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3 FROM ev_f) q
GROUP BY q1, med, q3"""))
def box_stats_nan(spark, sf_dir):
    return _rounded(profile.box_stats(_dirty(spark, sf_dir), ["x"]), "q1", "median", "q3", "whisker_lo", "whisker_hi")


@register("impute_nan", _finite("""
SELECT event_id, round(coalesce(x, (SELECT median(x) FROM ev_f)), 6) AS x FROM ev_f"""))
def impute_nan(spark, sf_dir):
    return _rounded(clean.impute_median(_dirty(spark, sf_dir), ["x"]), "x")


@register("narrow_integers_nan", """
SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN user_id END AS x FROM events""")
def narrow_integers_nan(spark, sf_dir):
    """P5: one NaN doesn't keep a whole-valued column from becoming integer."""
    ev = views.events(spark, sf_dir)
    x = F.when(F.col("event_id") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("user_id").cast("double"))
    return narrow_integers(ev.select("event_id", x.alias("x")))


_RENTALS_NAN = """SELECT * REPLACE (CASE WHEN event_id % 31 <> 0 THEN sensacion_termica END AS sensacion_termica) FROM rentals_events"""


@register("basic_clean_nan", with_views("""
SELECT event_id, sensacion_termica, sensacion_termica_outlier_clipped, sensacion_termica_outlier_large FROM cleaned""",
                                        "rentals_events", extra={
    "rn": _RENTALS_NAN, "cleaned": clip_rules_sql("rn", ["sensacion_termica"], "event_id")}))
def basic_clean_nan(spark, sf_dir):
    r = views.rentals_events(spark, sf_dir)
    r = r.withColumn("sensacion_termica", F.when(F.col("event_id") % 31 == 0, F.lit(float("nan"))).otherwise(F.col("sensacion_termica")))
    return _rounded(clean.basic_clean(r), "sensacion_termica").select(
        "event_id", "sensacion_termica", "sensacion_termica_outlier_clipped", "sensacion_termica_outlier_large")


@register("read_csv_missing", """
SELECT event_id, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 THEN value END AS value,
       CASE WHEN event_id % 3 <> 0 THEN event_type END AS event_type, user_id FROM events""")
def read_csv_missing(spark, sf_dir):
    """A CSV whose cells hold ``NA``, ``NaN`` or nothing, read with inferred types."""
    eid = F.col("event_id")
    v = (F.when(eid % 5 == 0, F.lit("NA")).when(eid % 7 == 0, F.lit("NaN")).when(eid % 11 == 0, F.lit(""))
         .otherwise(F.col("value").cast("string")))
    ev = views.events(spark, sf_dir).select("event_id", v.alias("value"),
                                            F.when(eid % 3 != 0, F.col("event_type")).otherwise(F.lit("n/a")).alias("event_type"), "user_id")
    path = f"{scratch_path(spark, 'csv')}.csv"
    ev.write.option("header", "true").csv(path)
    return require(read_table(spark, path), ["event_id", "value"])


@register("row_index_nulls", """
SELECT row_number() OVER (ORDER BY t NULLS LAST, event_id) - 1 AS row_idx, event_id
FROM (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN ts END AS t FROM events) e""")
def row_index_nulls(spark, sf_dir):
    """rows without an order value come last."""
    ev = views.events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 11 != 0, F.col("ts")).alias("t"))
    return with_row_index(ev, ["t", "event_id"]).select("row_idx", "event_id")


@register("prepare_rentals", with_views(f"""
SELECT * FROM (
  SELECT hour_ts AS fecha, n AS total_alquileres, CAST(hour(hour_ts) AS DOUBLE) AS hora, {CAL_SQL.format(t='hour_ts')},
         lag(n, 1) OVER w AS total_alquileres_lag_1, lag(n, 24) OVER w AS total_alquileres_lag_24
  FROM hourly WINDOW w AS (ORDER BY hour_idx)) t
WHERE total_alquileres_lag_24 IS NOT NULL""", "hourly"))
def prepare_rentals(spark, sf_dir):
    """F9 on the rental layout (P7, D6): a text date and a whole-valued hour column give the event time."""
    h = views.hourly(spark, sf_dir)
    r = h.select(F.date_format("hour_ts", "yyyy-MM-dd").alias("fecha"), F.hour("hour_ts").cast("double").alias("hora"),
                 F.col("casual").alias("u_casuales"), F.col("registered").alias("u_registrados"), F.col("n").alias("total_alquileres"))
    return prepare_features(r, target="total_alquileres", ts="fecha", lags=[1, 24], hour_col="hora")


@register("one_hot", """
SELECT event_id, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS event_type_view,
       CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS event_type_click FROM events""")
def one_hot_q(spark, sf_dir):
    """indicator columns."""
    return one_hot(views.events(spark, sf_dir).select("event_id", "event_type"), "event_type", ["view", "click"]).drop("event_type")
