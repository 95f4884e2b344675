"""Cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import round6
from ..operators import clean
from . import views
from .catalog import register
from .oracle import with_views


def clip_rules_sql(src: str, cols, key: str, keep: str = "", clip=True, absurd=True, large=True,
                   flags=("clipped", "large")) -> str:
    """SQL form of C2 -> C3 -> C4 with thresholds from one stats row."""
    stats = ", ".join(f"quantile_cont({c}, 0.5) AS {c}_med, quantile_cont({c}, 0.99) AS {c}_p99, "
                      f"max({c}) AS {c}_max" for c in cols)
    s1 = []
    for c in cols:
        fc = f"({c}_p99 > 0 AND {c}_max > 10 * {c}_p99)" if clip else "false"
        s1.append(f"coalesce({fc} AND {c} > {c}_p99, false) AS {c}_c")
        s1.append(f"CASE WHEN coalesce({fc} AND {c} > {c}_p99, false) THEN {c}_p99 ELSE {c} END AS {c}_1")
        s1.append(f"coalesce({c}_med < 1 AND {c}_max > 50, false) AS {c}_fl" if large else f"false AS {c}_fl")
    s2 = []
    for c in cols:
        v2 = f"CASE WHEN {c}_1 > 1000 THEN NULL ELSE {c}_1 END" if absurd else f"{c}_1"
        lg = f"coalesce({c}_fl AND ({v2}) > 50, false)"
        s2.append(f"round(CASE WHEN {lg} THEN NULL ELSE {v2} END, 6) AS {c}")
        if "clipped" in flags:
            s2.append(f"{c}_c AS {c}_outlier_clipped")
        if "large" in flags:
            s2.append(f"{lg} AS {c}_outlier_large")
    keep_sel = f"{keep}, " if keep else ""
    return f"""
SELECT {key}, {keep_sel}{', '.join(s2)} FROM (
  SELECT {key}, {keep_sel}{', '.join(s1)}
  FROM {src}, (SELECT {stats} FROM {src}) st) t"""


@register("repair_target", with_views("""
SELECT hour_ts, coalesce(n, coalesce(casual, 0) + coalesce(registered, 0)) AS n FROM hourly_nulls""",
                                      "hourly_nulls"))
def repair_target(spark, sf_dir):
    h = views.hourly_nulls(spark, sf_dir)
    return clean.repair_sum(h, "n", ["casual", "registered"]).select("hour_ts", "n")


@register("clip_p99", with_views(clip_rules_sql("events_dirty", ["v", "w"], "event_id", absurd=False,
                                                large=False, flags=("clipped",)), "events_dirty"))
def clip_p99(spark, sf_dir):
    d = views.events_dirty(spark, sf_dir)
    out = clean.clip_p99(d, ["v", "w"])
    return out.select("event_id", round6("v").alias("v"), "v_outlier_clipped",
                      round6("w").alias("w"), "w_outlier_clipped")


@register("null_absurd", with_views("""
SELECT event_id, round(CASE WHEN v > 1000 THEN NULL ELSE v END, 6) AS v,
       round(CASE WHEN w > 1000 THEN NULL ELSE w END, 6) AS w FROM events_dirty""", "events_dirty"))
def null_absurd(spark, sf_dir):
    d = clean.null_above(views.events_dirty(spark, sf_dir), ["v", "w"], 1000)
    return d.select("event_id", round6("v").alias("v"), round6("w").alias("w"))


@register("null_large", with_views(clip_rules_sql("events_dirty", ["v", "w"], "event_id", clip=False,
                                                  absurd=False, flags=("large",)), "events_dirty"))
def null_large(spark, sf_dir):
    d = clean.null_large(views.events_dirty(spark, sf_dir), ["v", "w"])
    return d.select("event_id", round6("v").alias("v"), "v_outlier_large",
                    round6("w").alias("w"), "w_outlier_large")


def _with_non_finite(ev):
    eid = F.col("event_id")
    x = (F.when(eid % 13 == 0, F.lit(float("nan"))).when(eid % 17 == 0, F.lit(float("inf")))
         .when(eid % 19 == 0, F.lit(float("-inf"))).otherwise(F.col("value")))
    return ev.select("event_id", x.alias("x"))


NON_FINITE_SQL = """
  SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'nan'::DOUBLE WHEN event_id % 17 = 0 THEN 'inf'::DOUBLE
                        WHEN event_id % 19 = 0 THEN '-inf'::DOUBLE ELSE value END AS x
  FROM events"""


@register("finite_or_null", with_views("""
SELECT event_id, CASE WHEN isnan(x) OR isinf(x) THEN NULL ELSE x END AS x FROM ev_nf""",
                                       extra={"ev_nf": NON_FINITE_SQL}))
def finite_or_null(spark, sf_dir):
    return clean.finite_or_null(_with_non_finite(views.events(spark, sf_dir)), ["x"])


@register("drop_incomplete", with_views("""
SELECT hour_ts, n, round(avg_value, 6) AS avg_value FROM hourly_nulls
WHERE n IS NOT NULL AND avg_value IS NOT NULL""", "hourly_nulls"))
def drop_incomplete(spark, sf_dir):
    h = clean.drop_incomplete(views.hourly_nulls(spark, sf_dir), ["n", "avg_value"])
    return h.select("hour_ts", "n", round6("avg_value").alias("avg_value"))


@register("impute_median", with_views("""
SELECT event_id, round(coalesce(v, (SELECT median(v) FROM events_dirty)), 6) AS v,
       round(coalesce(w, (SELECT median(w) FROM events_dirty)), 6) AS w FROM events_dirty""", "events_dirty"))
def impute_median(spark, sf_dir):
    d = clean.impute_median(views.events_dirty(spark, sf_dir), ["v", "w"])
    return d.select("event_id", round6("v").alias("v"), round6("w").alias("w"))


@register("impute_missing_label", """
SELECT event_id, coalesce(CASE WHEN event_id % 23 <> 0 THEN event_type END, 'missing') AS event_type
FROM events""")
def impute_missing_label(spark, sf_dir):
    ev = views.events(spark, sf_dir)
    ev = ev.select("event_id", F.when(F.col("event_id") % 23 != 0, F.col("event_type")).alias("event_type"))
    return clean.impute_label(ev, ["event_type"])


@register("winsorize", """
WITH st AS (SELECT count(value) AS n, count(user_id) AS m FROM events),
ov AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS r FROM events WHERE value IS NOT NULL),
ou AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS r FROM events WHERE user_id IS NOT NULL),
b AS (SELECT
  (SELECT value FROM ov, st WHERE r = CAST(floor(0.01 * n) AS BIGINT)) AS v_lo,
  (SELECT value FROM ov, st WHERE r = n - CAST(floor(0.01 * n) AS BIGINT) - 1) AS v_hi,
  (SELECT user_id FROM ou, st WHERE r = CAST(floor(0.01 * m) AS BIGINT)) AS u_lo,
  (SELECT user_id FROM ou, st WHERE r = m - CAST(floor(0.01 * m) AS BIGINT) - 1) AS u_hi)
SELECT event_id, round(least(greatest(value, v_lo), v_hi), 6) AS value,
       least(greatest(user_id, u_lo), u_hi) AS user_id
FROM events, b""")
def winsorize(spark, sf_dir):
    ev = views.events(spark, sf_dir).select("event_id", "value", "user_id")
    w = clean.winsorize(ev, ["value", "user_id"], 0.01, 0.01)
    return w.select("event_id", round6("value").alias("value"), "user_id")


@register("dedup_rows", with_views("SELECT DISTINCT * FROM events_dup", "events_dup"))
def dedup_rows(spark, sf_dir):
    return clean.dedup(views.events_dup(spark, sf_dir))


def _clean_report_sql():
    after = clip_rules_sql("events_dirty", ["v", "w"], "event_id")
    parts = []
    for stage, src in (("before", "events_dirty"), ("after", "cleaned")):
        for c in ("v", "w"):
            parts.append(f"""SELECT '{stage}' AS stage, '{c}' AS "column", count({c}) AS count,
  round(min({c}), 6) AS min, round(median({c}), 6) AS median, round(max({c}), 6) AS max FROM {src}""")
    return with_views("\nUNION ALL\n".join(parts), "events_dirty", extra={"cleaned": after})


@register("clean_report", _clean_report_sql())
def clean_report(spark, sf_dir):
    d = views.events_dirty(spark, sf_dir)
    after = clean.clip_rules(d, ["v", "w"]).select("event_id", round6("v").alias("v"), round6("w").alias("w"))
    rep = clean.clean_report(d, after, ["v", "w"])
    return rep.select("stage", "column", "count", round6("min").alias("min"),
                      round6("median").alias("median"), round6("max").alias("max"))


_BASIC_CLEAN_SQL = with_views(
    """
SELECT c.event_id, TRY_CAST(r.fecha AS TIMESTAMP) AS fecha, CAST(r.hora AS BIGINT) AS hora,
       r.u_casuales, r.u_registrados,
       coalesce(r.total_alquileres, CAST(coalesce(r.u_casuales, 0) + coalesce(r.u_registrados, 0) AS DOUBLE))
         AS total_alquileres,
       c.sensacion_termica, c.sensacion_termica_outlier_clipped, c.sensacion_termica_outlier_large,
       c.velocidad_viento, c.velocidad_viento_outlier_clipped, c.velocidad_viento_outlier_large
FROM rentals_events r JOIN cleaned c USING (event_id)""", "rentals_events",
    extra={"cleaned": clip_rules_sql("rentals_events", ["sensacion_termica", "velocidad_viento"], "event_id")})


@register("basic_clean", _BASIC_CLEAN_SQL)
def basic_clean(spark, sf_dir):
    r = views.rentals_events(spark, sf_dir)
    c = clean.basic_clean(r)
    return c.select("event_id", "fecha", "hora", "u_casuales", "u_registrados", "total_alquileres",
                    round6("sensacion_termica").alias("sensacion_termica"),
                    "sensacion_termica_outlier_clipped", "sensacion_termica_outlier_large",
                    round6("velocidad_viento").alias("velocidad_viento"),
                    "velocidad_viento_outlier_clipped", "velocidad_viento_outlier_large")
