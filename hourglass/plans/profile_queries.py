"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import round6
from ..operators import profile
from ..sources.tables import table
from . import views
from .catalog import register
from .oracle import with_views

LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax"]
RENTAL_NUM = ["hora", "u_casuales", "u_registrados", "total_alquileres", "sensacion_termica", "velocidad_viento"]


def _r(df, cols):
    return df.withColumns({c: round6(c) for c in cols})


def _union(parts):
    return "\nUNION ALL\n".join(parts)


@register("null_profile", with_views(_union([
    f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL OR isnan({c})) AS n_null,
  round(count(*) FILTER (WHERE {c} IS NULL OR isnan({c})) * 100.0 / count(*), 6) AS pct_null
FROM rentals_events HAVING count(*) FILTER (WHERE {c} IS NULL OR isnan({c})) > 0"""
    if c in ("hora", "total_alquileres", "sensacion_termica", "velocidad_viento") else
    f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS n_null,
  round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 6) AS pct_null
FROM rentals_events HAVING count(*) FILTER (WHERE {c} IS NULL) > 0"""
    for c in ["event_id", "fecha"] + RENTAL_NUM]), "rentals_events"))
def null_profile(spark, sf_dir):
    return _r(profile.null_profile(views.rentals_events(spark, sf_dir)), ["pct_null"])


@register("describe", _union([f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25,
  round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max
FROM lineitem""" for c in LINEITEM_NUM]))
def describe(spark, sf_dir):
    d = profile.describe(table(spark, sf_dir, "lineitem"), LINEITEM_NUM)
    return _r(d, ["mean", "std", "min", "p25", "p50", "p75", "max"])


TOP_COLS = [("documents", "lang"), ("documents", "source"), ("orders", "o_orderpriority"), ("orders", "o_orderstatus")]


@register("top_values", _union([f"""SELECT * FROM (
  SELECT '{c}' AS "column", CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR) ASC NULLS FIRST) AS INTEGER) AS rank,
         CAST({c} AS VARCHAR) AS value, count(*) AS count,
         round(count(*) * 100.0 / (SELECT count(*) FROM {t}), 6) AS pct
  FROM {t} GROUP BY {c} ORDER BY count DESC, value ASC NULLS FIRST LIMIT 10) t_{c}""" for t, c in TOP_COLS]))
def top_values(spark, sf_dir):
    docs = profile.top_values(table(spark, sf_dir, "documents"), ["lang", "source"], 10)
    orders = profile.top_values(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], 10)
    return _r(docs.unionByName(orders), ["pct"])


def _corr_sql(src, cols, fill0=False):
    def v(c):
        return f"coalesce({c}, 0)" if fill0 else c
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            xa = f"CASE WHEN {v(a)} IS NOT NULL AND {v(b)} IS NOT NULL THEN CAST({v(a)} AS DOUBLE) END"
            xb = f"CASE WHEN {v(a)} IS NOT NULL AND {v(b)} IS NOT NULL THEN CAST({v(b)} AS DOUBLE) END"
            expr = (f"round(CASE WHEN stddev_pop({xa}) * stddev_pop({xb}) = 0 THEN NULL "
                    f"ELSE covar_pop({xa}, {xb}) / (stddev_pop({xa}) * stddev_pop({xb})) END, 6)")
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {expr} AS corr FROM {src}")
            if a != b:
                parts.append(f"SELECT '{b}' AS col_a, '{a}' AS col_b, {expr} AS corr FROM {src}")
    return _union(parts)


@register("corr_matrix", _corr_sql("lineitem", LINEITEM_NUM))
def corr_matrix(spark, sf_dir):
    return _r(profile.corr_matrix(table(spark, sf_dir, "lineitem"), LINEITEM_NUM), ["corr"])


@register("corr_matrix_fill0", with_views(_corr_sql("rentals_events", RENTAL_NUM, fill0=True), "rentals_events"))
def corr_matrix_fill0(spark, sf_dir):
    return _r(profile.corr_matrix(views.rentals_events(spark, sf_dir), RENTAL_NUM, fill=0), ["corr"])


@register("top_correlations", with_views("""
SELECT col_a, col_b, abs(corr) AS abs_corr FROM cm
WHERE col_a < col_b AND abs(corr) < 1 ORDER BY abs_corr DESC, col_a, col_b LIMIT 10""",
                                         extra={"cm": _corr_sql("lineitem", LINEITEM_NUM)}))
def top_correlations(spark, sf_dir):
    cm = profile.corr_matrix(table(spark, sf_dir, "lineitem"), LINEITEM_NUM)
    return profile.top_correlations(cm, 10)


@register("duplicate_count", with_views("""
SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c - 1) AS BIGINT) AS n_duplicates,
       round(sum(c - 1) * 100.0 / sum(c), 6) AS pct_duplicates
FROM (SELECT count(*) AS c FROM events_dup GROUP BY ALL) g""".replace("GROUP BY ALL",
                                                                     "GROUP BY event_id, ts, user_id, event_type, value"),
                                        "events_dup"))
def duplicate_count(spark, sf_dir):
    return _r(profile.duplicate_count(views.events_dup(spark, sf_dir)), ["pct_duplicates"])


@register("date_profile", with_views("""
SELECT count(*) FILTER (WHERE TRY_CAST(ts_txt AS TIMESTAMP) IS NULL) AS n_unparseable,
       min(TRY_CAST(ts_txt AS TIMESTAMP)) AS min_date, max(TRY_CAST(ts_txt AS TIMESTAMP)) AS max_date
FROM events_text_date""", "events_text_date"))
def date_profile(spark, sf_dir):
    return profile.date_profile(views.events_text_date(spark, sf_dir), "ts_txt")


@register("daily_sum", """
WITH agg AS (SELECT date_trunc('day', o_orderdate) AS day_ts, sum(o_totalprice) AS sum_o_totalprice
             FROM orders GROUP BY 1),
spine AS (SELECT unnest(generate_series(min(day_ts), max(day_ts), INTERVAL 1 DAY)) AS day_ts FROM agg)
SELECT s.day_ts, round(coalesce(a.sum_o_totalprice, 0), 6) AS sum_o_totalprice
FROM spine s LEFT JOIN agg a USING (day_ts)""")
def daily_sum(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return _r(profile.resample(o, "o_orderdate", "day", "o_totalprice", "sum"), ["sum_o_totalprice"])


@register("hourly_mean_filled", """
WITH agg AS (SELECT date_trunc('hour', ts) AS hour_ts, avg(value) AS mean_value FROM events GROUP BY 1),
spine AS (SELECT unnest(generate_series(min(hour_ts), max(hour_ts), INTERVAL 1 HOUR)) AS hour_ts FROM agg)
SELECT s.hour_ts, round(coalesce(a.mean_value, 0), 6) AS mean_value
FROM spine s LEFT JOIN agg a USING (hour_ts)""")
def hourly_mean_filled(spark, sf_dir):
    ev = views.events(spark, sf_dir)
    return _r(profile.resample(ev, "ts", "hour", "value", "mean", fill=0, out="mean_value"), ["mean_value"])


@register("mean_by_hour", """
SELECT hora, round(avg(value), 6) AS mean_value FROM (
  SELECT CASE WHEN event_id % 41 = 0 THEN NULL ELSE CAST(hour(ts) AS BIGINT) END AS hora, value FROM events) e
WHERE hora IS NOT NULL GROUP BY hora""")
def mean_by_hour(spark, sf_dir):
    ev = views.events(spark, sf_dir)
    ev = ev.select(F.when(F.col("event_id") % 41 != 0, F.hour("ts").cast("bigint")).alias("hora"), "value")
    g = profile.group_mean(ev, "hora", "value")
    return g.select("hora", round6("mean_value").alias("mean_value"))


@register("histogram", """
WITH st AS (SELECT min(value) AS mn, max(value) AS mx FROM events),
b AS (SELECT CAST(least(floor((value - mn) / (mx - mn) * 50), 49) AS BIGINT) AS bin, count(*) AS c
      FROM events, st WHERE value IS NOT NULL GROUP BY 1)
SELECT g.bin, round(mn + g.bin * ((mx - mn) / 50), 6) AS lo, round(mn + (g.bin + 1) * ((mx - mn) / 50), 6) AS hi,
       coalesce(b.c, 0) AS count
FROM (SELECT range AS bin FROM range(50)) g CROSS JOIN st LEFT JOIN b ON b.bin = g.bin""")
def histogram(spark, sf_dir):
    h = profile.histogram(views.events(spark, sf_dir), "value", 50)
    return _r(h, ["lo", "hi"])


@register("p99", with_views("""
SELECT 'events.value' AS "column", round(quantile_cont(value, 0.99), 6) AS p99 FROM events
UNION ALL SELECT 'hourly.n', round(quantile_cont(n, 0.99), 6) FROM hourly""", "hourly"))
def p99(spark, sf_dir):
    from ..functions.quantiles import exact_quantiles
    a = exact_quantiles(views.events(spark, sf_dir), {"value": [0.99]})["value"][0]
    b = exact_quantiles(views.hourly(spark, sf_dir), {"n": [0.99]})["n"][0]
    return spark.createDataFrame([("events.value", round(a, 6)), ("hourly.n", round(b, 6))],
                                 "column string, p99 double")


@register("box_stats", with_views(_union([f"""
SELECT '{c}' AS "column", round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
  round(min({c}) FILTER (WHERE {c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_lo,
  round(max({c}) FILTER (WHERE {c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_hi,
  count(*) FILTER (WHERE {c} IS NOT NULL AND NOT ({c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS n_outliers
FROM events_dirty, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med,
                           quantile_cont({c}, 0.75) AS q3 FROM events_dirty) q
GROUP BY q1, med, q3""" for c in ("v", "w")]), "events_dirty"))
def box_stats(spark, sf_dir):
    b = profile.box_stats(views.events_dirty(spark, sf_dir), ["v", "w"])
    return _r(b, ["q1", "median", "q3", "whisker_lo", "whisker_hi"])


@register("kde", """
WITH st AS (SELECT count(value) AS n, stddev_samp(value) AS sd, min(value) AS mn, max(value) AS mx FROM events),
bw AS (SELECT n, sd * pow(n, -0.2) AS h, mn, mx FROM st),
grid AS (SELECT range AS point, (mn - 3 * h) + ((mx + 3 * h) - (mn - 3 * h)) * range / 199 AS x, h
         FROM range(200), bw)
SELECT CAST(g.point AS BIGINT) AS point, round(g.x, 6) AS x,
       round(avg(exp(-0.5 * pow((e.value - g.x) / g.h, 2))) * (1.0 / (g.h * sqrt(2 * pi()))), 6) AS density
FROM grid g, events e WHERE e.value IS NOT NULL GROUP BY g.point, g.x, g.h""")
def kde(spark, sf_dir):
    return _r(profile.kde(views.events(spark, sf_dir), "value", 200), ["x", "density"])


@register("sum_consistency", with_views("""
SELECT 'hourly' AS "check", count(*) FILTER (WHERE n IS NOT NULL) AS n_checked,
       count(*) FILTER (WHERE n <> casual + registered) AS n_inconsistent FROM hourly
UNION ALL
SELECT 'rentals_events', count(*) FILTER (WHERE total_alquileres IS NOT NULL),
       count(*) FILTER (WHERE total_alquileres <> u_casuales + u_registrados) FROM rentals_events""",
                                        "hourly", "rentals_events"))
def sum_consistency(spark, sf_dir):
    a = profile.sum_consistency(views.hourly(spark, sf_dir), "n", ["casual", "registered"])
    b = profile.sum_consistency(views.rentals_events(spark, sf_dir), "total_alquileres",
                                ["u_casuales", "u_registrados"])
    return a.select(F.lit("hourly").alias("check"), "*").unionByName(
        b.select(F.lit("rentals_events").alias("check"), "*"))
