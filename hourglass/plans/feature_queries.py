"""Feature queries (F1-F11) and the flagship hourly feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import round6
from ..operators.features import calendar_features
from ..operators.order import lag_columns
from . import views
from .catalog import register
from .oracle import with_views

CAL_SQL = """CAST(hour({t}) AS BIGINT) AS hour, CAST(isodow({t}) - 1 AS BIGINT) AS dayofweek,
  CAST(month({t}) AS BIGINT) AS month, CAST(CASE WHEN isodow({t}) IN (6, 7) THEN 1 ELSE 0 END AS BIGINT) AS is_weekend"""


def hourly_features_df(spark, sf_dir):
    """Minimum slice: hourly counts on the full grid -> calendar -> lags 1, 24, 168
    -> prior rolling mean 24 -> drop incomplete rows."""
    h = views.hourly(spark, sf_dir).select("hour_ts", "hour_idx", "n")
    h = calendar_features(h, "hour_ts", "hourly")
    f = lag_columns(h, "hour_idx", "n", lags=[1, 24, 168], windows=[24])
    f = f.na.drop(subset=["n_lag_1", "n_lag_24", "n_lag_168", "n_rolling_mean_24"])
    return f.select("hour_ts", "n", "hour", "dayofweek", "month", "is_weekend",
                    "n_lag_1", "n_lag_24", "n_lag_168",
                    round6("n_rolling_mean_24").alias("n_rolling_mean_24"))


register("hourly_features", with_views(f"""
SELECT * FROM (
  SELECT hour_ts, n, {CAL_SQL.format(t='hour_ts')},
         lag(n, 1) OVER w AS n_lag_1, lag(n, 24) OVER w AS n_lag_24, lag(n, 168) OVER w AS n_lag_168,
         round(avg(n) OVER (ORDER BY hour_idx ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), 6) AS n_rolling_mean_24
  FROM hourly WINDOW w AS (ORDER BY hour_idx)) t
WHERE n_lag_1 IS NOT NULL AND n_lag_24 IS NOT NULL AND n_lag_168 IS NOT NULL AND n_rolling_mean_24 IS NOT NULL
""", "hourly"))(hourly_features_df)


MD5_SQL = "(CAST(('0x' || substr(md5(CAST({k} AS VARCHAR)), 1, 8)) AS BIGINT) % 100)"

# lineitem has no unique key; every column together is the total order
LI_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
            "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
LI_ORDER_SQL = ", ".join(LI_ORDER)


@register("calendar_features", """
SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month,
       CAST(day(o_orderdate) AS BIGINT) AS day, CAST(isodow(o_orderdate) - 1 AS BIGINT) AS dayofweek,
       CAST(CASE WHEN isodow(o_orderdate) IN (6, 7) THEN 1 ELSE 0 END AS BIGINT) AS is_weekend
FROM orders""")
def calendar_features_q(spark, sf_dir):
    from ..sources.tables import table
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return calendar_features(o, "o_orderdate", "daily").drop("o_orderdate")


@register("row_index", f"""
SELECT row_number() OVER (ORDER BY {LI_ORDER_SQL}) - 1 AS row_idx, {LI_ORDER_SQL} FROM lineitem""")
def row_index(spark, sf_dir):
    from ..operators.order import with_row_index
    from ..sources.tables import table
    li = table(spark, sf_dir, "lineitem").select(*LI_ORDER)
    return with_row_index(li, LI_ORDER).select("row_idx", *LI_ORDER)


@register("lag_features", f"""
SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity,
       lag(l_quantity, 1) OVER w AS l_quantity_lag_1, lag(l_quantity, 7) OVER w AS l_quantity_lag_7,
       round(avg(l_quantity) OVER (ORDER BY {LI_ORDER_SQL} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6)
         AS l_quantity_rolling_mean_3
FROM lineitem WINDOW w AS (ORDER BY {LI_ORDER_SQL})""")
def lag_features(spark, sf_dir):
    """Un-keyed lags over raw rows: distributed row index + bucketed windows."""
    from ..operators.features import add_lags
    from ..sources.tables import table
    li = table(spark, sf_dir, "lineitem").select(*LI_ORDER)
    f = add_lags(li, "l_quantity", lags=[1, 7], windows=[3], order_by=LI_ORDER)
    return f.select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_quantity_lag_1",
                    "l_quantity_lag_7", round6("l_quantity_rolling_mean_3").alias("l_quantity_rolling_mean_3"))


_LI_KEYED = [c for c in LI_ORDER if c != "l_suppkey"]


@register("lag_features_keyed", f"""
SELECT l_suppkey, l_orderkey, l_linenumber, l_shipdate, l_quantity,
       lag(l_quantity, 1) OVER w AS l_quantity_lag_1, lag(l_quantity, 7) OVER w AS l_quantity_lag_7,
       round(avg(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY {', '.join(_LI_KEYED)}
                                   ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS l_quantity_rolling_mean_3
FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY {', '.join(_LI_KEYED)})""")
def lag_features_keyed(spark, sf_dir):
    """Keyed lags per supplier; a hot supplier is split over buckets, not one task."""
    from ..operators.features import add_lags
    from ..sources.tables import table
    li = table(spark, sf_dir, "lineitem").select(*LI_ORDER)
    f = add_lags(li, "l_quantity", lags=[1, 7], windows=[3], order_by=_LI_KEYED, partition_by=["l_suppkey"])
    return f.select("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_quantity_lag_1",
                    "l_quantity_lag_7", round6("l_quantity_rolling_mean_3").alias("l_quantity_rolling_mean_3"))


@register("rolling_mean", with_views("""
SELECT hour_ts, n,
  round(avg(n) OVER (ORDER BY hour_idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS n_rolling_mean_3,
  round(avg(n) OVER (ORDER BY hour_idx ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 6) AS n_rolling_mean_6,
  round(avg(n) OVER (ORDER BY hour_idx ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), 6) AS n_rolling_mean_24,
  round(avg(n) OVER (ORDER BY hour_idx ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING), 6) AS n_rolling_mean_168
FROM hourly""", "hourly"))
def rolling_mean(spark, sf_dir):
    h = views.hourly(spark, sf_dir).select("hour_ts", "hour_idx", "n")
    f = lag_columns(h, "hour_idx", "n", windows=[3, 6, 24, 168])
    return f.select("hour_ts", "n", *[round6(f"n_rolling_mean_{w}").alias(f"n_rolling_mean_{w}")
                                      for w in (3, 6, 24, 168)])


@register("time_lag", """
WITH t AS (SELECT event_type, date_trunc('hour', ts) AS hour_ts, count(*) AS n FROM events GROUP BY 1, 2)
SELECT a.event_type, a.hour_ts, a.n, b.n AS n_lag_1, c.n AS n_lag_24
FROM t a LEFT JOIN t b ON b.event_type = a.event_type AND b.hour_ts = a.hour_ts - INTERVAL 1 HOUR
         LEFT JOIN t c ON c.event_type = a.event_type AND c.hour_ts = a.hour_ts - INTERVAL 24 HOUR""")
def time_lag(spark, sf_dir):
    """Gap-safe lags: hours without events of a type stay absent, so the value
    24 rows back is not the value 24 hours back."""
    from ..functions.columns import trunc_ntz
    from ..operators.features import add_lags
    ev = views.events(spark, sf_dir)
    t = ev.groupBy("event_type", trunc_ntz("ts", "hour").alias("hour_ts")).agg(F.count(F.lit(1)).alias("n"))
    return add_lags(t, "n", lags=[1, 24], mode="time", ts_col="hour_ts", partition_by=["event_type"]) \
        .select("event_type", "hour_ts", "n", "n_lag_1", "n_lag_24")


@register("label_encode", """
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 17 <> 0 THEN lang END AS lang, source FROM documents),
ml AS (SELECT lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS BIGINT) AS code
       FROM (SELECT DISTINCT lang FROM d WHERE lang IS NOT NULL) x),
ms AS (SELECT source, CAST(dense_rank() OVER (ORDER BY source) - 1 AS BIGINT) AS code
       FROM (SELECT DISTINCT source FROM d WHERE source IS NOT NULL) x)
SELECT d.doc_id, coalesce(ml.code, -1) AS lang_code, coalesce(ms.code, -1) AS source_code
FROM d LEFT JOIN ml ON ml.lang = d.lang LEFT JOIN ms ON ms.source = d.source""")
def label_encode_q(spark, sf_dir):
    from ..operators.features import label_encode
    from ..sources.tables import table
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 17 != 0, F.col("lang")).alias("lang"), "source")
    enc, _ = label_encode(d, ["lang", "source"], suffix="_code")
    return enc.select("doc_id", "lang_code", "source_code")


@register("log1p_target", with_views("""
SELECT hour_ts, round(ln(1 + n), 6) AS n_log1p, round(exp(ln(1 + n)) - 1, 6) AS n_back FROM hourly""", "hourly"))
def log1p_target(spark, sf_dir):
    from ..operators.features import expm1_col, log1p_target as lg
    h = lg(views.hourly(spark, sf_dir), "n", "n_log1p")
    h = expm1_col(h, "n_log1p", "n_back")
    return h.select("hour_ts", round6("n_log1p").alias("n_log1p"), round6("n_back").alias("n_back"))


@register("prepare_features", with_views(f"""
SELECT * FROM (
  SELECT hour_ts, n, round(avg_value, 6) AS avg_value, {CAL_SQL.format(t='hour_ts')},
         lag(n, 1) OVER w AS n_lag_1, lag(n, 24) OVER w AS n_lag_24, lag(n, 168) OVER w AS n_lag_168
  FROM hourly WINDOW w AS (ORDER BY hour_idx)) t
WHERE n_lag_1 IS NOT NULL AND n_lag_24 IS NOT NULL AND n_lag_168 IS NOT NULL AND avg_value IS NOT NULL""",
                                         "hourly"))
def prepare_features_q(spark, sf_dir):
    from ..operators.features import prepare_features
    h = views.hourly(spark, sf_dir)
    f = prepare_features(h, target="n", ts="hour_ts", exclude=["casual", "registered"],
                         lags=[1, 24, 168], index_col="hour_idx")
    return f.withColumn("avg_value", round6("avg_value"))


@register("target_encode", f"""
WITH o AS (SELECT o_orderkey, o_orderpriority, o_totalprice, {MD5_SQL.format(k='o_orderkey')} < 80 AS is_train
           FROM orders),
g AS (SELECT avg(o_totalprice) AS gm FROM o WHERE is_train),
e AS (SELECT o_orderpriority, avg(o_totalprice) AS te FROM o WHERE is_train GROUP BY 1)
SELECT o.o_orderkey, o.o_orderpriority, round(coalesce(e.te, g.gm), 6) AS o_orderpriority_te
FROM o CROSS JOIN g LEFT JOIN e USING (o_orderpriority)""")
def target_encode_q(spark, sf_dir):
    from ..functions.columns import md5_bucket
    from ..operators.features import target_encode
    from ..sources.tables import table
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    train = o.where(md5_bucket("o_orderkey") < 80)
    te = target_encode(train, o, "o_orderpriority", "o_totalprice")
    return te.select("o_orderkey", "o_orderpriority", round6("o_orderpriority_te").alias("o_orderpriority_te"))


@register("interaction", with_views("""
SELECT hour_ts, CAST(hour(hour_ts) AS BIGINT) * CAST(isodow(hour_ts) - 1 AS BIGINT) AS hour_x_dayofweek,
       CAST(hour(hour_ts) AS VARCHAR) || '_' || CAST(isodow(hour_ts) - 1 AS VARCHAR) AS hour_dow
FROM hourly""", "hourly"))
def interaction_q(spark, sf_dir):
    from ..operators.features import interaction
    h = calendar_features(views.hourly(spark, sf_dir).select("hour_ts"), "hour_ts")
    h = interaction(h, "hour", "dayofweek")
    h = interaction(h, "hour", "dayofweek", out="hour_dow", numeric=False)
    return h.select("hour_ts", "hour_x_dayofweek", "hour_dow")
