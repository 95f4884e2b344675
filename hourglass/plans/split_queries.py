"""Split, fold and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import split
from ..operators.order import with_row_index
from ..sources.tables import table
from . import views
from .catalog import register
from .feature_queries import LI_ORDER, LI_ORDER_SQL, MD5_SQL
from .oracle import with_views


@register("time_split", f"""
SELECT CASE WHEN row_idx < CAST(floor(cnt * 0.8) AS BIGINT) THEN 'train' ELSE 'test' END AS role,
       row_idx, l_orderkey, l_linenumber, l_shipdate
FROM (SELECT row_number() OVER (ORDER BY {LI_ORDER_SQL}) - 1 AS row_idx, count(*) OVER () AS cnt,
             l_orderkey, l_linenumber, l_shipdate FROM lineitem) t""")
def time_split(spark, sf_dir):
    li = with_row_index(table(spark, sf_dir, "lineitem").select(*LI_ORDER), LI_ORDER)
    return split.with_split_role(li, "row_idx", 0.8).select("role", "row_idx", "l_orderkey", "l_linenumber",
                                                            "l_shipdate")


@register("hash_split", f"""
SELECT event_id, CASE WHEN {MD5_SQL.format(k='event_id')} < 80 THEN 'train' ELSE 'test' END AS role FROM events""")
def hash_split(spark, sf_dir):
    ev = views.events(spark, sf_dir).select("event_id")
    tr, te = split.hash_split(ev, "event_id", 0.8)
    return tr.withColumn("role", F.lit("train")).unionByName(te.withColumn("role", F.lit("test")))


@register("search_sample", f"""
SELECT event_id, value FROM events WHERE {MD5_SQL.format(k='event_id')} < 80
AND {MD5_SQL.format(k="('sample:' || CAST(event_id AS VARCHAR))")} < 20""")
def search_sample(spark, sf_dir):
    ev = views.events(spark, sf_dir).select("event_id", "value")
    tr, _ = split.hash_split(ev, "event_id", 0.8)
    return split.search_sample(tr, "event_id", 0.2)


_H = "CAST('0x' || substr(md5(coalesce(CAST(k AS VARCHAR), '')), 1, 8) AS BIGINT)"
_PLACE = f"({_H} % 100 * 10000 + {_H} // 100 % 10000)"


@register("hash_split_nulls", f"""
SELECT event_id, CASE WHEN {_PLACE} < 800000 THEN 'train' ELSE 'test' END AS role
FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN user_id END AS k FROM events) t""")
def hash_split_nulls(spark, sf_dir):
    """T2 by a key that is NULL in every seventh row: no row is lost."""
    ev = views.events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("k"))
    tr, te = split.hash_split(ev, "k", 0.8)
    return tr.select("event_id", F.lit("train").alias("role")).unionByName(te.select("event_id", F.lit("test").alias("role")))


@register("hash_split_fine", f"""
SELECT event_id, CASE WHEN {_PLACE} < 4000 THEN 'train' ELSE 'test' END AS role
FROM (SELECT event_id, event_id AS k FROM events) t""")
def hash_split_fine(spark, sf_dir):
    """T2 with a fraction below one percent."""
    ev = views.events(spark, sf_dir).select("event_id")
    tr, te = split.hash_split(ev, "event_id", 0.004)
    return tr.withColumn("role", F.lit("train")).unionByName(te.withColumn("role", F.lit("test")))


@register("split_complement", f"""
SELECT event_id FROM events WHERE {MD5_SQL.format(k='event_id')} >= 80""")
def split_complement(spark, sf_dir):
    """Test = all minus train, by the split's own predicate: one scan, no join."""
    return split.hash_split(views.events(spark, sf_dir).select("event_id"), "event_id", 0.8)[1]


@register("expanding_folds", with_views("""
WITH c AS (SELECT count(*) AS cnt, count(*) // 6 AS t FROM hourly)
SELECT fold, role, count(*) AS n_rows, min(hour_ts) AS first_ts, max(hour_ts) AS last_ts
FROM (SELECT f.range AS fold,
             CASE WHEN hour_idx < cnt - (5 - f.range) * t THEN 'train'
                  WHEN hour_idx < cnt - (4 - f.range) * t THEN 'test' END AS role, hour_ts
      FROM hourly, c, range(5) f) x
WHERE role IS NOT NULL GROUP BY fold, role""", "hourly"))
def expanding_folds(spark, sf_dir):
    h = views.hourly(spark, sf_dir).select("hour_ts", "hour_idx")
    m = split.fold_membership(h, "hour_idx", k=5)
    return (m.groupBy(F.col("fold").cast("bigint").alias("fold"), "role")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.min("hour_ts").alias("first_ts"),
                 F.max("hour_ts").alias("last_ts")))
