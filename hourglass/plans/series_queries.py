"""Queries on the series' state, Gram matrices and model versions (R2, R3, M3, M8, M10, M-AUD)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.columns import round6
from ..operators import gram, models
from ..operators.features import prepare_features
from ..operators.order import lag_columns
from ..session import ensure_utc, scratch_path
from ..sources import artefacts, versions
from ..streaming import drain, event_stream, stream_hourly
from ..streaming.closed_hours import hourly_grid_stream, score_grid_stream
from . import views
from .catalog import register
from .model_queries import BANNED, prepared
from .oracle import with_views
from .stream_queries import WATERMARK


def _replay(spark, sf_dir, since=None):
    """Hourly counts of the events as a file stream, from ``since`` on."""
    path = f"{sf_dir}/events.parquet"
    stream = event_stream(spark, path, spark.read.parquet(path).schema)
    return stream_hourly(stream if since is None else stream.where(F.col("ts") >= F.lit(since)), "ts", WATERMARK)


@register("stream_hourly_grid", with_views("""
SELECT hour_ts, n, casual, n - casual AS registered, round(avg_value, 6) AS avg_value,
       lag(n, 1) OVER (ORDER BY hour_idx) AS n_lag_1, lag(n, 24) OVER (ORDER BY hour_idx) AS n_lag_24
FROM hourly WHERE hour_ts + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events)""", "hourly"))
def stream_hourly_grid(spark, sf_dir):
    """Every hour up to the watermark, those without events too, with lags from the stream's own state."""
    ensure_utc(spark)
    base = scratch_path(spark, "stream_grid")
    out = drain(hourly_grid_stream(_replay(spark, sf_dir), lags=(1, 24)), f"{base}/sink", f"{base}/checkpoint")
    return out.withColumn("avg_value", round6("avg_value"))


_HALF = "SELECT min(hour_ts) + INTERVAL 1 HOUR * (count(*) // 2) AS half FROM hourly"


@register("stream_score_state", with_views(f"""
WITH h AS (SELECT *, lag(n, 1) OVER (ORDER BY hour_idx) AS l1, lag(n, 24) OVER (ORDER BY hour_idx) AS l24,
                  lag(n, 168) OVER (ORDER BY hour_idx) AS l168 FROM hourly),
m AS (SELECT regr_slope(n, l24) AS a, regr_intercept(n, l24) AS b FROM h, ({_HALF}) WHERE hour_ts < half)
SELECT hour_ts, n, l1 AS n_lag_1, l24 AS n_lag_24, l168 AS n_lag_168, round(a * l24 + b, 4) AS pred
FROM h, m, ({_HALF}) WHERE hour_ts >= half AND hour_ts + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events)
  AND l1 IS NOT NULL AND l24 IS NOT NULL AND l168 IS NOT NULL""", "hourly"))
def stream_score_state(spark, sf_dir):
    """R2: a replay of the second half of the events.  The history ends where it starts; every closed hour gets
    its lags from the state, seeded with the history's last week, and is scored by a model fitted on the history."""
    ensure_utc(spark)
    base = scratch_path(spark, "stream_state")
    h = views.hourly(spark, sf_dir).select("hour_ts", "hour_idx", "n")
    h.write.parquet(f"{base}/hourly")
    h = spark.read.parquet(f"{base}/hourly")
    b = h.agg(F.min("hour_ts").alias("lo"), F.count(F.lit(1)).alias("c")).first()
    half = b["lo"] + dt.timedelta(hours=b["c"] // 2) if b["c"] else dt.datetime(1970, 1, 1)
    history = h.where(F.col("hour_ts") < F.lit(half))
    train = lag_columns(history.withColumn("n", F.col("n").cast("double")), "hour_idx", "n", lags=[24]).where("n_lag_24 IS NOT NULL")
    artefacts.save_model(models.fit_linear(train, ["n_lag_24"], "n", reg=0.0), f"{base}/models", "model_lag", None)
    model = artefacts.load_model(f"{base}/models", "model_lag")
    grid = hourly_grid_stream(_replay(spark, sf_dir, half), history.select("hour_ts", "n"))
    lags = ["n_lag_1", "n_lag_24", "n_lag_168"]
    out = drain(score_grid_stream(grid, model, keep=("hour_ts", "n", *lags)), f"{base}/sink", f"{base}/checkpoint")
    return out.withColumn("pred", F.round("pred", 4))


# prepared rows: hours with all lags and at least one event, numbered
_PREPARED = """p AS (SELECT hour_ts, CAST(n AS DOUBLE) AS y, CAST(l24 AS DOUBLE) AS x1, CAST(l168 AS DOUBLE) AS x2,
              row_number() OVER (ORDER BY hour_ts) - 1 AS i, count(*) OVER () AS c
       FROM (SELECT *, lag(n, 24) OVER (ORDER BY hour_idx) AS l24, lag(n, 168) OVER (ORDER BY hour_idx) AS l168 FROM hourly)
       WHERE hour_idx >= 168 AND avg_value IS NOT NULL),
f AS (SELECT range AS fold, c, c - (5 - range) * (c // 6) AS s, c - (4 - range) * (c // 6) AS e FROM range(5), (SELECT max(c) AS c FROM p))"""


@register("ridge_cv", with_views(f"""
WITH {_PREPARED},
s AS (SELECT fold, s, e, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, stddev_pop(x1) AS d1, stddev_pop(x2) AS d2,
             covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1y, covar_pop(x2, y) AS c2y
      FROM p JOIN f ON p.i < f.s GROUP BY fold, s, e),
k AS (SELECT *, (1 + 1.0 / n) AS d, c12 / (d1 * d2) AS r, c1y / d1 AS b1, c2y / d2 AS b2 FROM s),
w AS (SELECT *, (b1 * d - b2 * r) / (d * d - r * r) / d1 AS w1, (b2 * d - b1 * r) / (d * d - r * r) / d2 AS w2 FROM k),
t AS (SELECT fold, any_value(n) AS n_train, count(*) AS n, sqrt(avg(pow(y - my - w1 * (x1 - m1) - w2 * (x2 - m2), 2))) AS rmse,
             avg(abs(y - my - w1 * (x1 - m1) - w2 * (x2 - m2))) AS mae FROM p JOIN w ON p.i >= w.s AND p.i < w.e GROUP BY fold)
SELECT CAST(fold AS VARCHAR) AS fold, n_train, n, round(rmse, 6) AS rmse, round(mae, 6) AS mae FROM t
UNION ALL SELECT 'mean', NULL, CAST(sum(n) AS BIGINT), round(avg(rmse), 6), round(avg(mae), 6) FROM t""", "hourly"))
def ridge_cv(spark, sf_dir):
    """M3 + M8: ridge on two lags over five expanding folds, fitted from the Gram matrices of one scan."""
    out = gram.ridge_cv(prepared(spark, sf_dir), "row_idx", ["n_lag_24", "n_lag_168"], "n", alpha=1.0, k=5)
    return out.withColumns({c: round6(c) for c in ("rmse", "mae")})


@register("linear_leaks", with_views("""
WITH f AS (SELECT n, casual, registered, avg_value, n * 2 + 3 AS twice FROM hourly WHERE avg_value IS NOT NULL)
SELECT 'raw' AS feature_set, x.feature, x.reason, x.coefficient
FROM (SELECT count(*) FILTER (WHERE casual + registered <> n) AS parts, count(*) FILTER (WHERE twice - 3 <> 2 * n) AS copies FROM f) c,
     (VALUES ('casual', 'part of target', 1.0::DOUBLE), ('registered', 'part of target', 1.0::DOUBLE),
             ('twice', 'multiple of target', 0.5::DOUBLE)) x(feature, reason, coefficient)
WHERE (reason = 'part of target' AND parts = 0) OR (reason = 'multiple of target' AND copies = 0)""", "hourly"))
def linear_leaks(spark, sf_dir):
    """M-AUD: the raw table gives the target away as a sum and as a scaled copy; the prepared features don't."""
    h = views.hourly(spark, sf_dir)
    f = prepare_features(h, target="n", ts="hour_ts", exclude=BANNED, lags=[1, 24, 168], index_col="hour_idx")
    raw = h.select("n", "casual", "registered", "avg_value", (F.col("n") * 2 + 3).alias("twice"))
    found = [gram.linear_leaks(d, "n").select(F.lit(name).alias("feature_set"), "*") for name, d in (("raw", raw), ("prepared", f.drop("hour_ts")))]
    return found[0].unionByName(found[1]).withColumn("coefficient", round6("coefficient"))


@register("promote_model", with_views("""
WITH c AS (SELECT * FROM (VALUES (1, 'naive_lag_168'), (2, 'naive_lag_8760'), (3, 'rolling_mean_24'), (4, 'naive_lag_168'),
                                 (5, 'naive_lag_1'), (6, 'naive_lag_24')) v(step, candidate)),
m AS (SELECT step, candidate, rmse FROM c LEFT JOIN forecaster_metrics f ON f.model = c.candidate),
b AS (SELECT *, min(rmse) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM m)
SELECT step, candidate, round(rmse, 6) AS rmse, coalesce(rmse < best OR (best IS NULL AND rmse IS NOT NULL), false) AS promoted,
       round(least(rmse, best), 6) AS in_use_rmse FROM b""", "forecaster_metrics"))
def promote_model(spark, sf_dir):
    """Candidates offered in turn to one model name; the pointer's target after each, by the metric stored with it."""
    rmse = {r["model"]: r["rmse"] for r in views.forecaster_metrics(spark, sf_dir).collect()}       # a row a forecaster
    base = scratch_path(spark, "versions")
    model = models.fit_linear(prepared(spark, sf_dir), ["n_lag_24"], "n")
    rows = []
    for step, name in enumerate(("naive_lag_168", "naive_lag_8760", "rolling_mean_24", "naive_lag_168", "naive_lag_1", "naive_lag_24"), 1):
        done = versions.promote(spark, model, base, "demand", {"rmse": rmse[name], "candidate": name})
        in_use = versions.metrics_of(spark, base, "demand", versions.current(spark, base, "demand"))
        rows.append((step, name, rmse[name], done["promoted"], in_use.get("rmse")))
    out = spark.createDataFrame(rows, "step int, candidate string, rmse double, promoted boolean, in_use_rmse double")
    return out.withColumns({c: round6(c) for c in ("rmse", "in_use_rmse")})
