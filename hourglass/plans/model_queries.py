"""Evaluation, model, registry and scoring queries."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from ..functions.columns import md5_bucket, round6
from ..operators import evaluate, models, registry, split
from ..operators.features import prepare_features
from ..operators.order import with_row_index
from ..operators.profile import histogram
from ..session import scratch_path
from ..sources import artefacts
from ..sources.tables import table
from . import views
from .catalog import register
from .feature_queries import CAL_SQL, MD5_SQL
from .oracle import with_views

FEATURES = ["hour", "dayofweek", "month", "is_weekend", "n_lag_1", "n_lag_24", "n_lag_168"]
BANNED = ["casual", "registered"]


def _r(df, cols):
    return df.withColumns({c: round6(c) for c in cols})


def prepared(spark, sf_dir):
    """Hourly demand features with a dense row index, written once: every fit and
    fold of a search reads it."""
    h = views.hourly(spark, sf_dir)
    f = prepare_features(h, target="n", ts="hour_ts", exclude=BANNED, lags=[1, 24, 168], index_col="hour_idx")
    f = f.select("hour_ts", F.col("n").cast("double").alias("n"), *FEATURES)
    return _written(with_row_index(f, ["hour_ts"]), "prepared")


def _written(df, name):
    """``df`` as a table in the scratch folder: a small series that many fits read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _split(spark, sf_dir):
    p = prepared(spark, sf_dir)
    n = p.count()
    train, test = split.time_split(p, "row_idx", 0.8, n=n)
    return p, train, test


# ---------------------------------------------------------------- evaluation (Y)

@register("rmse_mae", with_views("""
SELECT count(*) AS n, round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse, round(avg(abs(y - pred)), 6) AS mae
FROM naive_forecast WHERE y IS NOT NULL AND pred IS NOT NULL""", "naive_forecast"))
def rmse_mae(spark, sf_dir):
    m = evaluate.regression_metrics(views.naive_forecast(spark, sf_dir), "y", "pred")
    return _r(m.select("n", "rmse", "mae"), ["rmse", "mae"])


@register("r2", with_views("""
SELECT round(1 - sum((y - pred) * (y - pred)) / sum((y - my) * (y - my)), 6) AS r2
FROM naive_forecast, (SELECT avg(y) AS my FROM naive_forecast WHERE y IS NOT NULL AND pred IS NOT NULL) a
WHERE y IS NOT NULL AND pred IS NOT NULL""", "naive_forecast"))
def r2(spark, sf_dir):
    return _r(evaluate.r2_score(views.naive_forecast(spark, sf_dir), "y", "pred"), ["r2"])


@register("residual_hist", with_views("""
WITH r AS (SELECT y - pred AS residual FROM naive_forecast WHERE y IS NOT NULL AND pred IS NOT NULL),
st AS (SELECT min(residual) AS mn, max(residual) AS mx FROM r),
b AS (SELECT CAST(least(floor((residual - mn) / (mx - mn) * 50), 49) AS BIGINT) AS bin, count(*) AS c
      FROM r, st GROUP BY 1)
SELECT g.bin, round(mn + g.bin * ((mx - mn) / 50), 6) AS lo, round(mn + (g.bin + 1) * ((mx - mn) / 50), 6) AS hi,
       coalesce(b.c, 0) AS count
FROM (SELECT range AS bin FROM range(50)) g CROSS JOIN st LEFT JOIN b ON b.bin = g.bin""", "naive_forecast"))
def residual_hist(spark, sf_dir):
    res = evaluate.residuals(views.naive_forecast(spark, sf_dir), "y", "pred")
    return _r(histogram(res, "residual", 50), ["lo", "hi"])


def _bin_sql(x, e):
    terms = [f"CASE WHEN {x} > {e}[{i}] AND {e}[{i}] > {e}[1] AND {e}[{i}] < {e}[6] AND {e}[{i}] <> {e}[{i - 1}] "
             f"THEN 1 ELSE 0 END" for i in range(2, 6)]
    return "CAST(" + " + ".join(terms) + " AS BIGINT)"


@register("bin_confusion", with_views(f"""
WITH d AS (SELECT y, pred FROM naive_forecast WHERE y IS NOT NULL AND pred IS NOT NULL),
q AS (SELECT quantile_cont(y, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS ey,
             quantile_cont(pred, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS ep FROM d)
SELECT {_bin_sql('y', 'ey')} AS actual_bin, {_bin_sql('pred', 'ep')} AS pred_bin, count(*) AS count
FROM d, q GROUP BY 1, 2""", "naive_forecast"))
def bin_confusion(spark, sf_dir):
    return evaluate.bin_confusion(views.naive_forecast(spark, sf_dir), "y", "pred", 5)


@register("fold_metrics", with_views("""
WITH c AS (SELECT count(*) AS n, count(*) // 6 AS t FROM naive_forecast),
m AS (SELECT f.range AS fold, sqrt(avg((y - pred) * (y - pred))) AS rmse, avg(abs(y - pred)) AS mae
      FROM naive_forecast, c, range(5) f
      WHERE hour_idx >= n - (5 - f.range) * t AND hour_idx < n - (4 - f.range) * t
        AND y IS NOT NULL AND pred IS NOT NULL GROUP BY f.range)
SELECT CAST(fold AS VARCHAR) AS fold, round(rmse, 6) AS rmse, round(mae, 6) AS mae FROM m
UNION ALL SELECT 'mean', round(avg(rmse), 6), round(avg(mae), 6) FROM m""", "naive_forecast"))
def fold_metrics(spark, sf_dir):
    """M8 on seasonal-naive forecasts: all folds scored in one grouped pass."""
    nf = views.naive_forecast(spark, sf_dir)
    nf = nf.select("hour_idx", "y", "pred").checkpoint(eager=True)  # one row an hour; counted, then scored
    tagged = nf.withColumn("fold", split.test_fold("hour_idx", 5, nf.count())).where(F.col("fold").isNotNull())
    per = evaluate.regression_metrics(tagged, "y", "pred", group_by="fold").select("fold", "rmse", "mae").checkpoint()
    mean = per.agg(F.lit("mean").alias("fold"), F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"))
    out = per.select(F.col("fold").cast("string").alias("fold"), "rmse", "mae").unionByName(mean)
    return _r(out, ["rmse", "mae"])


@register("linear_fit_sql", with_views("""
SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept,
       round(regr_r2(y, x), 6) AS r2, regr_count(y, x) AS n
FROM (SELECT CAST(n AS DOUBLE) AS y, CAST(lag(n, 24) OVER (ORDER BY hour_idx) AS DOUBLE) AS x FROM hourly) t""",
                                       "hourly"))
def linear_fit_sql(spark, sf_dir):
    """M3 one-feature form: least squares of demand on the same hour yesterday."""
    nf = views.naive_forecast(spark, sf_dir).select("y", F.col("pred").alias("x"))
    return _r(nf.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
                     F.regr_r2("y", "x").alias("r2"), F.regr_count("y", "x").alias("n")),
              ["slope", "intercept", "r2"])


@register("knn_regress", f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label, {MD5_SQL.format(k='vec_id')} < 80 AS is_train
           FROM embeddings),
d AS (SELECT q.vec_id, t.vec_id AS tid, t.label, list_distance(q.v, t.v) AS dist
      FROM e q JOIN e t ON NOT q.is_train AND t.is_train),
r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY dist, tid) AS rn FROM d)
SELECT vec_id, round(avg(label), 6) AS pred FROM r WHERE rn <= 5 GROUP BY vec_id""")
def knn_regress(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    is_train = md5_bucket("vec_id") < 80
    pred = models.knn_regress(e.where(is_train), e.where(~is_train), 5, "embedding", "label", "vec_id")
    return _r(pred, ["pred"])


# ---------------------------------------------------------------- registry (Y)

@register("leaderboard", with_views("""
SELECT model, n, round(rmse, 6) AS rmse, round(mae, 6) AS mae,
       CASE WHEN rmse IS NOT NULL THEN rank() OVER (ORDER BY rmse ASC NULLS LAST, model) END AS rank,
       CASE WHEN rmse IS NULL THEN 'missing metrics' ELSE 'ok' END AS status
FROM forecaster_metrics""", "forecaster_metrics"))
def leaderboard(spark, sf_dir):
    lb = registry.leaderboard(views.forecaster_metrics(spark, sf_dir))
    return _r(lb, ["rmse", "mae"]).withColumn("rank", F.col("rank").cast("bigint"))


@register("promote_if_better", with_views("""
SELECT c.candidate, c.current_model, round(n.rmse, 6) AS candidate_rmse, round(o.rmse, 6) AS current_rmse,
       coalesce(coalesce(o.rmse, 'inf'::DOUBLE) > n.rmse, false) AS promote
FROM (VALUES ('naive_lag_24', 'naive_lag_168'), ('rolling_mean_24', 'naive_lag_8760'),
             ('naive_lag_168', 'naive_lag_1')) c(candidate, current_model)
LEFT JOIN forecaster_metrics n ON n.model = c.candidate
LEFT JOIN forecaster_metrics o ON o.model = c.current_model""", "forecaster_metrics"))
def promote_if_better(spark, sf_dir):
    cands = spark.createDataFrame([("naive_lag_24", "naive_lag_168"), ("rolling_mean_24", "naive_lag_8760"),
                                   ("naive_lag_168", "naive_lag_1")], "candidate string, current_model string")
    out = registry.promote_if_better(cands, views.forecaster_metrics(spark, sf_dir))
    return _r(out.select("candidate", "current_model", "candidate_rmse", "current_rmse", "promote"),
              ["candidate_rmse", "current_rmse"])


@register("leakage_audit", with_views("""
WITH f AS (SELECT n, casual, registered, avg_value, n * 2 AS doubled FROM hourly)
SELECT 'raw' AS feature_set, x.feature, 'part of target' AS reason
FROM (SELECT count(*) AS bad FROM f WHERE abs(casual + registered - n) > 1e-9 * (1 + abs(n))) c,
     (VALUES ('casual'), ('registered')) x(feature) WHERE bad = 0""", "hourly"))
def leakage_audit(spark, sf_dir):
    """M-AUD: by value, the raw hourly table still holds the two summands of the target; the
    prepared feature frame must not."""
    h = views.hourly(spark, sf_dir)
    f = prepare_features(h, target="n", ts="hour_ts", exclude=BANNED, lags=[1, 24, 168], index_col="hour_idx")
    raw = h.select("n", "casual", "registered", "avg_value", (F.col("n") * 2).alias("doubled"))
    found = [registry.leakage_by_value(df, "n").select(F.lit(name).alias("feature_set"), "feature", "reason")
             for name, df in (("raw", raw), ("prepared", f.drop("hour_ts")))]
    return found[0].unionByName(found[1])


# ---------------------------------------------------------------- models (rows-only)

def _predictions(model, test):
    return models.predict(model, test).select("hour_ts", F.col("n").alias("y"), "pred")


@register("forest_predict")
def forest_predict(spark, sf_dir):
    """M1: random forest (200 trees, seed 42) on the time split, test predictions."""
    _, train, test = _split(spark, sf_dir)
    return _predictions(models.fit_forest(train, FEATURES, "n"), test)


@register("gbt_predict")
def gbt_predict(spark, sf_dir):
    """M2: boosted trees as the reference fits them by default (500 rounds, rate 0.05, 31 leaves)."""
    _, train, test = _split(spark, sf_dir)
    return _predictions(models.fit_boosted(train, FEATURES, "n", rounds=500, rate=0.05, num_leaves=31), test)


@register("ridge_predict")
def ridge_predict(spark, sf_dir):
    """M3: ridge regression on standardised features."""
    _, train, test = _split(spark, sf_dir)
    return _predictions(models.fit_linear(train, FEATURES, "n", reg=1.0), test)


def _results_df(spark, results, best):
    rows = [(r["point"], str(sorted(r["params"].items())), r["mean_rmse"], r["mean_mae"], r["params"] == best)
            for r in results]
    return spark.createDataFrame(rows, "point long, params string, mean_rmse double, mean_mae double, best boolean")


@register("grid_search")
def grid_search(spark, sf_dir):
    """M5 + M7: the reference forest grid searched on expanding folds of train
    only; the best point is refit on all of train and scored on test."""
    _, train, test = _split(spark, sf_dir)
    points = models.param_grid(models.FOREST_GRID)
    best, results = models.search(train, "row_idx", FEATURES, "n",
                                  lambda **p: models.forest("n", **models.forest_params(p)), points, k=3)
    refit = models.fit(train, FEATURES, models.forest("n", **models.forest_params(best)))
    m = models.evaluate_model(refit, test, "n")
    out = _results_df(spark, results, best)
    return out.withColumn("test_rmse", F.when(F.col("best"), F.lit(m["rmse"])))


@register("random_search")
def random_search(spark, sf_dir):
    """M6 + M7: the reference's 24 draws of boosted-tree settings over 3 expanding folds of
    train only; the best point is refit on all of train and scored on test."""
    _, train, test = _split(spark, sf_dir)
    points = models.random_points(models.BOOST_RANDOM_SPACE_3FOLD, 24)
    best, results = models.search_boosted(train, "row_idx", FEATURES, "n", points, k=3)
    refit = models.fit_boosted(train, FEATURES, "n", **models.boost_params(best))
    m = models.evaluate_model(refit, test, "n")
    out = _results_df(spark, results, best)
    return out.withColumn("test_rmse", F.when(F.col("best"), F.lit(m["rmse"]))).withColumn("test_mae", F.when(F.col("best"), F.lit(m["mae"])))


# Lags and windows of the reference's experiments.
EXPERIMENT_LAGS, EXPERIMENT_WINDOWS = (1, 24, 48, 168), (3, 6, 24, 168)


def experiment_frame(spark, sf_dir):
    """Hourly demand with the experiments' lags and prior rolling means."""
    h = views.hourly(spark, sf_dir)
    f = prepare_features(h, target="n", ts="hour_ts", exclude=BANNED, lags=EXPERIMENT_LAGS, windows=EXPERIMENT_WINDOWS,
                         index_col="hour_idx")
    return f.drop("avg_value")


@register("experiment_features", with_views(f"""
SELECT hour_ts, n, {CAL_SQL.format(t='hour_ts')}, {', '.join(f'n_lag_{l}' for l in EXPERIMENT_LAGS)},
       {', '.join(f'round(r{w}, 6) AS n_rolling_mean_{w}' for w in EXPERIMENT_WINDOWS)}
FROM (SELECT *, {', '.join(f'lag(n, {l}) OVER (ORDER BY hour_idx) AS n_lag_{l}' for l in EXPERIMENT_LAGS)},
             {', '.join(f'avg(n) OVER (ORDER BY hour_idx ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS r{w}' for w in EXPERIMENT_WINDOWS)}
      FROM hourly) t WHERE n_lag_168 IS NOT NULL AND avg_value IS NOT NULL""", "hourly"))
def experiment_features(spark, sf_dir):
    """F9 with the feature set of the reference's experiments."""
    return _r(experiment_frame(spark, sf_dir), [f"n_rolling_mean_{w}" for w in EXPERIMENT_WINDOWS])


@register("log_target_metrics")
def log_target_metrics(spark, sf_dir):
    """M6 + M9: the reference's 20 draws of boosted-tree settings on log1p(target) over the
    experiments' features, by the mean squared error of 5 expanding folds on the log scale; the
    best point's folds are scored on the original scale."""
    f = experiment_frame(spark, sf_dir)
    feats = [c for c in f.columns if c not in ("hour_ts", "n")]
    p = _written(with_row_index(f.withColumn("n", F.col("n").cast("double")), ["hour_ts"]), "experiment")
    points = models.random_points(models.BOOST_RANDOM_SPACE_5FOLD, 20)
    best, _ = models.search_boosted(p.withColumn("log_n", F.log1p("n")), "row_idx", feats, "log_n", points, k=5, by="mean_mse")
    rows = models.cross_validate_boosted(p, "row_idx", feats, "n", best, k=5, log_target=True)
    df = spark.createDataFrame([(str(r["fold"]), r["rmse"], r["mae"]) for r in rows], "fold string, rmse double, mae double")
    df = df.unionByName(df.agg(F.lit("mean").alias("fold"), F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae")))
    return df.withColumn("params", F.lit(str(sorted(best.items()))))


@register("feature_importances")
def feature_importances(spark, sf_dir):
    """Forest importances, top 20."""
    _, train, _ = _split(spark, sf_dir)
    return models.feature_importances(models.fit_forest(train, FEATURES, "n", num_trees=100), 20)


def train_all(spark, sf_dir, models_dir: str):
    """Grid searches of forests and of boosted trees (fallback: defaults), both
    refit on train, scored on test and saved with their metrics.  The two
    branches are independent and run side by side (each seeded)."""
    _, train, test = _split(spark, sf_dir)

    def forest_branch():
        try:
            points = models.param_grid(models.FOREST_GRID)
            best, _ = models.search(train, "row_idx", FEATURES, "n",
                                    lambda **p: models.forest("n", **models.forest_params(p)), points, k=3)
            rf, note = models.fit(train, FEATURES, models.forest("n", **models.forest_params(best))), "searched"
        except ValueError as e:  # too few rows for the folds: the defaults, and the row says so
            best, rf, note = {}, models.fit_forest(train, FEATURES, "n"), f"defaults: {e}"
        m = models.evaluate_model(rf, test, "n")
        artefacts.save_model(rf, models_dir, "model_rf_tuned", {"rmse": m["rmse"], "mae": m["mae"], "params": best})
        return ("model_rf_tuned", m["rmse"], m["mae"], note)

    def boost_branch():
        try:
            points = models.param_grid(models.BOOST_GRID)
            best, _ = models.search_boosted(train, "row_idx", FEATURES, "n", points, k=3)
            gb, note = models.fit_boosted(train, FEATURES, "n", **models.boost_params(best)), "searched"
        except ValueError as e:
            best, gb, note = {}, models.fit_boosted(train, FEATURES, "n"), f"defaults: {e}"
        m = models.evaluate_model(gb, test, "n")
        artefacts.save_model(gb, models_dir, "model_gbt", {"rmse": m["rmse"], "mae": m["mae"], "params": best})
        return ("model_gbt", m["rmse"], m["mae"], note)

    with ThreadPoolExecutor(max_workers=2) as ex:
        out = [f.result() for f in [ex.submit(forest_branch), ex.submit(boost_branch)]]
    return spark.createDataFrame(out, "model string, rmse double, mae double, note string")


@register("train_all")
def train_all_q(spark, sf_dir):
    return train_all(spark, sf_dir, scratch_path(spark, "models"))


# rows of the prepared table: hours with all lags and at least one event; the last fifth is the test part
_PREPARED_SQL = "SELECT hour_ts, row_number() OVER (ORDER BY hour_ts) - 1 AS i, count(*) OVER () AS c FROM hourly " \
                "WHERE hour_idx >= 168 AND avg_value IS NOT NULL"


@register("model_roundtrip", with_views(f"""
SELECT count(*) AS n, true AS same FROM ({_PREPARED_SQL}) p WHERE i >= floor(c * 0.8)""", "hourly"))
def model_roundtrip(spark, sf_dir):
    """A saved and reloaded pipeline predicts the same values."""
    _, train, test = _split(spark, sf_dir)
    d = scratch_path(spark, "models")
    m = models.fit_gbt(train, FEATURES, "n", rounds=20, rate=0.1)
    artefacts.save_model(m, d, "roundtrip", {"rmse": 0.0})
    loaded = artefacts.load_model(d, "roundtrip")
    a = models.predict(m, test).select("hour_ts", "pred")
    b = models.predict(loaded, test).select("hour_ts", F.col("pred").alias("pred_loaded"))
    return a.join(b, "hour_ts").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("pred") == F.col("pred_loaded")).alias("same"))


@register("model_registry", with_views("""
WITH m AS (SELECT sqrt(avg((y - pred) * (y - pred))) AS rmse, avg(abs(y - pred)) AS mae FROM naive_forecast
           WHERE y IS NOT NULL AND pred IS NOT NULL)
SELECT 'ridge_1' AS model, round(rmse, 6) AS rmse, round(mae, 6) AS mae, 'ok' AS status FROM m
UNION ALL SELECT 'ridge_10', NULL, NULL, 'missing metrics'
UNION ALL SELECT 'ridge_bad', NULL, NULL, 'invalid metrics'
UNION ALL SELECT 'ridge_mended', round(rmse, 6), round(mae, 6), 'ok' FROM m""", "naive_forecast"))
def model_registry(spark, sf_dir):
    """Artefacts joined to the metrics of their latest run (those of the
    seasonal-naive forecast stand in, so SQL knows them): one model saved twice, one
    without metrics, one whose only metrics file is not valid JSON, one whose
    later run mends that."""
    _, train, _ = _split(spark, sf_dir)
    d = scratch_path(spark, "models")
    row = evaluate.regression_metrics(views.naive_forecast(spark, sf_dir), "y", "pred").first()
    known = {"rmse": row["rmse"], "mae": row["mae"]}
    m = models.fit_linear(train, FEATURES, "n")
    for name in ("ridge_bad", "ridge_mended"):
        spark.createDataFrame([("{not json",)], "value string").write.mode("append") \
            .text(f"{d}/{artefacts.METRICS_DIR}/model={name}")
    for name, metrics in (("ridge_1", {"rmse": 0.001, "mae": 0.001}), ("ridge_1", known), ("ridge_10", None), ("ridge_bad", None),
                          ("ridge_mended", known)):
        artefacts.save_model(m, d, name, metrics)
    return _r(artefacts.model_registry(spark, d).drop("model_class"), ["rmse", "mae"])


@register("batch_score")
def batch_score(spark, sf_dir):
    """Score every prepared hour with a model selected by name."""
    from ..operators.score import score
    p, train, _ = _split(spark, sf_dir)
    d = scratch_path(spark, "models")
    artefacts.save_model(models.fit_linear(train, FEATURES, "n"), d, "model_ridge", None)
    return score(p, d, "model_ridge", keep=["hour_ts"])


@register("batch_score_coded", f"""
WITH t AS (SELECT event_id, event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS code, value FROM events WHERE event_type IS NOT NULL),
m AS (SELECT regr_slope(value, code) AS a, regr_intercept(value, code) AS b FROM t)
SELECT e.event_id, round(coalesce(t.code, -1) * a + b, 6) AS pred, 'model_coded' AS model
FROM events e LEFT JOIN t USING (event_id), m""")
def batch_score_coded(spark, sf_dir):
    """R1 with a text feature: least squares of the value on the coded event type; scoring
    the raw frame takes the codes stored with the model."""
    from ..operators.features import label_encode
    from ..operators.score import score
    ev = views.events(spark, sf_dir).select("event_id", "event_type", "value")
    coded, mapping = label_encode(ev.where("event_type IS NOT NULL"), ["event_type"])
    d = scratch_path(spark, "models")
    artefacts.save_model(models.fit_linear(coded, ["event_type"], "value", reg=0.0), d, "model_coded", None, mapping)
    return _r(score(ev.drop("value"), d, "model_coded", keep=["event_id"]), ["pred"])


@register("batch_score_history", with_views("""
WITH f AS (SELECT hour_ts, hour_idx, n, lag(n, 24) OVER (ORDER BY hour_idx) AS x FROM hourly),
m AS (SELECT regr_slope(n, x) AS a, regr_intercept(n, x) AS b FROM f)
SELECT hour_ts, round(coalesce(x, 0) * a + b, 4) AS pred, 'model_lag' AS model FROM f, m""", "hourly"))
def batch_score_history(spark, sf_dir):
    """R1 with lags from the history (D12): a frame of bare hours is scored by a
    one-lag least-squares model; an hour without history has lag 0."""
    from ..operators.order import lag_columns
    from ..operators.score import score
    h = views.hourly(spark, sf_dir).select("hour_ts", "hour_idx", F.col("n").cast("double").alias("n"))
    train = lag_columns(h, "hour_idx", "n", lags=[24]).where("n_lag_24 IS NOT NULL")
    d = scratch_path(spark, "models")
    artefacts.save_model(models.fit_linear(train, ["n_lag_24"], "n", reg=0.0), d, "model_lag", None)
    out = score(h.select("hour_ts"), d, "model_lag", ts="hour_ts", keep=["hour_ts"], fill=0, history=h.select("hour_ts", "n"))
    return out.withColumn("pred", F.round("pred", 4))
