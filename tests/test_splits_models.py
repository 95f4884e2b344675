"""Splits never look ahead; models fit, persist and score."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourglass.operators import evaluate, models, split
from hourglass.session import scratch_path
from hourglass.sources import artefacts


def test_expanding_folds_never_look_ahead(spark):
    df = spark.range(100).withColumnRenamed("id", "idx")
    for j, train, test in split.expanding_folds(df, "idx", k=5):
        tr = [r["idx"] for r in train.collect()]
        te = [r["idx"] for r in test.collect()]
        assert max(tr) < min(te) and len(te) == 100 // 6


def test_hash_split_is_a_partition(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    tr, te = split.hash_split(df, "k", 0.8)
    a, b = {r["k"] for r in tr.collect()}, {r["k"] for r in te.collect()}
    assert not (a & b) and len(a | b) == 5000 and 0.75 < len(a) / 5000 < 0.85


def test_boosting_fits_small_linear_frame(spark):
    rows = [(float(i), float(2 * i), 0.5 * i + 0.2 * 2 * i + 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "f1 double, f2 double, y double")
    m = models.fit_gbt(df, ["f1", "f2"], "y", rounds=10, rate=0.5)
    met = evaluate.regression_metrics(models.predict(m, df), "y", "pred").first()
    assert met["n"] == 20 and met["rmse"] < 10


def test_save_load_gives_equal_predictions(spark):
    rows = [(float(i), float(i % 7), float(3 * i + i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    m = models.fit_forest(df, ["a", "b"], "y", num_trees=10, max_depth=5)
    d = scratch_path(spark, "test-models")
    artefacts.save_model(m, d, "rf", {"rmse": 1.0})
    back = artefacts.load_model(d, "rf")
    p1 = [r["pred"] for r in models.predict(m, df).orderBy("a").collect()]
    p2 = [r["pred"] for r in models.predict(back, df).orderBy("a").collect()]
    assert p1 == p2
    reg = {r["model"]: r["status"] for r in artefacts.model_registry(spark, d).collect()}
    assert reg == {"rf": "ok"}


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    tv, qv = rng.normal(size=(80, 4)), rng.normal(size=(15, 4))
    ty = rng.integers(0, 5, size=80)
    train = spark.createDataFrame([(i, tv[i].tolist(), int(ty[i])) for i in range(80)], "id long, v array<double>, y int")
    query = spark.createDataFrame([(100 + i, qv[i].tolist(), 0) for i in range(15)], "id long, v array<double>, y int")
    got = {r["id"]: r["pred"] for r in models.knn_regress(train, query, 3, "v", "y", "id").collect()}
    for i in range(15):
        d = ((tv - qv[i]) ** 2).sum(axis=1)
        assert abs(got[100 + i] - ty[np.argsort(d)[:3]].mean()) < 1e-12


def test_knn_blocks_tiles_and_ties(spark, monkeypatch):
    """Several query blocks, many Arrow batches per partition, 7-cell distance
    tiles and exact distance ties (integer grid): the (distance, id) order
    must match brute force."""
    rng = np.random.default_rng(7)
    tv, qv = rng.integers(0, 3, size=(300, 2)), rng.integers(0, 3, size=(40, 2))
    ty = rng.integers(0, 100, size=300)
    train = spark.createDataFrame([(i, tv[i].astype(float).tolist(), int(ty[i])) for i in range(300)],
                                  "id long, v array<double>, y int").repartition(3)
    query = spark.createDataFrame([(1000 + i, qv[i].astype(float).tolist(), 0) for i in range(40)],
                                  "id long, v array<double>, y int")
    monkeypatch.setattr(models, "KNN_TILE_CELLS", 7)
    monkeypatch.setattr(models, "KNN_BLOCK_BYTES", 12 * (8 * 2 + 24 * 4 + 24))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = {r["id"]: r["pred"] for r in models.knn_regress(train, query, 4, "v", "y", "id").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 40
    ids = np.arange(300)
    for i in range(40):
        d = ((tv - qv[i]) ** 2).sum(axis=1)
        top = np.lexsort((ids, d))[:4]
        assert abs(got[1000 + i] - ty[top].mean()) < 1e-12

def test_bin_confusion_right_closed(spark):
    rows = [(float(i), float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "y double, pred double")
    got = {(r["actual_bin"], r["pred_bin"]): r["count"] for r in evaluate.bin_confusion(df, q=5).collect()}
    assert sum(got.values()) == 10 and all(a == b for a, b in got)


def test_reference_search_spaces_translate():
    p = models.boost_params({"num_leaves": 100, "learning_rate": 0.03, "n_estimators": 400, "max_depth": 6,
                             "subsample": 0.8})
    assert p == {"rounds": 400, "rate": 0.03, "maxDepth": 6}
    assert models.boost_params({"num_leaves": 31, "max_depth": -1})["maxDepth"] == 5
    draws = models.random_points(models.BOOST_RANDOM_SPACE_3FOLD, 24)
    assert len(draws) == 24 and len({tuple(sorted(d.items())) for d in draws}) == 24
    assert len(models.param_grid(models.FOREST_GRID)) == 4


def test_forest_is_seeded_on_the_hourly_series(spark):
    """Fitting the same seeded forest twice on the sf0.001 hourly series gives
    the same predictions."""
    from conftest import SF001
    from hourglass.plans import model_queries as mq
    _, train, test = mq._split(spark, SF001)
    p = [[r["pred"] for r in models.predict(models.fit_forest(train, mq.FEATURES, "n", num_trees=30), test)
          .orderBy("hour_ts").collect()] for _ in range(2)]
    assert p[0] == p[1] and len(p[0]) > 0


def test_forest_beats_train_mean_on_daily_shape(spark):
    """SURVEY §5 d: on a series with a daily shape plus noise, a forest on the
    hour feature beats predicting the train mean on the held-out tail."""
    rng = np.random.default_rng(11)
    hours = np.arange(24 * 40)
    y = 50 + 30 * np.sin(2 * np.pi * (hours % 24) / 24) + rng.normal(0, 5, len(hours))
    df = spark.createDataFrame([(int(h), int(h % 24), float(v)) for h, v in zip(hours, y)], "idx long, hour int, y double")
    train, test = split.time_split(df, "idx", 0.8)
    m = models.fit_forest(train, ["hour"], "y", num_trees=30)
    mean = train.agg(F.avg("y")).first()[0]
    rmse_model = evaluate.regression_metrics(models.predict(m, test), "y", "pred").first()["rmse"]
    rmse_mean = evaluate.regression_metrics(test.withColumn("pred", F.lit(mean)), "y", "pred").first()["rmse"]
    assert rmse_model < 0.5 * rmse_mean


@pytest.mark.parametrize("frac", [None, 0.2])
def test_search_fits_all_rows_unless_a_fraction_is_given(spark, monkeypatch, frac):
    """Every fit of a search sees its fold's whole training part; T3 only on request, at any size."""
    rows = [(i, float(i % 24), float(10 + (i % 24) * 2 + (i % 7))) for i in range(600)]
    df = spark.createDataFrame(rows, "idx long, hour double, y double")
    seen = []
    orig = models._fold_score

    def spy(fold, *a, **kw):
        seen.append((fold[0], fold[1].count()))
        return orig(fold, *a, **kw)

    monkeypatch.setattr(models, "_fold_score", spy)
    best, results = models.search(df, "idx", ["hour"], "y", lambda **p: models.ridge("y", **p),
                                  [{"reg": 0.1}], k=3, parallelism=1, sample_frac=frac)
    sizes = dict(seen)  # fold -> rows fitted; fold train parts hold 150, 300, 450 rows
    if frac is None:
        assert sizes == {0: 150, 1: 300, 2: 450}
    else:
        assert all(0 < sizes[j] < 0.4 * whole for j, whole in {0: 150, 1: 300, 2: 450}.items())
    assert all(np.isfinite(r["mean_rmse"]) for r in results)


def test_registered_searches_cover_the_reference_spaces(spark, monkeypatch):
    """The points and folds each search gets, and that the best point is refit; fits are cut to one round here."""
    from hourglass.plans import model_queries
    from hourglass.session import scratch_path
    asked, made, fit_boosted = [], [], models.fit_boosted

    def search_boosted(df, index_col, features, label, points, k=3, **kw):
        asked.append((points, k, label, kw.get("by", "mean_rmse")))
        return points[-1], [{"point": i, "params": p, "mean_rmse": 1.0, "mean_mae": 1.0} for i, p in enumerate(points)]

    def search(df, index_col, features, label, make, points, **kw):
        for p in points:
            make(**p)
        return points[-1], []

    monkeypatch.setattr(models, "search", search)
    monkeypatch.setattr(models, "search_boosted", search_boosted)
    monkeypatch.setattr(models, "fit_boosted", lambda df, f, label, rounds=500, **kw: made.append((rounds, kw)) or fit_boosted(df, f, label, rounds=1, **kw))
    sf = "/root/testdata/sf0.001"
    rows = model_queries.random_search(spark, sf).collect()
    points, k, _, _ = asked.pop()
    assert points == models.random_points(models.BOOST_RANDOM_SPACE_3FOLD, 24) and k == 3 and len(rows) == 24
    assert [r["test_rmse"] is not None for r in rows] == [r["best"] for r in rows] and sum(r["best"] for r in rows) == 1
    assert made[-1][0] == points[-1]["n_estimators"]
    rows = model_queries.log_target_metrics(spark, sf).collect()
    points, k, label, by = asked.pop()
    assert points == models.random_points(models.BOOST_RANDOM_SPACE_5FOLD, 20) and (k, label, by) == (5, "log_n", "mean_mse")
    assert len(rows) == 6 and {r["params"] for r in rows} == {str(sorted(points[-1].items()))}
    monkeypatch.setattr(models, "forest", lambda label, **kw: models.gbt(label, rounds=1, num_leaves=2))
    assert {r["note"] for r in model_queries.train_all(spark, sf, scratch_path(spark, "models")).collect()} == {"searched"}
    assert models.param_grid(models.BOOST_GRID) in [a[0] for a in asked]
