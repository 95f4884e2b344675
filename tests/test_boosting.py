"""Boosted trees that share prefixes: one tree by brute force, prefixes, searches, barrier tasks, storage."""
import math
import random
import time
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourglass.operators import boosting, models
from hourglass.operators.evaluate import regression_metrics
from hourglass.operators.split import expanding_folds
from hourglass.session import scratch_path, ship
from hourglass.sources import artefacts


@pytest.fixture(scope="module")
def series(spark):
    r = random.Random(4)
    rows = []
    for i in range(420):
        a, b = i % 24, r.random()
        c = None if i % 50 == 7 else float("nan") if i % 50 == 9 else r.gauss(0, 1)
        rows.append((i, a, b, c, 20 + 15 * math.sin(a / 24 * 6.28) + 8 * (b > 0.6) + r.gauss(0, 1)))
    return spark.createDataFrame(rows, "row_idx bigint, hour int, b double, c double, n double").cache()


FEATURES = ["hour", "b", "c"]


def scored(model, df):
    return regression_metrics(models.predict(model, df), "n", "pred").first()


def test_one_split_is_the_best_of_all(spark):
    r = random.Random(1)
    rows = [(float(r.randint(0, 30)), r.random(), r.random() * 10) for _ in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, n double")
    trees = boosting.fit_boosted(df, ["a", "b"], "n", rounds=1, rate=1.0, depth=1).stages[-1].trees
    top = trees[(trees.tree == 1) & (trees.node == 0)].iloc[0]
    data = np.array(rows)
    y = data[:, 2] - data[:, 2].mean()

    def fall(f, t):
        left = data[:, f] <= t
        return (y[left].sum() ** 2 / left.sum() + y[~left].sum() ** 2 / (~left).sum()) if min(left.sum(), (~left).sum()) >= boosting.LEAF_ROWS else -1
    best = max(fall(f, t) for f in (0, 1) for t in data[:, f])
    assert fall(int(top.feature), top.threshold) == pytest.approx(best)


def test_prefixes_are_the_models_of_fewer_rounds(series):
    folds = expanding_folds(series, "row_idx", 3)
    _, train, test = folds[-1]
    shared = boosting.fold_errors(train, test, FEATURES, "n", 0.1, 4, [3, 10, 25])
    whole = boosting.fit_boosted(train, FEATURES, "n", rounds=25, rate=0.1, depth=4)
    for rounds in (3, 10, 25):
        own = scored(boosting.fit_boosted(train, FEATURES, "n", rounds=rounds, rate=0.1, depth=4), test)
        assert shared[rounds]["rmse"] == pytest.approx(own["rmse"], abs=1e-9) and shared[rounds]["mae"] == pytest.approx(own["mae"], abs=1e-9)
        stage = whole.stages[-1].first_rounds(rounds)
        again = regression_metrics(stage.transform(whole.stages[0].transform(test)), "n", "pred").first()
        assert again["rmse"] == pytest.approx(own["rmse"], abs=1e-9)


def test_shared_search_selects_what_the_plain_loop_does(series):
    points = models.param_grid({"n_estimators": [5, 20], "learning_rate": [0.3], "num_leaves": [4, 16]})
    best, results = models.search_boosted(series, "row_idx", FEATURES, "n", points, k=3)
    plain = []
    for p in points:
        t = models.boost_params(p)
        errors = [scored(boosting.fit_boosted(tr, FEATURES, "n", t["rounds"], t["rate"], t["maxDepth"]), te)["rmse"]
                  for _, tr, te in expanding_folds(series, "row_idx", 3)]
        plain.append(float(np.mean(errors)))
    assert [r["mean_rmse"] for r in results] == pytest.approx(plain, abs=1e-9)
    assert best == points[int(np.argmin(plain))]


def test_tasks_that_add_up_histograms_grow_the_same_trees(series):
    one = boosting.fit_boosted(series, FEATURES, "n", rounds=8, rate=0.2, depth=4, parts=1).stages[-1].trees
    many = boosting.fit_boosted(series, FEATURES, "n", rounds=8, rate=0.2, depth=4, parts=3).stages[-1].trees
    a, b = (t.sort_values(["tree", "node"]).reset_index(drop=True) for t in (one, many))
    assert (a[["tree", "node", "feature", "left", "right"]] == b[["tree", "node", "feature", "left", "right"]]).all().all()
    assert np.allclose(a.value, b.value, atol=1e-9)
    folds = expanding_folds(series, "row_idx", 2)
    errors = [boosting.fold_errors(folds[1][1], folds[1][2], FEATURES, "n", 0.2, 3, [4, 8], log_target=True, parts=k) for k in (1, 3)]
    for k in (4, 8):
        assert errors[0][k]["rmse"] == pytest.approx(errors[1][k]["rmse"], abs=1e-9)


def test_as_good_as_mllib(series):
    _, train, test = expanding_folds(series, "row_idx", 3)[-1]
    own = scored(boosting.fit_boosted(train, FEATURES, "n", rounds=30, rate=0.1, depth=4), test)["rmse"]
    filled = [d.fillna(0.0) for d in (train, test)]
    other = scored(models.fit(filled[0], FEATURES, models.gbt("n", rounds=30, rate=0.1, maxDepth=4)), filled[1])["rmse"]
    mean = train.agg(F.avg("n")).first()[0]
    naive = test.agg(F.sqrt(F.avg((F.col("n") - mean) ** 2))).first()[0]
    assert own < 1.15 * other and own < 0.5 * naive


def test_stored_models_predict_the_same(spark, series):
    model = boosting.fit_boosted(series, FEATURES, "n", rounds=6, rate=0.2, depth=3)
    base = scratch_path(spark, "boosted")
    artefacts.save_model(model, base, "boosted", {"rmse": 1.0})
    back = artefacts.load_model(base, "boosted")
    a = models.predict(model, series).select("row_idx", "pred").collect()
    b = models.predict(back, series).select("row_idx", "pred").collect()
    assert sorted(a) == sorted(b)
    assert artefacts.model_registry(spark, base).first()["model"] == "boosted"


def test_odd_tables(spark):
    few = spark.createDataFrame([(1, 2.0, 3.0), (2, None, None), (3, 2.0, float("nan"))], "row_idx int, a double, n double")
    model = boosting.fit_boosted(few, ["a"], "n", rounds=3, rate=0.1, depth=2)
    assert [r["pred"] for r in models.predict(model, few).collect()] == [3.0] * 3
    none = boosting.fit_boosted(few.limit(0), ["a"], "n", rounds=2, rate=0.1, depth=2)
    assert [r["pred"] for r in models.predict(none, few).collect()] == [0.0] * 3


def test_fits_side_by_side_ship_the_package_once():
    sent = []

    def add(path):
        sent.append(path)
        time.sleep(0.2)                       # Spark's own copy takes a while, and a second one of that name fails
    fresh = SimpleNamespace(sparkContext=SimpleNamespace(addPyFile=add))
    with ThreadPoolExecutor(8) as ex:
        list(ex.map(lambda _: ship(fresh), range(8)))
    assert len(sent) == 1
