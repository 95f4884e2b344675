"""Stream state (R2, R3), Gram matrices (M3, M8, M-AUD) and model versions."""
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourglass.operators import gram, models
from hourglass.operators.split import fold_bounds
from hourglass.session import scratch_path
from hourglass.sources import versions
from hourglass.streaming import drain, event_stream, stream_hourly
from hourglass.streaming.closed_hours import hourly_grid_stream


def at(hour, minute=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour, minutes=minute)


EVENTS = "ts timestamp_ntz, event_type string, value double"


def test_grid_closes_empty_hours_in_parts_and_after_a_restart(spark):
    base = scratch_path(spark, "grid_test")
    parts = [[(at(0, 5), "view", 1.0), (at(0, 9), "buy", 3.0), (at(3, 1), "buy", None)], [(at(9, 50), "view", 2.0)], [(at(30, 30), "buy", 7.0)]]
    got = {}
    for part in parts:                                       # each part lands, then the query is started again
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = event_stream(spark, f"{base}/in", spark.read.parquet(f"{base}/in").schema)
        out = drain(hourly_grid_stream(stream_hourly(stream), lags=(1, 3)), f"{base}/sink", f"{base}/checkpoint")
        got = {r["hour_ts"]: tuple(r)[1:] for r in out.collect()}
        assert len(got) == out.count()                       # no hour comes twice
    n = {0: (2, 1, 1, 2.0), 3: (1, 0, 1, None), 9: (1, 1, 0, 2.0)}
    count = lambda h: n.get(h, (0,))[0] if h >= 0 else None
    assert got == {at(h): (*n.get(h, (0, 0, 0, None)), count(h - 1), count(h - 3)) for h in range(29)}     # hour 29 ends at 30:00, the watermark is 29:30


def test_grid_goes_on_after_the_history(spark):
    base = scratch_path(spark, "grid_history")
    history = spark.createDataFrame([(at(h), 100 + h) for h in range(10)], "hour_ts timestamp_ntz, n bigint")
    spark.createDataFrame([(at(8), "view", 1.0), (at(12, 1), "view", 1.0), (at(15, 59), "view", 1.0)], EVENTS).coalesce(1).write.parquet(f"{base}/in")
    stream = event_stream(spark, f"{base}/in", spark.read.parquet(f"{base}/in").schema)
    out = drain(hourly_grid_stream(stream_hourly(stream), history, lags=(1, 5)), f"{base}/sink", f"{base}/checkpoint")
    assert sorted((r["hour_ts"], r["n"], r["n_lag_1"], r["n_lag_5"]) for r in out.collect()) == [
        (at(10), 0, 109, 105), (at(11), 0, 0, 106), (at(12), 1, 0, 107), (at(13), 0, 1, 108)]


# ---------------------------------------------------------------- Gram matrices

def frame(spark, n=300, seed=2):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = r.gauss(1e6, 3), r.gauss(0, 1)
        rows.append((i, a, b, 5.0, None if i % 40 == 3 else 2 * a - b + r.gauss(0, 1)))
    return spark.createDataFrame(rows, "row_idx bigint, a double, b double, same double, y double").repartition(4), rows


def test_ridge_of_every_fold_equals_a_direct_solution(spark):
    df, rows = frame(spark)
    got = {r["fold"]: r for r in gram.ridge_cv(df, "row_idx", ["a", "b", "same"], "y", alpha=3.0, k=4).collect()}
    for j, s, e in fold_bounds(len(rows), 4):
        data = np.array([r[1:] for r in rows[:s] if r[4] is not None], float)
        x, y = data[:, :2], data[:, 3]
        m, d = x.mean(axis=0), x.std(axis=0)
        z = (x - m) / d
        w = np.linalg.solve(z.T @ z + 3.0 * np.eye(2), z.T @ (y - y.mean()))
        t = np.array([r[1:] for r in rows[s:e] if r[4] is not None], float)
        off = t[:, 3] - y.mean() - (t[:, :2] - m) / d @ w
        assert got[str(j)]["n_train"] == len(data) and got[str(j)]["n"] == len(t)
        assert got[str(j)]["rmse"] == pytest.approx(np.sqrt((off ** 2).mean()), rel=1e-6)
        assert got[str(j)]["mae"] == pytest.approx(np.abs(off).mean(), rel=1e-6)
    assert got["mean"]["rmse"] == pytest.approx(np.mean([got[str(j)]["rmse"] for j in range(4)]))


def leaks(df, target):
    return {r["feature"]: (r["reason"], round(r["coefficient"], 6)) for r in gram.linear_leaks(df, target).collect()}


def test_leaks_of_three_parts_copies_and_none(spark):
    r = random.Random(9)
    rows = [tuple(r.gauss(10, 4) for _ in range(6)) for _ in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double").repartition(3)
    df = df.withColumn("y", F.col("a") + 2 * F.col("b") - 0.5 * F.col("c") + 7)
    assert leaks(df, "y") == {"a": ("part of target", 1.0), "b": ("part of target", 2.0), "c": ("part of target", -0.5)}
    assert leaks(df.withColumn("y", F.col("y") + F.randn(1)), "y") == {}
    copies = df.select("d", "y", F.col("y").alias("z"), (F.col("y") * 4 - 1).alias("q"), F.lit(3.0).alias("k"), F.lit(None).cast("double").alias("u"))
    assert leaks(copies.drop("u"), "y") == {"z": ("equals target", 1.0), "q": ("multiple of target", 0.25)}
    assert leaks(copies, "y") == {} and leaks(df.limit(0), "y") == {} and leaks(df.select("y"), "y") == {}


def test_leaks_among_two_hundred_columns(spark):
    cols = [F.randn(i).alias(f"x{i}") for i in range(200)]
    df = spark.range(0, 2000, 1, 4).select(*cols)
    df = df.withColumn("y", sum((F.col(f"x{i}") for i in (3, 50, 120, 199)), F.lit(0.0)))
    assert set(leaks(df, "y")) == {"x3", "x50", "x120", "x199"}


# ---------------------------------------------------------------- versions

@pytest.fixture(scope="module")
def two(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(20)], "x double, y double")
    return df, [models.fit_linear(d, ["x"], "y", reg=0.0) for d in (df, df.withColumn("y", -F.col("y")))]


def test_promotion_keeps_the_better_model(spark, two):
    df, (good, other) = two
    base = scratch_path(spark, "versions_test")
    with pytest.raises(ValueError):
        versions.load_current(spark, base, "m")
    first = versions.promote(spark, good, base, "m", {"rmse": 5.0})
    assert first["promoted"] and versions.current(spark, base, "m") == first["version"]
    for metrics in ({"rmse": 5.0}, {"rmse": 9.0}, {"mae": 1.0}, {"rmse": float("nan")}):       # equal, worse, unknown
        assert not versions.promote(spark, other, base, "m", metrics)["promoted"]
        assert versions.current(spark, base, "m") == first["version"]
    assert models.predict(versions.load_current(spark, base, "m"), df).where("abs(pred - y) > 1e-6").count() == 0
    last = versions.promote(spark, other, base, "m", {"rmse": 4.0})
    assert last["promoted"] and last["previous"] == first["version"] and last["current"] == 5.0
    assert models.predict(versions.load_current(spark, base, "m"), df).where("abs(pred + y) > 1e-6").count() == 0


def test_a_stop_before_the_pointer_changes_nothing(spark, two, monkeypatch):
    df, (good, other) = two
    base = scratch_path(spark, "versions_stop")
    first = versions.promote(spark, good, base, "m", {"rmse": 5.0})["version"]

    def stop(*_):
        raise RuntimeError("stopped")
    monkeypatch.setattr(versions, "point", stop)
    with pytest.raises(RuntimeError):
        versions.promote(spark, other, base, "m", {"rmse": 1.0})
    assert versions.current(spark, base, "m") == first
    assert models.predict(versions.load_current(spark, base, "m"), df).where("abs(pred - y) > 1e-6").count() == 0
    monkeypatch.undo()
    with pytest.raises(ValueError):                          # a version that was never finished
        versions.point(spark, base, "m", "nothing")
