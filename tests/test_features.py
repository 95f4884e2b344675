"""Lags, rolling means, row index and encodings (reference test + properties)."""

import datetime as dt
import random

import numpy as np
import pytest
import pandas as pd
from pyspark.sql import functions as F

from hourglass.operators.features import add_lags, label_encode, prepare_features, time_lags
from hourglass.operators.order import lag_columns, with_row_index


def five_rows(spark):
    t0 = dt.datetime(2021, 1, 1)
    rows = [(t0 + dt.timedelta(hours=i), i, float(y), c, r)
            for i, (y, c, r) in enumerate(zip([10, 12, 15, 13, 20], [5, 6, 7, 5, 10], [5, 6, 8, 8, 10]))]
    return spark.createDataFrame(rows, "fecha timestamp_ntz, hora int, total_alquileres double, "
                                       "u_casuales long, u_registrados long")


def test_reference_lag_frame(spark):
    df = add_lags(five_rows(spark), "total_alquileres", lags=[1, 2], windows=[2], order_by=["fecha"])
    got = df.orderBy("fecha").collect()
    assert [r["total_alquileres_lag_1"] for r in got] == [None, 10, 12, 15, 13]
    assert [r["total_alquileres_lag_2"] for r in got] == [None, None, 10, 12, 15]
    assert [r["total_alquileres_rolling_mean_2"] for r in got] == [None, 10, 11, 13.5, 14]


def test_prepare_drops_banned_and_incomplete(spark):
    out = prepare_features(five_rows(spark), target="total_alquileres", ts="fecha", lags=[1])
    assert "u_casuales" not in out.columns and "u_registrados" not in out.columns
    assert out.count() == 4  # the first row has no lag


def test_prepare_without_target_is_a_scoring_frame(spark):
    df = five_rows(spark).drop("total_alquileres")
    out = prepare_features(df, target="total_alquileres", ts="fecha", lags=[1])
    assert out.count() == 5


def test_row_index_matches_sorted_order(spark):
    random.seed(3)
    rows = [(random.randint(0, 50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, id int").repartition(7)
    got = with_row_index(df, ["k", "id"]).select("row_idx", "k", "id").collect()
    expect = sorted(rows)
    assert sorted((r["row_idx"], r["k"], r["id"]) for r in got) == [(i, k, j) for i, (k, j) in enumerate(expect)]


def test_keyed_lags_with_hot_key_and_small_buckets(spark):
    """One key holds a third of the rows; buckets of 64 rows force halos."""
    random.seed(5)
    rows = []
    for i in range(2400):
        key = 0 if i % 3 == 0 else random.randint(1, 40)
        rows.append((key, i, float(random.randint(0, 100))))
    pdf = pd.DataFrame(rows, columns=["key", "t", "v"])
    df = spark.createDataFrame(pdf).repartition(5)
    idx = with_row_index(df, ["t"], partition_by=["key"])
    got = lag_columns(idx, "row_idx", "v", lags=[1, 7], windows=[3], partition_by=["key"],
                      bucket_rows=64).toPandas().sort_values(["key", "t"]).reset_index(drop=True)
    pdf = pdf.sort_values(["key", "t"]).reset_index(drop=True)
    g = pdf.groupby("key")["v"]
    exp1, exp7 = g.shift(1), g.shift(7)
    exp_r = g.transform(lambda s: s.shift(1).rolling(3, min_periods=1).mean())
    assert np.allclose(got["v_lag_1"].astype(float), exp1, equal_nan=True)
    assert np.allclose(got["v_lag_7"].astype(float), exp7, equal_nan=True)
    assert np.allclose(got["v_rolling_mean_3"].astype(float), exp_r, equal_nan=True)


def test_time_lags_are_gap_safe(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0, 1), ("a", t0 + dt.timedelta(hours=2), 3), ("a", t0 + dt.timedelta(hours=3), 4)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, n long")
    got = {r["ts"]: r["n_lag_1"] for r in time_lags(df, "n", "ts", [1], ["k"]).collect()}
    assert got[t0 + dt.timedelta(hours=2)] is None  # row before is 2 hours back
    assert got[t0 + dt.timedelta(hours=3)] == 3


def test_label_encode_sorted_codes_and_null(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "c string")
    enc, mapping = label_encode(df, ["c"], suffix="_code")
    assert sorted((r["c"], r["c_code"]) for r in enc.collect() if r["c"]) == [("a", 0), ("b", 1), ("b", 1)]
    assert [r["c_code"] for r in enc.collect() if r["c"] is None] == [-1]


def test_label_codes_over_many_partitions_and_shuffled_join(spark, monkeypatch):
    """Two columns, one hot value holding a third of the rows; codes by the
    distributed row index over 6 shuffle partitions; with a zero broadcast limit the
    lookup joins shuffle and must give the same codes as pandas' sorted categories."""
    from hourglass.operators import lookup
    rng = random.Random(3)
    vals = [f"v{rng.randrange(400):03d}" for _ in range(1200)] + ["hot"] * 600
    rows = [(i, v, None if i % 11 == 0 else f"s{i % 37}") for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "id long, a string, b string").repartition(6)
    monkeypatch.setattr(lookup, "BROADCAST_LIMIT_BYTES", 0)
    conf = {"spark.sql.shuffle.partitions": "6", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        enc, mapping = label_encode(df, ["a", "b"], suffix="_code")
        enc.collect()
        plan = enc._jdf.queryExecution().executedPlan().toString()
        got = {r["id"]: (r["a_code"], r["b_code"]) for r in enc.collect()}
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    lookups = [ln for ln in plan.splitlines() if "Join" in ln and "_hg_v_" in ln]
    assert len(lookups) >= 2 and all("SortMergeJoin" in ln for ln in lookups)
    pdf = pd.DataFrame(rows, columns=["id", "a", "b"])
    ca = pd.Categorical(pdf["a"]).codes
    cb = pd.Categorical(pdf["b"]).codes
    assert all(got[i] == (int(ca[i]), int(cb[i])) for i in range(len(rows)))
