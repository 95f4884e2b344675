"""Cleaning rules, quantiles and profiles on hand frames."""

import numpy as np
from pyspark.sql import functions as F

from hourglass.functions.quantiles import exact_quantiles, order_statistics
from hourglass.operators import clean, profile


def test_clip_fires_only_above_ten_times_p99(spark):
    vals = [float(i % 10) / 10 for i in range(1000)] + [500.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    out = clean.clip_rules(df, ["x"]).collect()
    assert max(r["x"] for r in out if r["x"] is not None) <= 1.0
    assert sum(r["x_outlier_clipped"] for r in out) >= 1
    # no clip when the max is within 10 x p99
    df2 = spark.createDataFrame([(float(i),) for i in range(1, 101)], "x double")
    out2 = clean.clip_rules(df2, ["x"]).collect()
    assert not any(r["x_outlier_clipped"] for r in out2)


def test_large_rule_nulls_and_flags(spark):
    vals = [0.1] * 100 + [60.0, 70.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    out = clean.null_large(df, ["x"]).collect()
    assert sum(r["x"] is None for r in out) == 2 and sum(r["x_outlier_large"] for r in out) == 2


def test_repair_sum(spark):
    df = spark.createDataFrame([(None, 2, None), (5.0, 1, 1)], "t double, a long, b long")
    assert [r["t"] for r in clean.repair_sum(df, "t", ["a", "b"]).collect()] == [2.0, 5.0]


def test_exact_quantiles_bracket_path_equals_numpy(spark):
    rng = np.random.default_rng(0)
    vals = rng.normal(size=20000).round(3)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(6)
    probs = [0.01, 0.25, 0.5, 0.99]
    small = exact_quantiles(df, {"x": probs}, direct_limit=500, accuracy=200)["x"]
    assert np.allclose(small, np.quantile(vals, probs), rtol=0, atol=1e-12)
    st = order_statistics(df, "x", [0, 199, 19999], direct_limit=500, accuracy=200)
    s = np.sort(vals)
    assert st == {0: s[0], 199: s[199], 19999: s[19999]}


def test_exact_quantiles_hot_value_resolves(spark):
    """A value holding a third of the column: ranks inside its run resolve to
    it in one bracketing round instead of narrowing forever."""
    rng = np.random.default_rng(5)
    vals = np.concatenate([rng.normal(size=14000).round(3), np.full(7000, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(6)
    probs = [0.01, 0.4, 0.5, 0.6, 0.99]
    got = exact_quantiles(df, {"x": probs}, direct_limit=500, accuracy=200)["x"]
    assert np.allclose(got, np.quantile(vals, probs), rtol=0, atol=1e-12)


def test_describe_takes_the_same_scans_for_any_number_of_columns(spark):
    """Over 100,000 different values a column: one scan for moments and sketches, one for the quartiles."""
    n, jobs = 150_000, {}
    df = spark.range(n, numPartitions=4).select(*[((F.col("id") * (2 * i + 7919)) % n + F.rand(i) / 4).alias(f"c{i}") for i in range(6)])
    values = np.stack([np.sort(np.asarray(v)) for v in df.toPandas().to_numpy().T])
    for cols in (1, 6):
        spark.sparkContext.setJobGroup(f"describe-{cols}", "")
        got = {r["column"]: r for r in profile.describe(df, [f"c{i}" for i in range(cols)]).collect()}
        jobs[cols] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"describe-{cols}"))
        for i in range(cols):
            want = np.quantile(values[i], [0.25, 0.5, 0.75])
            assert [got[f"c{i}"][q] for q in ("p25", "p50", "p75")] == want.tolist() and got[f"c{i}"]["count"] == n
    spark.sparkContext.setJobGroup("default", "")
    assert jobs[1] == jobs[6]


def test_quantiles_of_empty_and_null_columns(spark):
    df = spark.createDataFrame([(None, 1.0), (float("nan"), None)], "x double, y double")
    assert exact_quantiles(df, {"x": [0.5], "y": [0.0, 1.0]}) == {"x": [None], "y": [1.0, 1.0]}
    assert exact_quantiles(df.limit(0), {"x": [0.5]}) == {"x": [None]}


def test_a_bracket_that_missed_is_widened(spark):
    """A sketch of only some of the values (an error far over the bound) still ends in the exact value."""
    from hourglass.functions.quantiles import order_statistics_many, sketches
    df = spark.range(20_000).select(F.col("id").cast("double").alias("x"))
    some = df.where("x % 2 = 0 or x < 2000 or x = 19999")
    assert order_statistics_many(df, {"x": [(9_000, 9_001)]}, {"x": 20_000}, sketches(some, ["x"])[1])["x"] == {9_000: 9_000.0, 9_001: 9_001.0}


def test_winsorize_matches_order_statistics(spark):
    vals = list(range(200))
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    out = sorted(r["x"] for r in clean.winsorize(df, ["x"]).collect())
    assert out[0] == 2.0 and out[-1] == 197.0  # k = int(0.01 * 200) = 2


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, float(i), None if i == 3 else float(i * 2)) for i in range(10)],
                               "c double, x double, y double")
    cm = {(r["col_a"], r["col_b"]): r["corr"] for r in profile.corr_matrix(df, ["c", "x", "y"]).collect()}
    assert cm[("c", "x")] is None and cm[("x", "x")] == 1.0
    assert abs(cm[("x", "y")] - 1.0) < 1e-12


def test_histogram_closes_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 4]], "x double")
    h = {r["bin"]: r["count"] for r in profile.histogram(df, "x", 4).collect()}
    assert h == {0: 1, 1: 1, 2: 1, 3: 2}


def test_null_profile_counts_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b")], "x double, s string")
    got = {r["column"]: r["n_null"] for r in profile.null_profile(df).collect()}
    assert got == {"x": 2, "s": 1}
