"""Property checks: the scalable pieces against plain numpy /
pandas on random inputs with ties, hot values and odd partitionings."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from hourglass.functions.quantiles import exact_quantiles
from hourglass.operators import split
from hourglass.operators.order import lag_columns, with_row_index

SETTINGS = settings(max_examples=6, deadline=None, derandomize=True,
                    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])

values = st.lists(st.one_of(st.sampled_from([0.0, 1.5, -2.0, 7.25]),  # repeated values: ties and hot runs
                            st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False).map(lambda v: round(v, 2))),
                  min_size=1, max_size=400)


@SETTINGS
@given(vals=values, parts=st.integers(1, 5), limit=st.integers(1, 40), acc=st.sampled_from([8, 50, 10_000]),
       probs=st.lists(st.floats(0, 1), min_size=1, max_size=4))
def test_exact_quantiles_equal_numpy(spark, vals, parts, limit, acc, probs):
    """Bracketing (tiny direct limit, coarse sketches) is exact: numpy's linear rule."""
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(parts)
    got = exact_quantiles(df, {"x": probs}, direct_limit=limit, accuracy=acc)["x"]
    assert np.allclose(got, np.quantile(np.array(vals), probs), rtol=1e-12, atol=1e-9)


@SETTINGS
@given(keys=st.lists(st.integers(0, 6), min_size=1, max_size=300), parts=st.integers(1, 6))
def test_row_index_is_the_sorted_position(spark, keys, parts):
    rows = [(k, i) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "k int, id int").repartition(parts)
    got = sorted((r["row_idx"], r["k"], r["id"]) for r in with_row_index(df, ["k", "id"]).collect())
    assert got == [(i, k, j) for i, (k, j) in enumerate(sorted(rows))]


@SETTINGS
@given(keys=st.lists(st.integers(0, 3), min_size=1, max_size=300), lag=st.integers(1, 9),
       window=st.integers(1, 9), extra=st.integers(0, 20))
def test_bucketed_lags_equal_pandas_shift(spark, keys, lag, window, extra):
    """Buckets just above the halo force copies across every bucket edge."""
    pdf = pd.DataFrame({"key": keys, "t": range(len(keys)), "v": [float((i * 37) % 11) for i in range(len(keys))]})
    idx = with_row_index(spark.createDataFrame(pdf).repartition(3), ["t"], partition_by=["key"])
    got = (lag_columns(idx, "row_idx", "v", lags=[lag], windows=[window], partition_by=["key"],
                       bucket_rows=max(lag, window) + extra)
           .toPandas().sort_values(["key", "t"]).reset_index(drop=True))
    g = pdf.sort_values(["key", "t"]).reset_index(drop=True).groupby("key")["v"]
    assert np.allclose(got[f"v_lag_{lag}"].astype(float), g.shift(lag), equal_nan=True)
    exp = g.transform(lambda s: s.shift(1).rolling(window, min_periods=1).mean())
    assert np.allclose(got[f"v_rolling_mean_{window}"].astype(float), exp, equal_nan=True)


@SETTINGS
@given(n=st.integers(1, 300), frac=st.floats(0.05, 0.95))
def test_time_split_is_an_ordered_partition(spark, n, frac):
    df = spark.createDataFrame([(i, (i * 7919) % n) for i in range(n)], "id int, t int")
    idx = with_row_index(df, ["t", "id"])
    train, test = split.time_split(idx, "row_idx", frac)
    tr = [(r["t"], r["id"]) for r in train.collect()]
    te = [(r["t"], r["id"]) for r in test.collect()]
    assert len(tr) == int(n * frac) and len(tr) + len(te) == n
    assert not tr or not te or max(tr) < min(te)
