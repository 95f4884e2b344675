"""What counts as a number in text (S1, P6), queries without a vector (M4), and unknown lags."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from hourglass.operators import models, schema
from hourglass.operators.score import score
from hourglass.session import scratch_path
from hourglass.sources import artefacts
from hourglass.sources.tables import read_table, require


def test_java_suffixes_are_text(spark):
    path = scratch_path(spark, "grammar")
    spark.createDataFrame([("5d,1,1.5,1e3,+7",), ("7f,2,.5,-2E-1,NA",), ("NA,3L,2.,inf,-0",)], "value string").coalesce(1).write.text(path)
    df = read_table(spark, path, fmt="csv", header=False)
    assert [t for _, t in df.dtypes] == ["string", "string", "double", "double", "bigint"]
    assert [tuple(r) for r in df.orderBy("_c2").collect()] == [
        ("7f", "2", 0.5, -0.2, None), ("5d", "1", 1.5, 1000.0, 7), (None, "3L", 2.0, None, 0)]
    typed = read_table(spark, path, schema="a double, b int, c double, d double, e int", fmt="csv", header=False)
    assert sorted((tuple(r) for r in typed.select("a", "b").collect()), key=str) == sorted([(None, 1), (None, 2), (None, None)], key=str)


def test_decimal_commas_need_plain_numbers(spark):
    df = spark.createDataFrame([("1,5", "5d", "1,5f"), ("-2", "7f", "2"), (None, None, None)], "a string, b string, c string")
    out = schema.strings_to_numeric(df)
    assert [t for _, t in out.dtypes] == ["double", "string", "string"]
    assert [r["a"] for r in out.collect()] == [1.5, -2.0, None]


def test_missing_paths_and_columns_fail_at_once(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        read_table(spark, scratch_path(spark, "nowhere"), fmt="csv")
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert require(df, ["a", "b"]) is df
    with pytest.raises(KeyError, match="c"):
        require(df, ["a", "c"])


def test_every_query_row_gets_an_answer(spark):
    kind = "id int, v array<double>, y double"
    train = spark.createDataFrame([(1, [0.0, 0.0], 1.0), (2, [1.0, 0.0], 3.0), (3, None, 9.0)], kind)
    query = spark.createDataFrame([(7, [0.1, 0.0], None), (8, None, None), (None, [1.0, 0.0], None)], kind)
    got = {r["id"]: r["pred"] for r in models.knn_regress(train, query, 1, "v", "y", "id").collect()}
    assert got == {7: 1.0, 8: None, None: 3.0}
    none = {r["id"]: r["pred"] for r in models.knn_regress(train.limit(0), query, 1, "v", "y", "id").collect()}
    assert none == {7: None, 8: None, None: None}
    blank = models.knn_regress(train, query.where("v is null"), 1, "v", "y", "id").collect()
    assert [tuple(r) for r in blank] == [(8, None)]


def test_unknown_lags_stay_unknown_unless_asked(spark):
    hours = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=h) for h in range(30)]
    history = spark.createDataFrame([(t, float(i)) for i, t in enumerate(hours)], "hour_ts timestamp_ntz, n double")
    base = scratch_path(spark, "unknown")
    train = history.select((F.col("n") - 2).alias("n_lag_2"), "n")
    artefacts.save_model(models.fit_linear(train, ["n_lag_2"], "n", reg=0.0), base, "m", None)
    plain, filled = ({r["hour_ts"]: r["pred"] for r in score(history.select("hour_ts"), base, "m", ts="hour_ts", keep=["hour_ts"], history=history,
                                                             **f).collect()} for f in ({}, {"fill": 0}))
    assert plain[hours[0]] is None and plain[hours[1]] is None
    assert plain[hours[10]] == pytest.approx(10.0) and filled[hours[10]] == pytest.approx(10.0)
    assert filled[hours[0]] == pytest.approx(2.0)
