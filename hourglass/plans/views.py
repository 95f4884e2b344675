"""Derived views over the driver tables (FIXTURES.md §3).

Each view has the same definition here (DataFrame API) and in
``oracle.py`` (SQL CTE), so every query is checked against an independent
engine.  All of them grow with the input tables; the modulo expressions only
inject NULLs / outliers into values, no row is filtered out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import trunc_ntz
from ..session import ensure_utc
from ..sources.tables import table

CASUAL_TYPES = ("view", "click")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_utc(spark)
    return table(spark, sf_dir, "events")


def hourly_counts(ev: DataFrame, ts: str = "ts") -> DataFrame:
    """Per-hour aggregate of an event frame (only hours that have events)."""
    return (ev.groupBy(trunc_ntz(ts, "hour").alias("hour_ts"))
            .agg(F.count(F.lit(1)).alias("n"),
                 F.count_if(F.col("event_type").isin(*CASUAL_TYPES)).alias("casual"),
                 F.avg("value").alias("avg_value")))


def on_full_grid(agg: DataFrame, ts: str = "hour_ts", unit: str = "HOUR",
                 fill: dict | None = None) -> DataFrame:
    """Left-join an aggregate onto the full time grid between its min and max.

    The aggregate (one row per time slot, bounded by the time span) is
    checkpointed once, so the bounds (one scalar row to the driver) and the
    join both read it and the source is scanned a single time.  The grid is a
    distributed ``spark.range`` with a dense ``<unit>_idx`` 0..N-1, so lags
    over it are plain index arithmetic and no single task generates or holds
    the grid.  ``fill`` gives values for empty slots.
    """
    import datetime as dt

    from ..session import checkpoint_dir

    idx_name = f"{unit.lower()}_idx"
    spark = agg.sparkSession
    checkpoint_dir(spark)
    agg = agg.checkpoint(eager=True)
    b = agg.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).first()
    lo, hi = b["lo"], b["hi"]
    if lo is None:
        spine = spark.createDataFrame([], f"{ts} timestamp_ntz, {idx_name} bigint")
    else:
        step = {"HOUR": dt.timedelta(hours=1), "DAY": dt.timedelta(days=1)}[unit.upper()]
        n = int((hi - lo) // step) + 1
        spine = spark.range(n).select(
            F.timestamp_add(unit.upper(), F.col("id"), F.lit(lo).cast("timestamp_ntz")).alias(ts),
            F.col("id").alias(idx_name))
    out = spine.join(agg, on=ts, how="left")
    if fill:
        out = out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})
    return out


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``hourly``: events per hour on the full hour grid (n = 0 when empty).

    ``n`` plays the target (total rentals), ``casual`` / ``registered`` the two
    banned summands.
    """
    agg = hourly_counts(events(spark, sf_dir).select("ts", "event_type", "value"))
    g = on_full_grid(agg, fill={"n": 0, "casual": 0})
    return g.select("hour_ts", "hour_idx", "n", "casual",
                    (F.col("n") - F.col("casual")).alias("registered"), "avg_value")


def hourly_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``hourly`` with the target NULL on every 50th hour."""
    h = hourly(spark, sf_dir)
    return h.withColumn("n", F.when(F.col("hour_idx") % 50 != 0, F.col("n")))


def events_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two weather-like columns with injected NULLs and outliers.

    ``v``: rare huge outliers, so the p99 clip fires (max > 10 * p99).
    ``w``: 5 % moderate outliers, so the clip does not fire but the
    absurd-value (>1000) and large-value (>50) rules do.
    """
    ev = events(spark, sf_dir)
    eid, val = F.col("event_id"), F.col("value")
    v = F.when(eid % 97 == 0, F.lit(None).cast("double")).when(eid % 499 == 0, val * 200).otherwise(val / 1000)
    w = F.when(eid % 97 == 0, F.lit(None).cast("double")).when(eid % 20 == 0, val * 5).otherwise(val / 1000)
    return ev.select("event_id", "ts", "event_type", v.alias("v"), w.alias("w"))


def events_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` plus a second copy of every row whose id is a multiple of 10."""
    ev = events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", "value")
    return ev.unionAll(ev.where(F.col("event_id") % 10 == 0))


def events_text_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``value`` as text with decimal commas; ``amount_txt`` has one bad cell."""
    ev = events(spark, sf_dir)
    txt = F.regexp_replace(F.col("value").cast("string"), r"\.", ",")
    bad = F.when(F.col("event_id") == 7, F.lit("n/a")).otherwise(txt)
    return ev.select("event_id", txt.alias("value_txt"), bad.alias("amount_txt"), "event_type")


def events_text_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ts`` as text, the word ``bad`` on every 100th event."""
    ev = events(spark, sf_dir)
    t = F.when(F.col("event_id") % 100 == 0, F.lit("bad")).otherwise(F.col("ts").cast("string"))
    return ev.select("event_id", t.alias("ts_txt"), "value")


def naive_forecast(spark: SparkSession, sf_dir: str, season: int = 24) -> DataFrame:
    """``hourly`` with a seasonal-naive prediction (the value ``season`` hours before)."""
    from ..operators.order import lag_columns
    h = hourly(spark, sf_dir).select("hour_ts", "hour_idx", "n")
    f = lag_columns(h, "hour_idx", "n", lags=[season])
    return f.select("hour_ts", "hour_idx", F.col("n").cast("double").alias("y"),
                    F.col(f"n_lag_{season}").cast("double").alias("pred"))


def rentals_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the reference's column layout, for the reference cleaning path.

    ``fecha`` is text (``bad`` on every 100th event), ``hora`` a whole-valued
    DOUBLE, ``total_alquileres`` NULL on every 50th event (its parts are
    ``u_casuales`` + ``u_registrados``), and the two weather columns are the
    dirty ``v`` / ``w`` of :func:`events_dirty`.
    """
    d = events_dirty(spark, sf_dir)
    eid = F.col("event_id")
    casual = F.col("event_type").isin(*CASUAL_TYPES).cast("bigint")
    return d.select(
        "event_id",
        F.when(eid % 100 == 0, F.lit("bad")).otherwise(F.col("ts").cast("string")).alias("fecha"),
        F.hour("ts").cast("double").alias("hora"),
        casual.alias("u_casuales"), (F.lit(1) - casual).alias("u_registrados"),
        F.when(eid % 50 != 0, F.lit(1.0)).alias("total_alquileres"),
        F.col("v").alias("sensacion_termica"), F.col("w").alias("velocidad_viento"))


# Forecasters scored from the data itself; the yearly one can never be scored
# on a shorter series, which gives the registry its "missing metrics" case.
FORECASTERS = ("naive_lag_1", "naive_lag_24", "naive_lag_168", "rolling_mean_24", "naive_lag_8760")


def forecasts_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, hour_ts, y, pred) for every forecaster over the hourly series."""
    from ..operators.order import lag_columns
    h = hourly(spark, sf_dir).select("hour_ts", "hour_idx", "n")
    f = lag_columns(h, "hour_idx", "n", lags=[1, 24, 168, 8760], windows=[24])
    preds = {"naive_lag_1": "n_lag_1", "naive_lag_24": "n_lag_24", "naive_lag_168": "n_lag_168",
             "rolling_mean_24": "n_rolling_mean_24", "naive_lag_8760": "n_lag_8760"}
    arr = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("pred"))
                    for m, c in preds.items()])
    return f.select("hour_ts", F.col("n").cast("double").alias("y"), F.explode(arr).alias("_p")) \
        .select("_p.model", "hour_ts", "y", "_p.pred")


def forecaster_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, n, rmse, mae over complete rows; NULL metrics when never scorable."""
    from ..operators.evaluate import regression_metrics
    m = regression_metrics(forecasts_long(spark, sf_dir), "y", "pred", group_by="model")
    names = spark.createDataFrame([(x,) for x in FORECASTERS], "model string")
    return names.join(m, "model", "left").select("model", F.coalesce("n", F.lit(0)).alias("n"), "rmse", "mae")
