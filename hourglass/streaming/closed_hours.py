"""A full hourly grid and its lags, kept by the stream itself.

``stream_hourly`` gives an hour once the watermark has passed its end, but only hours that had
events.  Here a second stateful step follows it: per series it holds the last closed hour and
the last ``max(lags)`` values, fills the hours between with zero, and closes hours up to the
watermark, also when no event comes any more (event-time timers).  The state is a few
numbers a series; it is seeded from a stored history, so lags reach back before the stream.

The step gets one row a series and hour, so its work follows time, not the events.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ensure_utc, ship

LAGS = (1, 24, 168)
HOUR_MS = 3_600_000
SERIES, HOUR = "series", "hour"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def hour_number(ts: str):
    """Whole hours since 1970 of a zone-less time."""
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / 3600).cast("bigint")


class ClosedHours(StatefulProcessor):
    """Rows (hour, n, casual, avg_value) of a series in any order -> every closed hour once, ascending."""

    def __init__(self, lags: Sequence[int]):
        self.lags = list(lags)
        self.reach = max(self.lags, default=0)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("series", "last bigint, ring array<bigint>")

    def _keep(self, last: int, ring: list[int]) -> None:
        self.state.update((last, ring[-self.reach:] if self.reach else []))
        self.handle.registerTimer((last + 2) * HOUR_MS)                # the end of the next hour

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        known = dict(zip(initialState[HOUR], initialState["n"]))
        last = int(max(known))
        self._keep(last, [int(known.get(h, 0)) for h in range(int(min(known)), last + 1)])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = {}
        for p in rows:
            for r in p.itertuples(index=False):
                got[int(r.hour)] = (int(r.n), int(r.casual), None if pd.isna(r.avg_value) else float(r.avg_value))
        yield from self._close(key, got, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._close(key, {}, timerValues)

    def _close(self, key, got: dict, timerValues) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() // HOUR_MS - 1    # the last hour that ends by the watermark
        if self.state.exists():
            last, ring = self.state.get()
            ring = list(ring or [])
        elif got:
            last, ring = min(got) - 1, []
        else:
            return
        out = []
        for h in range(int(last) + 1, int(upto) + 1):
            n, casual, avg = got.get(h, (0, 0, None))
            out.append((key[0], h, n, casual, avg, *(ring[-x] if len(ring) >= x else None for x in self.lags)))
            ring.append(n)
            if len(ring) > 2 * self.reach + 64:
                ring = ring[-self.reach:] if self.reach else []
        if out:
            self._keep(out[-1][1], ring)
            whole = ["hour", "n", "casual", *(f"n_lag_{x}" for x in self.lags)]
            df = pd.DataFrame(out, columns=[SERIES, "hour", "n", "casual", "avg_value", *whole[3:]])
            yield df.astype({**{c: "Int64" for c in whole}, "avg_value": "Float64"})

    def close(self) -> None:
        pass


def hourly_grid_stream(hours: DataFrame, history: DataFrame | None = None, lags: Sequence[int] = LAGS, series: str | None = None) -> DataFrame:
    """Every closed hour of ``hours`` (:func:`stream_hourly`, with the column ``series`` if there are several), also
    hours without events (n = 0), with ``n_lag_*`` from the state.

    ``history``: (hour_ts, n[, series]), the hours up to where the stream starts; the grid goes on after its last one, and
    hours of the stream up to there are taken as known.  Without it the grid starts at the first closed hour.
    """
    spark = hours.sparkSession
    ensure_utc(spark)
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)     # what arbitrary state with timers needs
    name = F.col(series).cast("string") if series else F.lit("")
    rows = hours.select(name.alias(SERIES), hour_number("hour_ts").alias(HOUR), "n", "casual", "avg_value")
    seed = None
    if history is not None:
        h = history.select((F.col(series).cast("string") if series else F.lit("")).alias(SERIES), hour_number("hour_ts").alias(HOUR),
                           F.col("n").cast("bigint").alias("n"))
        ends = h.groupBy(SERIES).agg(F.max(HOUR).alias("_end"))
        seed = h.join(ends, SERIES).where(F.col(HOUR) > F.col("_end") - max(max(lags, default=0), 1)).drop("_end").groupBy(SERIES)
    kind = f"{SERIES} string, hour bigint, n bigint, casual bigint, avg_value double" + "".join(f", n_lag_{x} bigint" for x in lags)
    grid = rows.groupBy(SERIES).transformWithStateInPandas(ClosedHours(lags), kind, "append", "eventtime", initialState=seed)
    hour = F.timestamp_seconds(F.col("hour") * 3600).cast("timestamp_ntz")
    return grid.select(*([F.col(SERIES).alias(series)] if series else []), hour.alias("hour_ts"), "n", "casual",
                       (F.col("n") - F.col("casual")).alias("registered"), "avg_value", *[f"n_lag_{x}" for x in lags])


def score_grid_stream(grid: DataFrame, model: PipelineModel, lags: Sequence[int] = LAGS, keep: Sequence[str] = ("hour_ts",)) -> DataFrame:
    """R2: the closed hours whose lags are all known, with calendar features, scored by a stored model."""
    from ..operators.features import calendar_features
    known = F.lit(True)
    for x in lags:
        known = known & F.col(f"n_lag_{x}").isNotNull()
    out = model.transform(calendar_features(grid.where(known), "hour_ts", "hourly"))
    return out.select(*keep, "pred")
