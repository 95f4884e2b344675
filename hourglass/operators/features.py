"""Feature operators F1-F11: calendar, lags, rolling means, encodings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite_or_null_col, is_weekend, numeric_columns, weekday_mon0
from ..session import checkpoint_dir
from .lookup import lookup_join
from .order import _cols, lag_columns, with_row_index

DEFAULT_LAGS = (1, 24, 168)
BANNED = ("u_casuales", "u_registrados")


def calendar_features(df: DataFrame, ts: str, kind: str = "hourly") -> DataFrame:
    """F1 / F2: calendar columns from a timestamp (all BIGINT).

    ``kind="daily"`` (set A): year, month, day, dayofweek (Mon=0), is_weekend.
    ``kind="hourly"`` (set B): hour, dayofweek, month, is_weekend.
    """
    t = F.col(ts)
    dow = weekday_mon0(t)
    if kind == "daily":
        cols = {"year": F.year(t).cast("bigint"), "month": F.month(t).cast("bigint"),
                "day": F.dayofmonth(t).cast("bigint"), "dayofweek": dow, "is_weekend": is_weekend(dow)}
    elif kind == "hourly":
        cols = {"hour": F.hour(t).cast("bigint"), "dayofweek": dow,
                "month": F.month(t).cast("bigint"), "is_weekend": is_weekend(dow)}
    else:
        raise ValueError(kind)
    return df.withColumns(cols)


def with_event_time(df: DataFrame, date_col: str = "fecha", hour_col: str = "hora",
                    out: str = "ts") -> DataFrame:
    """``ts = date + hour hours`` when an hour column exists, else the date itself."""
    d = F.try_to_timestamp(F.col(date_col).cast("string")).cast("timestamp_ntz") \
        if dict(df.dtypes)[date_col] == "string" else F.col(date_col).cast("timestamp_ntz")
    if hour_col in df.columns:
        d = F.timestamp_add("HOUR", F.coalesce(F.col(hour_col).cast("int"), F.lit(0)), d)
    return df.withColumn(out, d)


def add_lags(df: DataFrame, col: str, lags: Sequence[int] = DEFAULT_LAGS,
             windows: Sequence[int] = (), order_by=None, partition_by=None,
             mode: str = "row", index_col: str | None = None, ts_col: str | None = None,
             keep_index: bool = False) -> DataFrame:
    """Lags ``<col>_lag_<l>`` and prior rolling means ``<col>_rolling_mean_<w>``.

    ``mode="row"`` (reference semantics): shift by rows in the total order
    ``(partition_by, order_by)``.  If ``index_col`` names an existing dense
    0-based index (e.g. an hour number on a full grid) it is used directly,
    otherwise a distributed row index is built first.

    ``mode="time"``: the value exactly ``l`` hours earlier in ``ts_col`` for the
    same key, NULL when that hour is absent (gap-safe).  Rolling means are
    row-based only.
    """
    if mode == "time":
        return time_lags(df, col, ts_col or _cols(order_by)[0], lags, partition_by)
    if index_col is None:
        index_col = "_hg_idx"
        df = with_row_index(df, order_by, partition_by, index_col=index_col)
        out = lag_columns(df, index_col, col, lags, windows, partition_by)
        return out if keep_index else out.drop(index_col)
    return lag_columns(df, index_col, col, lags, windows, partition_by)


def time_lags(df: DataFrame, col: str, ts_col: str, lags: Sequence[int] = DEFAULT_LAGS,
              partition_by=None, unit: str = "HOUR") -> DataFrame:
    """time-shift lags by an equi-join on ``(key, ts)``.

    The source side is exploded once into one copy per lag (shifted forward by
    ``l`` units) and pivoted to one row per ``(key, ts)``, so all lags cost one
    aggregation and one join; the composite join key spreads a hot key over
    many partitions.  ``(key, ts)`` must be unique.
    """
    keys = [str(k) for k in _cols(partition_by)]
    lags = [int(l) for l in lags]
    shifted = (df.select(*keys, ts_col, col)
               .withColumn("_hg_l", F.explode(F.array(*[F.lit(l) for l in lags])))
               .withColumn(ts_col, F.timestamp_add(unit, F.col("_hg_l"), F.col(ts_col))))
    wide = (shifted.groupBy(*keys, ts_col)
            .agg(*[F.max(F.when(F.col("_hg_l") == l, F.col(col))).alias(f"{col}_lag_{l}") for l in lags]))
    return df.join(wide, on=[*keys, ts_col], how="left")


def history_lags(hourly: DataFrame, history: DataFrame, value: str = "n", lags=DEFAULT_LAGS,
                 ts: str = "hour_ts") -> DataFrame:
    """Lags of a (streaming) hourly frame looked up in a static history table:
    one stream-static left join per lag on ``hour - l hours``.  Stateless, so
    no lag state is kept in the stream; the history (one row per hour) is the
    small side."""
    out = hourly
    for lag in lags:
        h = history.select(F.col(ts).alias(f"_hg_h{lag}"), F.col(value).alias(f"{value}_lag_{lag}"))
        cond = F.col(f"_hg_h{lag}") == F.timestamp_add("HOUR", F.lit(-lag), F.col(ts))
        out = out.join(h, cond, "left").drop(f"_hg_h{lag}")
    return out


def label_encode(df: DataFrame, cols: Sequence[str], suffix: str = "",
                 mapping: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """integer codes by sorted category (0-based), NULL -> -1.

    The mapping ``(column, value, code)`` is fitted once (see
    :func:`fit_label_mapping`), can be stored and re-applied (D11), and is
    joined back per column through :func:`lookup_join`: broadcast when its
    measured size is small, shuffled otherwise.  Returns ``(encoded, mapping)``.
    """
    cols = list(cols)
    if mapping is None:
        mapping, sizes = _fit_label_mapping(df, cols)
    else:
        sizes = {r["column"]: r["count"] for r in mapping.groupBy("column").count().collect()}  # one row per column
    out = df
    for c in cols:
        m = (mapping.filter(F.col("column") == c)
             .select(F.col("value").alias(f"_hg_v_{c}"), F.col("code").alias(f"_hg_code_{c}")))
        out = (lookup_join(out, m, out[c].cast("string") == m[f"_hg_v_{c}"], "left", rows=sizes.get(c, 0))
               .withColumn(c + suffix, F.coalesce(F.col(f"_hg_code_{c}"), F.lit(-1).cast("bigint")))
               .drop(f"_hg_v_{c}", f"_hg_code_{c}"))
    return out, mapping


def fit_label_mapping(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, value, code)``: code = rank of the value among the column's
    sorted distinct non-null values, 0-based."""
    return _fit_label_mapping(df, cols)[0]


def _fit_label_mapping(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, dict[str, int]]:
    """The distinct ``(column, value)`` pairs are checkpointed and counted per
    column (one row per column).  They get a distributed row index over ``(column,
    value)`` (range-partitioned over many tasks, so a billion user ids are
    no task's burden), and a code is the index minus the column's start offset,
    taken from the same counts.  Returns the mapping and the per-column sizes."""
    allv = (df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                          for c in cols])).alias("_s")).select("_s.*")
            .where(F.col("value").isNotNull()).distinct())  # one scan for all columns
    checkpoint_dir(df.sparkSession)
    allv = allv.checkpoint(eager=True)
    sizes = {r["column"]: r["count"] for r in allv.groupBy("column").count().collect()}
    indexed = with_row_index(allv, ["column", "value"], index_col="_hg_idx")
    starts, running = [F.lit(""), F.lit(0)], 0
    for c in sorted(sizes):  # the index runs through the columns in sorted order
        starts += [F.lit(c), F.lit(running)]
        running += sizes[c]
    start = F.element_at(F.create_map(*starts), F.col("column"))
    mapping = indexed.select("column", "value", (F.col("_hg_idx") - start).cast("bigint").alias("code"))
    return mapping, sizes


def log1p_target(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """F8: ``log1p`` of the target (inverse: :func:`expm1_col`)."""
    return df.withColumn(out or f"{col}_log1p", F.log1p(F.col(col)))


def expm1_col(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, F.expm1(F.col(col)))


def target_encode(train: DataFrame, apply_to: DataFrame, col: str, target: str,
                  out: str | None = None, smoothing: float = 0.0) -> DataFrame:
    """mean target per category fitted on ``train`` only, joined onto
    ``apply_to``; unseen categories get the global train mean.

    With ``smoothing=m`` the encoding is ``(sum + m*global)/(count + m)``.
    The fit is one pass: a partial aggregation (map-side combine) per
    category, checkpointed; the global mean comes from those sums, and the
    table is measured and joined by :func:`lookup_join`.
    """
    out = out or f"{col}_te"
    checkpoint_dir(train.sparkSession)
    stats = (train.groupBy(col).agg(F.sum(target).alias("_hg_s"), F.count(target).alias("_hg_n"))
             .checkpoint(eager=True))  # the only pass over train
    # the global mean from the per-category sums (the NULL category included)
    g = stats.agg(F.try_divide(F.sum("_hg_s"), F.sum("_hg_n"))).first()[0]
    enc = stats.select(col, F.try_divide(F.col("_hg_s") + F.lit(smoothing) * F.lit(g),
                                         F.col("_hg_n") + F.lit(smoothing)).alias(out))
    return lookup_join(apply_to, enc, col, "left").withColumn(out, F.coalesce(F.col(out), F.lit(g)))


def one_hot(df: DataFrame, col: str, values: Sequence, prefix: str | None = None) -> DataFrame:
    """indicator columns for the given category values."""
    prefix = prefix or col
    return df.withColumns({f"{prefix}_{v}": F.coalesce(F.col(col) == F.lit(v), F.lit(False)).cast("bigint") for v in values})


def interaction(df: DataFrame, a: str, b: str, out: str | None = None, numeric: bool = True) -> DataFrame:
    """interaction term ``a x b`` (product, or a ``a_b`` category label)."""
    out = out or f"{a}_x_{b}"
    if numeric:
        return df.withColumn(out, F.col(a) * F.col(b))
    return df.withColumn(out, F.concat_ws("_", F.col(a).cast("string"), F.col(b).cast("string")))


def feature_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """P10: every column that is not excluded (date, target, ids, banned)."""
    ex = set(exclude)
    return [c for c in df.columns if c not in ex]


def prepare_features(df: DataFrame, target: str, ts: str, exclude: Sequence[str] = BANNED,
                     lags: Sequence[int] = DEFAULT_LAGS, windows: Sequence[int] = (),
                     index_col: str | None = None, order_by=None, partition_by=None,
                     id_cols: Sequence[str] = (), encode: Sequence[str] | None = None,
                     keep: Sequence[str] = (), hour_col: str | None = None) -> DataFrame:
    """event time -> calendar -> lags -> drop banned -> inf to NULL -> encode -> drop incomplete.

    With ``hour_col`` (D6) ``ts`` is a date column and the event time is date + hour; a
    column ``ts`` with that time takes its place.

    Lags are computed once on the whole ordered series (D8).  The target column
    may be absent (scoring frame); then it is added as NULL and rows are not
    dropped for it.  ``keep`` columns (e.g. the timestamp) ride along untouched.
    """
    if hour_col is not None:
        df = with_event_time(df, ts, hour_col, out=ts)
    df = calendar_features(df, ts, "hourly")
    has_target = target in df.columns
    if not has_target:
        df = df.withColumn(target, F.lit(None).cast("double"))
    elif lags or windows:
        df = add_lags(df, target, lags, windows, order_by=order_by or [ts], partition_by=partition_by,
                      index_col=index_col)
    df = df.drop(*[c for c in exclude if c in df.columns])
    num = numeric_columns(df)
    df = df.withColumns({c: finite_or_null_col(c) for c in num if dict(df.dtypes)[c] in ("double", "float")})
    drop_ids = set(id_cols) | ({index_col} if index_col else set())
    feats = [c for c in feature_columns(df, [ts, target, *drop_ids, *keep])]
    enc_cols = list(encode) if encode is not None else [c for c in feats if dict(df.dtypes)[c] == "string"]
    if enc_cols:
        df, _ = label_encode(df, enc_cols)
    subset = feats + ([target] if has_target else [])
    return df.select(*keep, *[c for c in [ts] if c not in keep], target, *feats).na.drop(subset=subset)
