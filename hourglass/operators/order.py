"""Total order without a single-partition window.

``Window.orderBy(...)`` with no partition key plans ``Exchange SinglePartition``:
one task sees every row.  Two pieces replace it:

``with_row_index``
    A dense 0-based index over a total order.  The rows are range-partitioned
    on the order (the sampled bounds split even a hot key, because the order is
    unique), sorted inside each partition, and tagged with partition id and
    position.  That tagged frame is written as a Parquet table under the shared
    checkpoint folder, which fixes the layout (range bounds are sampled and a
    recompute could move rows), survives lost executors, and - unlike a row
    checkpoint - is columnar: the per-partition count reads one 8-byte column
    and later reads prune to the columns they use.  Per-partition counts - one
    row per partition, a proven size bound - give each partition's offset; the
    index is that offset plus the stored position, so how the files are split
    on reading does not matter.

``bucketed_window``
    Lags and trailing frames over a dense index.  Rows are grouped into
    buckets of ``bucket_rows`` consecutive index values; the last ``halo`` rows
    of each bucket are copied into the next one, so a window partitioned by
    ``(bucket, key)`` sees every row a lag or frame of length <= halo needs.
    Buckets have equal size by construction, so a hot key is split over many
    tasks instead of landing in one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

_POS_BITS = 33  # monotonically_increasing_id = partition_id << 33 | position


def _cols(x) -> list:
    if x is None:
        return []
    if isinstance(x, (str, Column)):
        return [x]
    return list(x)


def with_row_index(df: DataFrame, order_by, partition_by=None, index_col: str = "row_idx",
                   num_partitions: int | None = None, materialize: bool = True) -> DataFrame:
    """add a dense 0-based ``index_col`` following ``(partition_by, order_by)``.

    The order should be total (append a unique tie-break column); ties get an
    arbitrary but fixed order.  Rows of one ``partition_by`` key are contiguous.
    ``materialize=False`` skips the written table (only for inputs whose
    recompute is known to reproduce the same layout).
    """
    spark = df.sparkSession
    # NULL keys come last, so an unparsed date never heads the series
    keys = [F.col(k).asc_nulls_last() if isinstance(k, str) else k for k in _cols(partition_by) + _cols(order_by)]
    if not keys:
        raise ValueError("with_row_index needs an order")
    ranged = (df.repartitionByRange(num_partitions, *keys) if num_partitions
              else df.repartitionByRange(*keys))
    tagged = (ranged.sortWithinPartitions(*keys)
              .withColumn("_hg_mid", F.monotonically_increasing_id()))
    if materialize:
        path = scratch_path(spark, "row_index")
        tagged.write.parquet(path)
        tagged = spark.read.parquet(path)
    tagged = tagged.withColumn("_hg_pid", F.shiftright("_hg_mid", _POS_BITS))
    counts = tagged.groupBy("_hg_pid").count().collect()  # one row per partition
    offsets, running = [], 0
    for row in sorted(counts, key=lambda r: r["_hg_pid"]):
        offsets.append((int(row["_hg_pid"]), running))
        running += int(row["count"])
    # one (partition, offset) row per partition: a proven size bound, so it is
    # broadcast; as a table (not a literal map) it stays cheap to plan for
    # 100k partitions
    off = spark.createDataFrame(offsets, "_hg_pid bigint, _hg_off bigint")
    pos = F.col("_hg_mid") - F.shiftleft(F.col("_hg_pid"), _POS_BITS)
    return (tagged.join(F.broadcast(off), "_hg_pid", "inner")
            .withColumn(index_col, (F.col("_hg_off") + pos).cast("bigint"))
            .drop("_hg_mid", "_hg_pid", "_hg_off"))


def default_bucket_rows(halo: int) -> int:
    return max(1 << 12, 32 * max(halo, 1))


def bucketed_window(df: DataFrame, index_col: str, halo: int, partition_by=None,
                    bucket_rows: int | None = None) -> tuple[DataFrame, Window, Column]:
    """Prepare ``df`` for lag / trailing-frame windows over a dense index.

    Returns ``(frame, window, keep)``: evaluate window expressions over
    ``window`` on ``frame`` and then ``filter(keep)`` and drop the helper
    columns with :func:`drop_window_helpers`.
    """
    b = int(bucket_rows or default_bucket_rows(halo))
    if halo > b:
        raise ValueError("halo must not exceed bucket_rows")
    idx = F.col(index_col)
    base = F.floor(idx / F.lit(b)).cast("bigint")
    in_tail = (idx - base * F.lit(b)) >= F.lit(b - halo) if halo > 0 else F.lit(False)
    # each row once in its own bucket; tail rows once more as halo of the next bucket
    shift = F.explode(F.when(in_tail, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    frame = (df.withColumn("_hg_shift", shift)
             .withColumn("_hg_bucket", base + F.col("_hg_shift")))
    window = Window.partitionBy("_hg_bucket", *_cols(partition_by)).orderBy(index_col)
    return frame, window, F.col("_hg_shift") == 0


def drop_window_helpers(df: DataFrame) -> DataFrame:
    return df.drop("_hg_shift", "_hg_bucket")


def lag_columns(df: DataFrame, index_col: str, col: str, lags: Sequence[int] = (),
                windows: Sequence[int] = (), partition_by=None,
                bucket_rows: int | None = None, prefix: str | None = None) -> DataFrame:
    """Row lags ``<col>_lag_<l>`` and prior rolling means ``<col>_rolling_mean_<w>``
    (mean of the ``w`` rows before, fewer at the start, never the current row)
    over a dense index, per ``partition_by`` key."""
    lags, windows = [int(x) for x in lags], [int(x) for x in windows]
    halo = max(lags + windows + [0])
    frame, w, keep = bucketed_window(df, index_col, halo, partition_by, bucket_rows)
    prefix = prefix or col
    exprs = [F.lag(col, l).over(w).alias(f"{prefix}_lag_{l}") for l in lags]
    exprs += [F.avg(col).over(w.rowsBetween(-k, -1)).alias(f"{prefix}_rolling_mean_{k}") for k in windows]
    out = frame.select("*", *exprs).filter(keep)
    return drop_window_helpers(out)
