"""Profiling operators E1-E14.

Each profile is one aggregate pass (or one per distinct-value table) whose
small wide result row is unpivoted with ``explode(array(struct...))``.
Nothing iterates over collected rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, numeric_columns, trunc_ntz
from ..functions.quantiles import exact_quantiles, sketch_aggs
from ..session import checkpoint_dir, ship


def _unpivot(wide: DataFrame, structs) -> DataFrame:
    return wide.select(F.explode(F.array(*structs)).alias("_s")).select("_s.*")


def null_profile(df: DataFrame, cols: Sequence[str] | None = None, only_missing: bool = True) -> DataFrame:
    """NULL (or NaN) count and percent per column, only columns with any."""
    cols = list(cols) if cols is not None else df.columns
    types = dict(df.dtypes)

    def missing(c):
        m = F.col(c).isNull()
        return m | F.isnan(F.col(c)) if types[c] in ("double", "float") else m
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(missing(c)).alias(f"_m{i}") for i, c in enumerate(cols)])
    out = _unpivot(wide, [F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("n_null"),
                                   F.try_divide(F.col(f"_m{i}") * 100.0, F.col("_n")).alias("pct_null"))
                          for i, c in enumerate(cols)])
    return out.where(F.col("n_null") > 0) if only_missing else out


def describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, std (n-1), min, 25/50/75 % (exact, linear), max per numeric
    column, over finite values (NaN counts as NULL).  Two scans: moments and sketches, then the quartiles."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    df = finite(df.select(*cols))
    aggs, quartiles = [], [0.25, 0.5, 0.75]
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"),
                 *sketch_aggs(c, f"q{i}")]
    m = df.agg(*aggs).first()
    q = exact_quantiles(df, {c: quartiles for c in cols}, {c: m[f"q{i}_n"] for i, c in enumerate(cols)},
                        {c: m[f"q{i}_k"] for i, c in enumerate(cols)})
    rows = [(c, m[f"q{i}_n"], m[f"a{i}"], m[f"s{i}"], m[f"lo{i}"], q[c][0], q[c][1], q[c][2], m[f"hi{i}"])
            for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "column string, count bigint, mean double, std double, min double, "
                                                 "p25 double, p50 double, p75 double, max double")


def top_values(df: DataFrame, cols: Sequence[str], n: int = 10) -> DataFrame:
    """The ``n`` most frequent values per column (NULL counted as a value),
    with count, percent of rows and rank; ties broken by value.

    One scan: the (column, value) pairs of all columns are counted in one
    partial aggregation, and the counts are written once.  Per column a distributed top-n
    (``orderBy().limit()`` plans TakeOrderedAndProject: each task keeps its own
    n best) reads them, so a high-cardinality column never lands in one task.
    """
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("value"))
                                          for i, c in enumerate(cols)])).alias("_s")).select("_s.*")
    checkpoint_dir(df.sparkSession)
    counted = pairs.groupBy("i", "value").count().checkpoint(eager=True)
    total = counted.where("i = 0").agg(F.sum("count")).first()[0] or 0
    parts = None
    for i, c in enumerate(cols):
        g = (counted.where(F.col("i") == i).select("value", "count")
             .orderBy(F.col("count").desc(), F.col("value").asc_nulls_first()).limit(n)
             .withColumn("column", F.lit(c)))
        parts = g if parts is None else parts.unionByName(g)
    w = Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value").asc_nulls_first())
    ranked = parts.withColumn("pct", F.col("count") * 100.0 / F.lit(total)).withColumn("rank", F.row_number().over(w))
    return ranked.select("column", "rank", "value", "count", "pct")


def reduce_partials(parts: DataFrame, width: int):
    """Element-wise ``(sum, min, max)`` of the ``s`` arrays (one per task) as
    three numpy vectors of ``width``, or None when there are none.

    The reduction runs in Spark - ``posexplode``, partial aggregation inside
    each task, one shuffle by position - so the driver receives ``width`` rows
    however many partitions there are.
    """
    rows = (parts.select(F.posexplode("s").alias("pos", "v"))
            .groupBy("pos").agg(F.sum("v").alias("t"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .collect())
    if not rows:
        return None
    tot, lo, hi = np.zeros(width), np.zeros(width), np.zeros(width)
    for r in rows:
        tot[r["pos"]], lo[r["pos"]], hi[r["pos"]] = r["t"], r["lo"], r["hi"]
    return tot, lo, hi


def corr_matrix(df: DataFrame, cols: Sequence[str] | None = None, fill: float | None = None) -> DataFrame:
    """Pairwise-complete Pearson matrix in long form ``(col_a, col_b, corr)``.

    One pass for the column means (the shift that keeps the sums well
    conditioned), one pass where every task turns its Arrow batches into the
    masked sufficient statistics of all pairs with four matrix products
    (count, sums, sums of squares, cross products, plus masked min / max to
    spot constant columns) and returns a single row.  Those per-task rows are
    summed element-wise in Spark (:func:`reduce_partials`), so the driver gets
    ``O(d^2)`` numbers whatever the partition count.
    A pair with a constant column gets NULL (the SQL ``corr`` errors or gives
    NaN there).  ``fill`` replaces NULLs first (E4b).
    """
    import numpy as np
    import pandas as pd

    cols = list(cols) if cols is not None else numeric_columns(df)
    d = len(cols)
    x = finite(df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]))
    if fill is not None:
        x = x.na.fill(float(fill))
    means = x.agg(*[F.avg(f"c{i}").alias(f"c{i}") for i in range(d)]).first()
    shift = np.array([means[f"c{i}"] if means[f"c{i}"] is not None else 0.0 for i in range(d)])

    def stats(batches):
        acc = None
        for pdf in batches:
            a = pdf.to_numpy(dtype="float64", na_value=np.nan)
            m = ~np.isnan(a)
            mf = m.astype("float64")
            z = np.where(m, a - shift, 0.0)
            part = [mf.T @ mf, z.T @ mf, (z * z).T @ mf, z.T @ z]
            lo = np.full((d, d), np.inf)
            hi = np.full((d, d), -np.inf)
            for j in range(d):  # min / max of column i over rows where column j is present
                sel = m[:, j][:, None] & m
                lo[:, j] = np.where(sel, a, np.inf).min(axis=0)
                hi[:, j] = np.where(sel, a, -np.inf).max(axis=0)
            if acc is None:
                acc = part + [lo, hi]
            else:
                acc = [acc[k] + part[k] for k in range(4)] + [np.minimum(acc[4], lo), np.maximum(acc[5], hi)]
        if acc is not None:
            yield pd.DataFrame({"s": [np.concatenate([t.ravel() for t in acc]).tolist()]})

    ship(df.sparkSession)
    red = reduce_partials(x.mapInPandas(stats, "s array<double>"), 6 * d * d)
    spark = df.sparkSession
    schema = "col_a string, col_b string, corr double"
    if red is None:
        return spark.createDataFrame([(a, b, None) for a in cols for b in cols], schema)
    tot, low, high = (a.reshape(6, d, d) for a in red)
    n, sx, sxx, sxy = tot[0], tot[1], tot[2], tot[3]  # sx[i, j]: sum of col i where i and j present
    lo, hi = low[4], high[5]
    out = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            nn = n[i, j]
            const = not (lo[i, j] < hi[i, j]) or not (lo[j, i] < hi[j, i])
            if nn < 1 or const:
                out.append((a, b, None))
                continue
            cov = sxy[i, j] - sx[i, j] * sx[j, i] / nn
            va = sxx[i, j] - sx[i, j] ** 2 / nn
            vb = sxx[j, i] - sx[j, i] ** 2 / nn
            den = math.sqrt(va * vb) if va > 0 and vb > 0 else 0.0
            out.append((a, b, float(cov / den) if den > 0 else None))
    return spark.createDataFrame(out, schema)


def top_correlations(corr: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """E5: strongest absolute correlations between distinct columns, |r| = 1 (to
    within float noise, judged before rounding) dropped, each unordered pair
    once, ordered by strength then names."""
    x = (corr.where((F.col("col_a") < F.col("col_b")) & (F.abs("corr") < 1 - 1e-12))
         .select("col_a", "col_b", F.round(F.abs("corr"), digits).alias("abs_corr")))
    return x.orderBy(F.col("abs_corr").desc(), "col_a", "col_b").limit(k)


def duplicate_count(df: DataFrame) -> DataFrame:
    """Exact duplicate rows beyond the first, and their percent.

    One aggregation over all columns (map-side combined) counts copies per
    distinct row; a heavily copied row collapses before the shuffle.
    """
    g = df.groupBy(*df.columns).count()
    return g.agg(F.sum("count").alias("n_rows"), F.sum(F.col("count") - 1).alias("n_duplicates")) \
        .withColumn("pct_duplicates", F.col("n_duplicates") * 100.0 / F.col("n_rows"))


def date_profile(df: DataFrame, col: str) -> DataFrame:
    """Unparseable (or missing) dates, first and last date."""
    t = F.col(col).try_cast("timestamp_ntz") if dict(df.dtypes)[col] == "string" else F.col(col)
    return df.select(t.alias("_t")).agg(F.count_if(F.col("_t").isNull()).alias("n_unparseable"),
                                        F.min("_t").alias("min_date"), F.max("_t").alias("max_date"))


def resample(df: DataFrame, ts: str, unit: str, value: str, how: str = "sum",
             fill: float | None = None, out: str | None = None) -> DataFrame:
    """Aggregate a value per day or hour on the full time grid.

    Empty slots are 0 for a sum (pandas semantics) and NULL for a mean unless
    ``fill`` is given.  The grid spans the data's own first and last slot.
    """
    from ..plans.views import on_full_grid
    out = out or f"{how}_{value}"
    fn = {"sum": F.sum, "mean": F.avg, "count": F.count, "max": F.max, "min": F.min}[how]
    slot = f"{unit.lower()}_ts"
    agg = df.groupBy(trunc_ntz(ts, unit.lower()).alias(slot)).agg(fn(value).alias(out))
    if fill is None and how in ("sum", "count"):
        fill = 0
    g = on_full_grid(agg, ts=slot, unit=unit.upper(), fill={out: fill} if fill is not None else None)
    return g.select(slot, out)


def group_mean(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean of ``value`` per key, NULL keys dropped (partial aggregation)."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(value).alias(f"mean_{value}"))


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """``bins`` equal-width bins over [min, max], the last one closed, empty
    bins included with count 0."""
    spark = df.sparkSession
    df = finite(df.select(col))
    st = df.agg(F.min(col).alias("mn"), F.max(col).alias("mx")).first()
    mn, mx = st["mn"], st["mx"]
    grid = spark.range(bins).withColumnRenamed("id", "bin")
    if mn is None:
        return grid.select("bin", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
                           F.lit(0).cast("bigint").alias("count"))
    width = (mx - mn) / bins if mx > mn else 1.0
    b = F.least(F.floor((F.col(col) - F.lit(mn)) / F.lit(mx - mn if mx > mn else 1.0) * F.lit(bins)),
                F.lit(bins - 1)).cast("bigint")
    counts = df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).count()
    return (grid.join(counts, "bin", "left")
            .select("bin", (F.lit(mn) + F.col("bin") * F.lit(width)).alias("lo"),
                    (F.lit(mn) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
                    F.coalesce("count", F.lit(0)).alias("count")))


def box_stats(df: DataFrame, cols: Sequence[str], whisker: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at ``whisker`` IQR clipped to the data, outlier count."""
    df = finite(df.select(*cols))
    q = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in cols})
    aggs, structs = [], []
    for i, c in enumerate(cols):
        q1, med, q3 = q[c]
        if q1 is None:
            lo_f = hi_f = None
        else:
            lo_f, hi_f = q1 - whisker * (q3 - q1), q3 + whisker * (q3 - q1)
        x = F.col(c)
        inside = (x >= F.lit(lo_f)) & (x <= F.lit(hi_f))
        aggs += [F.min(F.when(inside, x)).alias(f"wl{i}"), F.max(F.when(inside, x)).alias(f"wh{i}"),
                 F.count_if(x.isNotNull() & ~inside).alias(f"o{i}")]
        structs.append(F.struct(F.lit(c).alias("column"), F.lit(q1).cast("double").alias("q1"),
                                F.lit(med).cast("double").alias("median"), F.lit(q3).cast("double").alias("q3"),
                                F.col(f"wl{i}").cast("double").alias("whisker_lo"),
                                F.col(f"wh{i}").cast("double").alias("whisker_hi"),
                                F.col(f"o{i}").alias("n_outliers")))
    return _unpivot(df.agg(*aggs), structs)


def kde(df: DataFrame, col: str, points: int = 200, cut: float = 3.0, bw: float | None = None) -> DataFrame:
    """Gaussian kernel density on an even grid of ``points`` values.

    Bandwidth by Scott's rule (``std * n^(-1/5)``) unless given; the grid spans
    ``[min - cut*bw, max + cut*bw]``.  The data is read once: every task sums
    the kernel of its own values at all grid points in bounded numpy blocks
    and returns one row, so rows are never paired with the grid in a join.
    """
    df = finite(df.select(col))
    st = df.agg(F.count(col).alias("n"), F.stddev_samp(col).alias("sd"),
                F.min(col).alias("mn"), F.max(col).alias("mx")).first()
    n, sd, mn, mx = st["n"], st["sd"], st["mn"], st["mx"]
    spark = df.sparkSession
    if not n or not sd:
        return spark.createDataFrame([], "point bigint, x double, density double")
    h = bw or sd * n ** (-0.2)
    lo, hi = mn - cut * h, mx + cut * h
    grid = np.array([lo + (hi - lo) * i / (points - 1) for i in range(points)])
    norm = 1.0 / (h * math.sqrt(2 * math.pi))

    def partial(batches):
        acc = np.zeros(points)
        for pdf in batches:
            v = pdf["v"].dropna().to_numpy(dtype="float64")
            for s in range(0, len(v), 4096):  # bounded (4096 x points) block
                u = (v[s:s + 4096, None] - grid[None, :]) / h
                acc += np.exp(-0.5 * u * u).sum(axis=0)
        yield pd.DataFrame({"s": [acc.tolist()]})

    ship(spark)
    # each task returns one row of partial kernel sums, reduced in Spark
    red = reduce_partials(df.select(F.col(col).cast("double").alias("v")).mapInPandas(partial, "s array<double>"),
                          points)
    total = red[0] / n * norm
    return spark.createDataFrame([(i, float(g), float(total[i])) for i, g in enumerate(grid)],
                                 "point bigint, x double, density double")


def sum_consistency(df: DataFrame, target: str, parts: Sequence[str]) -> DataFrame:
    """Rows where the target differs from the sum of its parts."""
    s = sum((F.col(p) for p in parts), F.lit(0))
    both = F.col(target).isNotNull() & s.isNotNull()
    return df.agg(F.count_if(both).alias("n_checked"), F.count_if(both & (F.col(target) != s)).alias("n_inconsistent"))
