"""Cleaning operators C1-C13.

Every data-dependent threshold (p99, median, max, order statistics) comes from
one statistics pass over all columns, fetched as a single small row, and is
then applied in one projection - the operator never loops an aggregate per
column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite, finite_or_null_col, numeric_columns, string_columns
from ..functions.quantiles import exact_quantiles, order_statistics_many, sketch_aggs, sketches
from .schema import narrow_integers, parse_ts

# Column names of the rental data.
WEATHER_COLS = ("sensacion_termica", "velocidad_viento")
INT_COLS = ("hora", "dia_semana", "mes", "anio", "temporada", "feriado", "dia_trabajo", "clima")

# Fixed values of the reference's outlier rules.
CLIP_RATIO = 10      # clip to p99 when max > CLIP_RATIO * p99 (and p99 > 0)
ABSURD_ABOVE = 1000  # values above this become NULL
LARGE_ABOVE = 50     # with median < 1: values above this become NULL and are flagged
SMALL_MEDIAN = 1


def repair_sum(df: DataFrame, target: str, parts: Sequence[str]) -> DataFrame:
    """A NULL target becomes the sum of its parts (a NULL part counts 0)."""
    if target not in df.columns or not all(p in df.columns for p in parts):
        return df
    total = sum((F.coalesce(F.col(p), F.lit(0)) for p in parts), F.lit(0))
    return df.withColumn(target, F.coalesce(F.col(target), total.cast(df.schema[target].dataType)))


def outlier_stats(df: DataFrame, cols: Sequence[str]) -> dict[str, dict]:
    """max, median and p99 of each column (non-null values), one small row."""
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return {}
    q = exact_quantiles(df, {c: [0.5, 0.99, 1.0] for c in cols})
    return {c: {"median": q[c][0], "p99": q[c][1], "max": q[c][2]} for c in cols}


def clip_rules(df: DataFrame, cols: Sequence[str], stats: dict | None = None) -> DataFrame:
    """C2 + C3 + C4 in the reference order, thresholds taken before any change.

    C2: if ``p99 > 0 and max > 10 * p99``: values above p99 become p99, flag
    ``<c>_outlier_clipped``.  C3: values above 1000 become NULL.  C4: if
    ``median < 1 and max > 50``: values above 50 become NULL, flag
    ``<c>_outlier_large``.  Both flags are always emitted (false when the rule
    did not fire) so the output schema does not depend on the data.
    """
    df = finite(df, cols)
    stats = stats if stats is not None else outlier_stats(df, cols)
    out = {}
    for c, s in stats.items():
        x = F.col(c)
        fire_clip = s["max"] is not None and s["p99"] > 0 and s["max"] > CLIP_RATIO * s["p99"]
        fire_large = s["max"] is not None and s["median"] < SMALL_MEDIAN and s["max"] > LARGE_ABOVE
        clipped = F.coalesce(x > F.lit(s["p99"]), F.lit(False)) if fire_clip else F.lit(False)
        v = F.when(clipped, F.lit(s["p99"])).otherwise(x) if fire_clip else x
        v = F.when(v > F.lit(ABSURD_ABOVE), F.lit(None)).otherwise(v)
        large = F.coalesce(v > F.lit(LARGE_ABOVE), F.lit(False)) if fire_large else F.lit(False)
        if fire_large:
            v = F.when(large, F.lit(None)).otherwise(v)
        out[c] = v.cast("double")
        out[f"{c}_outlier_clipped"] = clipped
        out[f"{c}_outlier_large"] = large
    return df.withColumns(out)


def clip_p99(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """C2 alone."""
    df = finite(df, cols)
    stats = outlier_stats(df, cols)
    out = {}
    for c, s in stats.items():
        fire = s["max"] is not None and s["p99"] > 0 and s["max"] > CLIP_RATIO * s["p99"]
        flag = F.coalesce(F.col(c) > F.lit(s["p99"]), F.lit(False)) if fire else F.lit(False)
        out[c] = F.when(flag, F.lit(s["p99"])).otherwise(F.col(c)).cast("double")
        out[f"{c}_outlier_clipped"] = flag
    return df.withColumns(out)


def null_above(df: DataFrame, cols: Sequence[str], limit: float = ABSURD_ABOVE) -> DataFrame:
    """Values above ``limit`` become NULL (and NaN)."""
    df = finite(df, cols)
    return df.withColumns({c: F.when(F.col(c) > F.lit(limit), F.lit(None)).otherwise(F.col(c)) for c in cols})


def null_large(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """C4 alone: when ``median < 1 and max > 50``, values above 50 become NULL."""
    df = finite(df, cols)
    stats = outlier_stats(df, cols)
    out = {}
    for c, s in stats.items():
        fire = s["max"] is not None and s["median"] < SMALL_MEDIAN and s["max"] > LARGE_ABOVE
        flag = F.coalesce(F.col(c) > F.lit(LARGE_ABOVE), F.lit(False)) if fire else F.lit(False)
        out[c] = F.when(flag, F.lit(None)).otherwise(F.col(c))
        out[f"{c}_outlier_large"] = flag
    return df.withColumns(out)


def finite_or_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NaN and +/-inf become NULL in float columns."""
    cols = cols if cols is not None else [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: finite_or_null_col(c) for c in cols})


def drop_incomplete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a NULL (or NaN) in any of ``cols``."""
    return df.na.drop(how="any", subset=list(cols) if cols else None)


def impute_median(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULLs of numeric columns become the column median (exact)."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    df = finite(df, cols)
    med = exact_quantiles(df, {c: [0.5] for c in cols})
    fills = {}
    for c in cols:
        m = med[c][0]
        if m is None:
            continue
        t = dict(df.dtypes)[c]
        val = F.lit(m).cast("double")
        # pandas turns an integer column holding NULLs into float, so does this
        fills[c] = F.coalesce(F.col(c).cast("double"), val) if t not in ("double", "float") \
            else F.coalesce(F.col(c), val)
    return df.withColumns(fills)


def impute_label(df: DataFrame, cols: Sequence[str] | None = None, label: str = "missing") -> DataFrame:
    """NULLs of categorical (string) columns become ``label``."""
    cols = list(cols) if cols is not None else string_columns(df)
    return df.na.fill(label, subset=cols) if cols else df


def winsorize(df: DataFrame, cols: Sequence[str] | None = None, lower: float = 0.01,
              upper: float = 0.01) -> DataFrame:
    """The lowest ``int(lower*n)`` values become the next order statistic and
    the highest ``int(upper*n)`` the one below them (n = non-null count):
    a clip to ``sorted[k_lo]`` and ``sorted[n - k_hi - 1]``."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    df = finite(df, cols)
    counts, found = sketches(df, cols)
    cut = {}
    for c in cols:
        n = counts[c]
        k_lo, k_hi = int(lower * n), int(upper * n)
        if n and (k_lo or k_hi):
            cut[c] = (k_lo, n - k_hi - 1)
    st = order_statistics_many(df, {c: [(r,) for r in cut[c]] for c in cut}, counts, found)  # all columns, shared passes
    out = {}
    for c, (r_lo, r_hi) in cut.items():
        t = df.schema[c].dataType
        out[c] = F.least(F.greatest(F.col(c), F.lit(st[c][r_lo]).cast(t)), F.lit(st[c][r_hi]).cast(t))
    return df.withColumns(out)


def dedup(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Remove exact duplicate rows (hash aggregate with map-side combine,
    so a heavily copied row collapses before the shuffle)."""
    return df.dropDuplicates(list(subset) if subset else None)


def profile_stats(df: DataFrame, cols: Sequence[str], stage: str) -> DataFrame:
    """count, min, median, max of each column, long format.  Counts, extremes
    and the medians' sketches come from one pass, the medians from a second."""
    df = finite(df.select(*cols))
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), *sketch_aggs(c, f"q{i}")]
    m = df.agg(*aggs).first()
    q = exact_quantiles(df, {c: [0.5] for c in cols}, {c: m[f"q{i}_n"] for i, c in enumerate(cols)},
                        {c: m[f"q{i}_k"] for i, c in enumerate(cols)})
    rows = [(stage, c, m[f"q{i}_n"], m[f"lo{i}"], q[c][0], m[f"hi{i}"]) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(
        rows, "stage string, column string, count bigint, min double, median double, max double")


def clean_report(before: DataFrame, after: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The same column profile before and after cleaning, stacked."""
    return profile_stats(before, cols, "before").unionByName(profile_stats(after, cols, "after"))


def basic_clean(df: DataFrame, target: str = "total_alquileres",
                parts: Sequence[str] = ("u_casuales", "u_registrados"),
                date_col: str | None = "fecha", int_cols: Sequence[str] = INT_COLS,
                weather_cols: Sequence[str] = WEATHER_COLS) -> DataFrame:
    """Repair target -> parse date -> narrow integers -> C2/C3/C4.

    Optional columns are skipped when absent.  All thresholds come from a
    single statistics pass over the input (taken before any clipping).
    """
    df = repair_sum(finite(df), target, parts)
    if date_col and date_col in df.columns:
        df = parse_ts(df, date_col)
    df = narrow_integers(df, [c for c in int_cols if c in df.columns])
    wc = [c for c in weather_cols if c in df.columns]
    return clip_rules(df, wc) if wc else df
