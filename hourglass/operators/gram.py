"""Work on Gram matrices: ridge over expanding folds (M3, M8) and linear leaks (M-AUD).

One scan gives, per block of rows, the matrix Z'Z of Z = [1, features, label].  It
holds all a linear fit needs, and matrices of blocks add up: the training part of expanding fold j is the
sum of the blocks before its test part.  So all folds are fitted from one scan, by solving
systems of the size of the features on the driver.

Each task sums its rows with matrix products and returns a matrix a block; Spark adds
them up by place.  Columns are taken relative to the first row's values, so that large
offsets don't cancel.  Rows with a missing value in any column are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite, numeric_columns
from ..session import ship
from .split import count_rows, fold_bounds

SAME = 1e-9                # relative: what counts as equal, row by row
SPAN = 1e-6                # relative: what counts as in the span, by sums


def _kernel(shift: list[float]):
    off = np.array(shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            block = np.asarray(b.column(0))
            z = np.ones((b.num_rows, len(off) + 1))
            for j in range(len(off)):
                z[:, j + 1] = np.asarray(b.column(j + 1)) - off[j]
            for k in np.unique(block).tolist():
                part = z[block == k]
                sums[k] = sums.get(k, 0) + part.T @ part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([g.ravel().tolist() for g in sums.values()],
                                                                                        pa.list_(pa.float64()))], ["block", "g"])
    return run


def grams(df: DataFrame, cols: Sequence[str], block: Column | None = None) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """({block: Z'Z}, shift) over rows with all ``cols``; Z = [1, cols - shift].  One scan."""
    ship(df.sparkSession)
    rows = finite(df.select(F.lit(0).alias("_b") if block is None else block.cast("int").alias("_b"), *[F.col(c).cast("double").alias(c) for c in cols]),
                  list(cols)).dropna()
    first = rows.first()
    if first is None:
        return {}, np.zeros(len(cols))
    shift = [float(first[c]) for c in cols]
    parts = rows.mapInArrow(_kernel(shift), "block int, g array<double>")
    total = parts.select("block", F.posexplode("g").alias("i", "v")).groupBy("block", "i").agg(F.sum("v").alias("v")).collect()   # blocks * cols^2
    size = len(cols) + 1
    out: dict[int, np.ndarray] = {}
    for r in total:
        out.setdefault(r["block"], np.zeros(size * size))[r["i"]] = r["v"]
    return {k: g.reshape(size, size) for k, g in out.items()}, np.array(shift)


def _centred(g: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(rows, means, centred products) of Z'Z."""
    n = g[0, 0]
    mean = g[0, 1:] / n
    return n, mean, g[1:, 1:] - n * np.outer(mean, mean)


def ridge_from_gram(g: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """(coefficients, intercept), in shifted columns, of ridge on features of unit variance: the least of the sum of squares plus
    ``alpha`` times the squared length of the coefficients.  The last column is the label."""
    n, mean, s = _centred(g)
    x, c = s[:-1, :-1], s[:-1, -1]
    dev = np.sqrt(np.maximum(np.diag(x), 0) / n)
    use = dev > 0                                                     # a constant feature has no part
    w = np.zeros(len(c))
    if use.any():
        d = dev[use]
        w[use] = np.linalg.solve(x[np.ix_(use, use)] / np.outer(d, d) + alpha * np.eye(len(d)), c[use] / d) / d
    return w, float(mean[-1] - w @ mean[:-1])


def squared_error(g: np.ndarray, w: np.ndarray, b: float) -> float:
    """Sum of squared errors of a linear model on the rows of Z'Z."""
    v = np.concatenate([[-b], -w, [1.0]])
    return float(max(v @ g @ v, 0.0))


def ridge_cv(df: DataFrame, index_col: str, features: Sequence[str], label: str, alpha: float = 1.0, k: int = 5, n: int | None = None) -> DataFrame:
    """M3 + M8: ridge on every expanding fold: (fold, n_train, n, rmse, mae) and their means.  One scan for the fits and the
    squared errors; one more, of all test parts together, for the absolute errors."""
    spark = df.sparkSession
    n = count_rows(df) if n is None else n
    bounds = fold_bounds(n, k)
    idx = F.col(index_col)
    block = F.lit(0)
    for j, start, _ in bounds:
        block = F.when(idx >= start, F.lit(j + 1)).otherwise(block)
    by, shift = grams(df, [*features, label], block)
    size = len(features) + 2
    before, rows, models = by.get(0, np.zeros((size, size))), [], []
    for j, _, _ in bounds:
        test = by.get(j + 1, np.zeros((size, size)))
        if before[0, 0] and test[0, 0]:
            w, b = ridge_from_gram(before, alpha)
            models.append((j + 1, [*map(float, w)], float(b - w @ shift[:-1] + shift[-1])))
            rows.append((j, int(before[0, 0]), int(test[0, 0]), float(np.sqrt(squared_error(test, w, b) / test[0, 0]))))
        before = before + test
    fits = spark.createDataFrame(rows, "fold int, n_train bigint, n bigint, rmse double")
    pred = F.lit(None).cast("double")
    for j, w, b in models:                                            # k expressions of the features
        pred = F.when(F.col("_b") == j, sum((F.col(c).cast("double") * F.lit(x) for c, x in zip(features, w)), F.lit(b))).otherwise(pred)
    known = finite(df.select(block.alias("_b"), *features, label), [*features, label]).dropna()
    off = known.select("_b", F.abs(F.col(label) - pred).alias("e")).where("e is not null").groupBy((F.col("_b") - 1).alias("fold")).agg(F.avg("e").alias("mae"))
    per = fits.join(off, "fold").select(F.col("fold").cast("string").alias("fold"), "n_train", "n", "rmse", "mae")
    mean = per.agg(F.lit("mean").alias("fold"), F.lit(None).cast("bigint").alias("n_train"), F.sum("n").alias("n"), F.avg("rmse").alias("rmse"),
                   F.avg("mae").alias("mae"))
    return per.unionByName(mean)


# ---------------------------------------------------------------- linear leaks

def _in_span(s: np.ndarray, use: list[int], y: int) -> dict[int, float] | None:
    """Coefficients by which column ``y`` is a sum of columns ``use`` (and a constant), from centred products ``s``; the columns
    are taken in the order that explains most of what is left (pivoted), and those not needed are left out again."""
    left = {i: s[i, i] for i in use if s[i, i] > 0}
    chosen: list[int] = []

    def fit(cols: list[int]) -> tuple[np.ndarray, float]:
        d = np.sqrt(np.diag(s)[cols])
        w = np.linalg.lstsq(s[np.ix_(cols, cols)] / np.outer(d, d), s[cols, y] / d, rcond=1e-13)[0] / d
        v = np.append(-w, 1.0)
        at = [*cols, y]
        return w, float(v @ s[np.ix_(at, at)] @ v) / s[y, y]
    # columns that are independent of those before them: pivoted Cholesky on unit variances
    order = sorted(left, key=lambda i: -abs(s[i, y]) / np.sqrt(s[i, i]))
    basis: list[np.ndarray] = []
    dev = np.sqrt(np.maximum(np.diag(s), 1e-300))
    unit = s / np.outer(dev, dev)
    for i in order:
        r = unit[i].copy()
        for b in basis:
            r -= b * b[i]
        if r[i] > SPAN ** 1.5:
            basis.append(r / np.sqrt(r[i]))
            chosen.append(i)
    if not chosen or fit(chosen)[1] > SPAN ** 2 * 100:
        return None
    for i in sorted(chosen, key=lambda i: abs(s[i, y]) / np.sqrt(s[i, i])):          # the least related first
        fewer = [c for c in chosen if c != i]
        if fewer and fit(fewer)[1] <= SPAN ** 2 * 100:
            chosen = fewer
    return dict(zip(chosen, fit(chosen)[0].tolist()))


def linear_leaks(df: DataFrame, target: str, cols: Sequence[str] | None = None) -> DataFrame:
    """M-AUD: (feature, reason, coefficient) of numeric features that give the target away: ``equals target``, ``multiple of
    target`` (up to a constant), or ``part of target``, if the target is a sum of any number of
    features with coefficients (and a constant).  One scan finds them; a second one holds what was found against every complete row.
    """
    spark = df.sparkSession
    cols = [c for c in (cols if cols is not None else numeric_columns(df)) if c != target]
    empty = spark.createDataFrame([], "feature string, reason string, coefficient double")
    by, shift = grams(df, [*cols, target])
    if not cols or not by:
        return empty
    n, mean, s = _centred(by[0])
    y = len(cols)
    if n < 2 or s[y, y] <= 0:
        return empty
    found: list[tuple[dict[int, float], str]] = []
    rest = []
    for i in range(y):
        if s[i, i] > 0 and s[i, y] ** 2 >= s[i, i] * s[y, y] * (1 - SPAN ** 2):
            found.append(({i: s[i, y] / s[i, i]}, "copy"))
        else:
            rest.append(i)
    parts = _in_span(s, rest, y)
    if parts:
        found.append((parts, "part of target"))
    if not found:
        return empty
    at = mean + shift
    rows = finite(df.select(*cols, target), [*cols, target]).dropna()

    def misses(w: dict[int, float]) -> Column:
        made = F.lit(float(at[y] - sum(v * at[i] for i, v in w.items())))
        scale = F.abs(F.col(target)) + F.lit(float(abs(at[y])) + 1.0)
        for i, v in w.items():
            made = made + F.lit(float(v)) * F.col(cols[i])
            scale = scale + F.abs(F.lit(float(v)) * F.col(cols[i]))
        return F.count_if(F.abs(made - F.col(target)) > F.lit(100 * SAME) * scale)
    wrong = rows.agg(*[misses(w).alias(f"m{k}") for k, (w, _) in enumerate(found)]).first()
    out = []
    for k, (w, reason) in enumerate(found):
        if wrong[k]:
            continue
        for i, v in w.items():
            plain = abs(v - 1) < SAME * 100 and abs(at[y] - v * at[i]) <= SAME * 100 * (1 + abs(at[y]))
            out.append((cols[i], reason if reason != "copy" else "equals target" if plain else "multiple of target", float(v)))
    return spark.createDataFrame(out, empty.schema) if out else empty
