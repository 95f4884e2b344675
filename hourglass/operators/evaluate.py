"""Evaluation operators V1-V4 (one aggregate pass each)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..functions.quantiles import exact_quantiles


def _complete(df: DataFrame, y: str, p: str) -> DataFrame:
    return finite(df, [y, p]).where(F.col(y).isNotNull() & F.col(p).isNotNull())


def regression_metrics(df: DataFrame, y: str = "y", p: str = "pred", group_by=None) -> DataFrame:
    """V1 + V2: n, RMSE, MAE and R^2 over rows where both are known.

    R^2 = 1 - SSE / SST with SST from the same rows; NULL when SST is 0.
    SST is the variance times n (Spark's variance is updated around the running mean, so a
    large offset doesn't cancel); one pass (per group) computes everything.
    """
    d = _complete(df, y, p)
    e = F.col(y) - F.col(p)
    keys = [group_by] if isinstance(group_by, str) else list(group_by or [])
    agg = (d.groupBy(*keys) if keys else d).agg(
        F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("_sse"), F.sum(F.abs(e)).alias("_sae"),
        F.var_pop(F.col(y)).alias("_var"))
    sst = F.col("_var") * F.col("n")
    return agg.select(*keys, "n", F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"),
                      (F.col("_sae") / F.col("n")).alias("mae"),
                      F.when(sst > 0, 1 - F.col("_sse") / sst).alias("r2"))


def r2_score(df: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    """V2 with the two-pass form (mean first), numerically safer than expanded sums."""
    d = _complete(df, y, p)
    my = d.agg(F.avg(y)).first()[0]
    agg = d.agg(F.sum(F.pow(F.col(y) - F.col(p), 2)).alias("sse"), F.sum(F.pow(F.col(y) - F.lit(my), 2)).alias("sst"))
    return agg.select(F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).alias("r2"))


def residuals(df: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    """V3: residual ``y - pred`` for complete rows."""
    return _complete(df, y, p).withColumn("residual", F.col(y) - F.col(p))


def quantile_edges(df: DataFrame, col: str, q: int = 5) -> list[float]:
    """Equal-count bin edges (exact quantiles 0, 1/q, ..., 1), duplicates dropped."""
    return quantile_edges_many(df, [col], q)[col]


def quantile_edges_many(df: DataFrame, cols, q: int = 5) -> dict[str, list[float]]:
    """:func:`quantile_edges` of several columns from the same passes."""
    vals = exact_quantiles(df, {c: [i / q for i in range(q + 1)] for c in cols})
    out = {}
    for c in cols:
        edges: list[float] = []
        for v in vals[c]:
            if v is not None and (not edges or v != edges[-1]):
                edges.append(v)
        out[c] = edges
    return out


def bin_by_edges(col: str, edges: list[float]):
    """Right-closed bins, the first one closed on the left too: the bin of x is
    the number of inner edges strictly below x."""
    inner = edges[1:-1]
    if not inner:
        return F.lit(0).cast("bigint")
    return sum((F.when(F.col(col) > F.lit(e), 1).otherwise(0) for e in inner), F.lit(0)).cast("bigint")


def bin_confusion(df: DataFrame, y: str = "y", p: str = "pred", q: int = 5) -> DataFrame:
    """V4: confusion counts of actual vs predicted equal-count bins, each on its own edges."""
    d = _complete(df, y, p)
    e = quantile_edges_many(d, [y, p], q)  # both columns' edges from the same passes
    ey, ep = e[y], e[p]
    return (d.select(bin_by_edges(y, ey).alias("actual_bin"), bin_by_edges(p, ep).alias("pred_bin"))
            .groupBy("actual_bin", "pred_bin").count())
