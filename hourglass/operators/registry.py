"""Leaderboard, promotion and leakage audit (V5, M10, M-AUD)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, numeric_columns


def leaderboard(metrics: DataFrame, by: str = "rmse") -> DataFrame:
    """V5: models ranked by ``by`` (ascending); models without metrics have no
    rank and status ``missing metrics``.  The table has one row per model."""
    w = Window.orderBy(F.col(by).asc_nulls_last(), F.col("model"))
    ranked = metrics.withColumn("rank", F.when(F.col(by).isNotNull(), F.rank().over(w)))
    return ranked.withColumn("status", F.when(F.col(by).isNull(), F.lit("missing metrics")).otherwise(F.lit("ok")))


def promote_if_better(candidates: DataFrame, registry: DataFrame, by: str = "rmse") -> DataFrame:
    """Promote a candidate when no metric is stored for the model it would
    replace, or when its metric is strictly lower.

    ``candidates``: (candidate, current_model); ``registry``: (model, <by>).
    """
    cur = registry.select(F.col("model").alias("current_model"), F.col(by).alias(f"current_{by}"))
    new = registry.select(F.col("model").alias("candidate"), F.col(by).alias(f"candidate_{by}"))
    j = candidates.join(new, "candidate", "left").join(cur, "current_model", "left")
    better = F.coalesce(F.col(f"current_{by}"), F.lit(float("inf"))) > F.col(f"candidate_{by}")
    return j.withColumn("promote", F.coalesce(better, F.lit(False)))


def feature_table(spark: SparkSession, feature_sets: dict[str, Sequence[str]]) -> DataFrame:
    rows = [(name, f) for name, cols in feature_sets.items() for f in cols]
    return spark.createDataFrame(rows, "feature_set string, feature string")


def leakage_by_value(df: DataFrame, target: str, cols: Sequence[str] | None = None) -> DataFrame:
    """M-AUD on the rows: numeric features that equal the target in every complete
    row, or of which two add up to it: (feature, reason).  One aggregate pass."""
    cols = [c for c in (cols if cols is not None else numeric_columns(df)) if c != target]
    df = finite(df.select(target, *cols))
    y = F.col(target).cast("double")

    def always(x):
        known = x.isNotNull() & y.isNotNull()
        return (F.count_if(known) > 0) & (F.count_if(known & (F.abs(x - y) > 1e-9 * (1 + F.abs(y)))) == 0)
    x = {c: F.col(c).cast("double") for c in cols}
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    found = [F.when(always(x[a]), F.array(F.struct(F.lit(a).alias("feature"), F.lit("equals target").alias("reason")))) for a in cols]
    found += [F.when(always(x[a] + x[b]), F.array(*[F.struct(F.lit(f).alias("feature"), F.lit("part of target").alias("reason"))
                                                   for f in (a, b)])) for a, b in pairs]
    none = F.array().cast("array<struct<feature:string,reason:string>>")
    row = df.agg(*[F.coalesce(f, none).alias(f"f{i}") for i, f in enumerate(found)]) if found else df.limit(0).agg(none.alias("f0"))
    return row.select(F.explode(F.array_distinct(F.concat(*row.columns))).alias("s")).select("s.*")


def leakage_audit(features: DataFrame, banned: Sequence[str]) -> DataFrame:
    """M-AUD: the banned columns found in each feature set (semi join)."""
    spark = features.sparkSession
    ban = spark.createDataFrame([(b,) for b in banned], "feature string")
    return features.join(F.broadcast(ban), "feature", "left_semi").select("feature_set", "feature")
