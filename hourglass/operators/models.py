"""Models, searches and scoring.

Every fit is an MLlib ``Pipeline`` (VectorAssembler + estimator) trained on a
distributed DataFrame; a search is a driver loop over a small list of
parameter points where each fit and each evaluation is a Spark job, the same
shape as MLlib's own ``CrossValidator``.  Folds are index filters of one
persisted frame, so the data is read and prepared once.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ship
from . import boosting
from .evaluate import regression_metrics
from .split import count_rows, expanding_folds, hash_split

SEED = 42
MAX_TREE_DEPTH = 30  # MLlib's limit; the reference grows trees without one
MAX_BINS = 255  # split candidates per feature, as the reference's booster has
SEARCH_PARALLELISM = 4  # concurrent fits in a search or cross-validation


def _pipeline(features: Sequence[str], estimator, scale: bool = False) -> Pipeline:
    stages = [VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")]
    if scale:
        stages.append(StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True))
        estimator = estimator.setFeaturesCol("scaled")
    return Pipeline(stages=stages + [estimator])


def forest(label: str, num_trees: int = 200, max_depth: int | None = None, **kw) -> RandomForestRegressor:
    """M1: random forest, 200 trees, seed 42; ``max_depth=None`` means MLlib's maximum.

    Every split considers all features, as the reference's regressor does by
    default (MLlib's own default for regression is a third of them)."""
    depth = MAX_TREE_DEPTH if max_depth is None else max_depth
    kw.setdefault("featureSubsetStrategy", "all")
    # Deep trees: caching each row's node id beats shipping 200 trees to every
    # task per level (same model, about half the fit time; boosting's shallow
    # trees are faster without it).
    kw.setdefault("cacheNodeIds", True)
    kw.setdefault("maxBins", MAX_BINS)
    return RandomForestRegressor(labelCol=label, predictionCol="pred", numTrees=num_trees, maxDepth=depth,
                                 seed=SEED, **kw)


def gbt(label: str, rounds: int = 500, rate: float = 0.05, num_leaves: int | None = None, **kw) -> GBTRegressor:
    """M2: gradient-boosted trees; a leaf budget maps to ``maxDepth = ceil(log2(num_leaves))``.

    A leaf needs 20 rows, the reference booster's default (``min_child_samples``);
    MLlib's default would allow one."""
    kw.setdefault("minInstancesPerNode", 20)
    kw.setdefault("maxBins", MAX_BINS)
    if num_leaves is not None:
        kw.setdefault("maxDepth", max(1, math.ceil(math.log2(num_leaves))))
    return GBTRegressor(labelCol=label, predictionCol="pred", maxIter=rounds, stepSize=rate, seed=SEED, **kw)


def ridge(label: str, reg: float = 1.0) -> LinearRegression:
    """M3: L2-regularised linear regression (on standardised features)."""
    return LinearRegression(labelCol=label, predictionCol="pred", regParam=reg, elasticNetParam=0.0)


def fit(df: DataFrame, features: Sequence[str], estimator, scale: bool = False) -> PipelineModel:
    # Forests keep per-row node ids (``cacheNodeIds``) and checkpoint them
    # every ``checkpointInterval`` levels into the shared checkpoint folder.
    checkpoint_dir(df.sparkSession)
    return _pipeline(features, estimator, scale).fit(df)


def fit_forest(df, features, label, **kw) -> PipelineModel:
    return fit(df, features, forest(label, **kw))


def fit_gbt(df, features, label, rounds: int = 500, rate: float = 0.05, **kw) -> PipelineModel:
    return fit(df, features, gbt(label, rounds, rate, **kw))


def fit_boosted(df, features, label, rounds: int = 500, rate: float = 0.05, maxDepth: int | None = None, num_leaves: int = 31) -> PipelineModel:
    """M2: boosted trees grown in one job (:mod:`boosting`); the defaults are the reference booster's,
    500 rounds at 0.05 with 31 leaves."""
    depth = maxDepth if maxDepth is not None else max(1, math.ceil(math.log2(num_leaves)))
    return boosting.fit_boosted(df, features, label, rounds, rate, depth)


def search_boosted(df: DataFrame, index_col: str, features, label: str, points: Sequence[dict], k: int = 3, n: int | None = None,
                   by: str = "mean_rmse") -> tuple[dict, list[dict]]:
    """M5 / M6 for boosted trees: :func:`search` of the reference's points, with one fit per (rate, depth) and fold."""
    return boosting.search_boosted(df, index_col, features, label, points, boost_params, _run_all, k, n, by)


def cross_validate_boosted(df: DataFrame, index_col: str, features, label: str, point: dict, k: int = 5, log_target: bool = False) -> list[dict]:
    """M8 / M9 for one point of the reference's boosted-tree spaces."""
    return boosting.cross_validate_boosted(df, index_col, features, label, boost_params(point), _run_all, k, log_target)


def fit_linear(df, features, label, reg: float = 1.0) -> PipelineModel:
    return fit(df, features, ridge(label, reg), scale=True)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Apply a fitted pipeline; keeps the input columns plus ``pred``."""
    out = model.transform(df)
    return out.drop(*[c for c in ("features", "scaled") if c in out.columns])


def evaluate_model(model: PipelineModel, df: DataFrame, label: str) -> dict:
    row = regression_metrics(predict(model, df), label, "pred").first()
    return {"rmse": row["rmse"], "mae": row["mae"], "r2": row["r2"], "n": row["n"]}


def _fold_score(fold, features, label: str, make: Callable[[], object], log_target: bool) -> dict:
    """Fit on a fold's train part, score its test part (M8 / M9)."""
    j, train, test = fold
    lab = label
    if log_target:
        lab = f"{label}__log1p"
        train = train.withColumn(lab, F.log1p(F.col(label)))
    est = make().setLabelCol(lab)
    model = fit(train, features, est)
    pred = predict(model, test)
    if log_target:
        pred = pred.withColumn("pred", F.expm1("pred"))
    m = regression_metrics(pred, label, "pred").first()
    return {"fold": j, "rmse": m["rmse"], "mae": m["mae"], "n": m["n"]}


def _run_all(jobs: Sequence[Callable[[], dict]], parallelism: int) -> list[dict]:
    """Run independent fits from a few driver threads (as MLlib's
    ``CrossValidator(parallelism=...)`` does); each fit is its own set of
    distributed jobs and is seeded, so the results do not depend on timing."""
    if parallelism <= 1 or len(jobs) <= 1:
        return [f() for f in jobs]
    with ThreadPoolExecutor(max_workers=min(parallelism, len(jobs))) as ex:
        return list(ex.map(lambda f: f(), jobs))


def cross_validate(df: DataFrame, index_col: str, features, label: str, make: Callable[[], object],
                   k: int = 5, log_target: bool = False, n: int | None = None,
                   parallelism: int = SEARCH_PARALLELISM) -> list[dict]:
    """M8 / M9: fit on each expanding fold's train part, score its test part.

    With ``log_target`` the model learns ``log1p(label)`` and predictions are
    mapped back with ``expm1`` before scoring on the original scale.
    """
    folds = expanding_folds(df, index_col, k, n=n)
    return _run_all([lambda f=f: _fold_score(f, features, label, make, log_target) for f in folds], parallelism)


# The reference's search spaces (parameter names as the
# reference writes them for its boosted-tree library; -1 = no depth limit).
FOREST_GRID = {"n_estimators": [50, 100], "max_depth": [10, None]}
BOOST_GRID = {"n_estimators": [100, 300], "learning_rate": [0.05, 0.1], "num_leaves": [31, 63]}
BOOST_RANDOM_SPACE_3FOLD = {  # 24 draws, 3 expanding folds
    "num_leaves": [31, 50, 70, 100],
    "learning_rate": [0.01, 0.03, 0.05, 0.1],
    "n_estimators": [100, 200, 400, 800],
    "max_depth": [-1, 6, 10, 20],
    "subsample": [0.6, 0.8, 1.0],
}
BOOST_RANDOM_SPACE_5FOLD = {  # 20 draws, 5 expanding folds
    "n_estimators": [100, 200, 400, 800],
    "num_leaves": [31, 50, 70, 100],
    "learning_rate": [0.01, 0.03, 0.05, 0.1],
    "max_depth": [3, 5, 6, 8, -1],
    "subsample": [0.6, 0.8, 1.0],
}


def boost_params(point: dict) -> dict:
    """Translate a point of the reference's boosted-tree spaces to :func:`gbt`
    arguments: rounds, rate, and a depth that honours both the leaf budget
    (``ceil(log2(num_leaves))``) and ``max_depth`` (-1 = none).  ``subsample``
    has no effect there (no bagging frequency is set), so it has none here."""
    out = {}
    if "n_estimators" in point:
        out["rounds"] = point["n_estimators"]
    if "learning_rate" in point:
        out["rate"] = point["learning_rate"]
    depth = MAX_TREE_DEPTH
    if point.get("num_leaves"):
        depth = min(depth, max(1, math.ceil(math.log2(point["num_leaves"]))))
    if point.get("max_depth") not in (None, -1):
        depth = min(depth, point["max_depth"])
    out["maxDepth"] = depth
    return out


def forest_params(point: dict) -> dict:
    """Translate a point of the reference forest grid to :func:`forest` arguments."""
    return {"num_trees": point["n_estimators"], "max_depth": point["max_depth"]}


def param_grid(grid: dict[str, Sequence]) -> list[dict]:
    """All combinations of a small grid, in a fixed order."""
    points = [{}]
    for k in sorted(grid):
        points = [{**p, k: v} for p in points for v in grid[k]]
    return points


def random_points(space: dict[str, Sequence], n_iter: int, seed: int = SEED) -> list[dict]:
    """M6: ``n_iter`` seeded draws from a discrete space (distinct points)."""
    rng = random.Random(seed)
    all_points = param_grid(space)
    return rng.sample(all_points, min(n_iter, len(all_points)))


def search(df: DataFrame, index_col: str, features, label: str, make: Callable[..., object],
           points: Sequence[dict], k: int = 3, n: int | None = None,
           parallelism: int = SEARCH_PARALLELISM, sample_frac: float | None = None,
           by: str = "mean_rmse") -> tuple[dict, list[dict]]:
    """M5 / M6: mean expanding-fold errors of every parameter point on ``df``
    (train only, D13); returns the point with the least ``by`` and all results.  Every
    (point, fold) fit is independent, so they share one thread pool.

    Every fit sees all rows of its fold's training part.  T3: with
    ``sample_frac`` the folds are fitted on a hashed sample of it instead, whatever
    their size; the refit of the best point uses all of train.
    """
    n = count_rows(df) if n is None else n
    folds = []
    for j, train, test in expanding_folds(df, index_col, k, n=n):
        if sample_frac is not None:
            train = hash_split(train, index_col, sample_frac, salt="sample:")[0]
        folds.append((j, train, test))
    jobs = [lambda i=i, p=p, f=f: {"point": i, **_fold_score(f, features, label, lambda: make(**p), False)}
            for i, p in enumerate(points) for f in folds]
    scores = _run_all(jobs, parallelism)
    results = []
    for i, p in enumerate(points):
        mine = [r for r in scores if r["point"] == i]
        results.append({"point": i, "params": p, "mean_rmse": float(np.mean([f["rmse"] for f in mine])),
                        "mean_mae": float(np.mean([f["mae"] for f in mine])),
                        "mean_mse": float(np.mean([f["rmse"] ** 2 for f in mine]))})
    best = min(results, key=lambda r: r[by])
    return best["params"], results


def feature_importances(model: PipelineModel, top: int = 20) -> DataFrame:
    """Importances of the tree stage, largest first."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    names = model.stages[0].getInputCols()
    imp = model.stages[-1].featureImportances.toArray().tolist()
    df = spark.createDataFrame(list(zip(names, [float(x) for x in imp])), "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), "feature").limit(top)


# ---------------------------------------------------------------- k-NN (M4)

KNN_BLOCK_BYTES = 64 << 20  # vectors (of the query side: plus their running top-k) of one block
KNN_LEAST_ROWS = 256        # train rows worth a block of their own
KNN_TILE_CELLS = 1 << 22     # distances computed at once in a task (32 MB of doubles)


def _merge_topk(best_d, best_t, best_y, s, d2, slack, qm, tm, tids, ys, k):
    """Fold a (queries x train rows) distance tile into the running top-k of
    queries ``s..s+len(d2)``, ordered by (distance, train id).

    ``d2`` comes from the expanded form and may be off by ``slack``; entries not
    above the k-th smallest of the tile and of the current best, by that much,
    survive the cut, and their distances are made anew from the
    differences, so the (distance, id) order is that of exact distances.
    """
    e = s + d2.shape[0]
    kk = min(k, d2.shape[1])
    thr = np.minimum(np.partition(d2, kk - 1, axis=1)[:, kk - 1], best_d[s:e, -1]) + 2 * slack
    r, c = np.nonzero(d2 <= thr[:, None])
    exact = np.empty(len(r))
    for x in range(0, len(r), 8192):
        diff = qm[s + r[x:x + 8192]] - tm[c[x:x + 8192]]
        exact[x:x + 8192] = (diff * diff).sum(axis=1)
    rows = np.concatenate([np.repeat(np.arange(s, e), k), r + s])
    dd = np.concatenate([best_d[s:e].ravel(), exact])
    tt = np.concatenate([best_t[s:e].ravel(), tids[c]])
    yy = np.concatenate([best_y[s:e].ravel(), ys[c]])
    order = np.lexsort((np.unique(tt, return_inverse=True)[1] if tt.dtype == object else tt, dd, rows))
    rows, dd, tt, yy = rows[order], dd[order], tt[order], yy[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    keep = rank < k
    best_d[rows[keep], rank[keep]] = dd[keep]
    best_t[rows[keep], rank[keep]] = tt[keep]
    best_y[rows[keep], rank[keep]] = yy[keep]


def knn_regress(train: DataFrame, query: DataFrame, k: int, vec_col: str, label_col: str,
                id_col: str, query_id: str | None = None) -> DataFrame:
    """M4: exact k-nearest-neighbour regression (Euclidean), prediction = mean label.

    Both sides are dealt to blocks of at most about ``KNN_BLOCK_BYTES`` by a hash of
    the id, and every pair of a train and a query block is one task: it goes through
    numpy distance tiles of bounded size and keeps one running top-k per query, so exactly
    ``k x train blocks`` candidates per query are shuffled (by query id, equal-sized groups), and
    a window over those picks the final k.  Nothing passes through the driver, nothing is
    broadcast, and no pair list is ever materialised.  A query without a vector, or without any
    train row, has the prediction NULL.
    """
    spark = train.sparkSession
    ship(spark)
    query_id = query_id or id_col
    q = query.select(F.col(query_id).alias("_qid"), F.col(vec_col).alias("_qv")).where(F.col("_qv").isNotNull())
    t = (train.select(F.col(id_col).alias("_tid"), F.col(vec_col).alias("_tv"), F.col(label_col).alias("_y"))
         .where(F.col("_tv").isNotNull()))
    kinds = [d.schema[c].dataType.simpleString() for d, c in ((query, query_id), (train, id_col))]
    whole = kinds[1] in ("tinyint", "smallint", "int", "bigint")
    asked = query.select(F.col(query_id).alias("_id")).dropDuplicates()      # every one gets a row
    dim_row = q.select(F.size("_qv").alias("d")).first()
    if dim_row is None:
        return asked.select(F.col("_id").alias(query_id), F.lit(None).cast("double").alias("pred"))
    dim, nq, nt = dim_row["d"], q.count(), t.count()
    q_blocks = max(1, math.ceil(nq * (8 * max(dim, 1) + 24 * k + 24) / KNN_BLOCK_BYTES))
    t_blocks = max(1, math.ceil(nt * 8 * max(dim, 1) / KNN_BLOCK_BYTES),
                   min(spark.sparkContext.defaultParallelism, math.ceil(nt / KNN_LEAST_ROWS)) // q_blocks)

    def local_topk(tp: pd.DataFrame, qp: pd.DataFrame) -> pd.DataFrame:
        if tp.empty or qp.empty:
            return pd.DataFrame({"_qid": [], "_tid": [], "_d2": [], "_y": []})
        qid, nqb = qp["_qid"].to_numpy(), len(qp)
        qm = np.stack(qp["_qv"].to_numpy()).astype(np.float64, copy=False)
        tm = np.stack(tp["_tv"].to_numpy()).astype(np.float64, copy=False)
        centre = qm.mean(axis=0)          # distances don't change; the expanded form cancels less
        qc, tc = qm - centre, tm - centre
        qn, tn = (qc * qc).sum(axis=1), (tc * tc).sum(axis=1)
        tids = tp["_tid"].to_numpy().astype(np.int64 if whole else object)
        ys = tp["_y"].to_numpy().astype(np.float64)
        best_d, best_y = np.full((nqb, k), np.inf), np.full((nqb, k), np.nan)
        best_t = np.full((nqb, k), np.iinfo(np.int64).max, dtype=np.int64) if whole else np.full((nqb, k), "", dtype=object)
        rows = max(1, min(len(tm), KNN_TILE_CELLS))
        step = max(1, KNN_TILE_CELLS // rows)
        for x in range(0, len(tm), rows):
            for s in range(0, nqb, step):
                e = min(nqb, s + step)
                d2 = qn[s:e, None] + tn[None, x:x + rows] - 2.0 * (qc[s:e] @ tc[x:x + rows].T)
                slack = 1e-12 * (qn[s:e] + tn[x:x + rows].max())
                _merge_topk(best_d, best_t, best_y, s, d2, slack, qm, tm[x:x + rows], tids[x:x + rows], ys[x:x + rows], k)
        r, c = np.nonzero(np.isfinite(best_d))
        return pd.DataFrame({"_qid": qid[r], "_tid": best_t[r, c], "_d2": best_d[r, c], "_y": best_y[r, c]})

    def dealt(df, own, blocks, key, other, others):
        # every row goes to its block of each block of the other side
        return (df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).groupBy("_tb", "_qb"))
    results = (dealt(t, "_tb", t_blocks, "_tid", "_qb", q_blocks).cogroup(dealt(q, "_qb", q_blocks, "_qid", "_tb", t_blocks))
               .applyInPandas(local_topk, f"_qid {kinds[0]}, _tid {kinds[1]}, _d2 double, _y double"))
    w = Window.partitionBy("_qid").orderBy("_d2", "_tid")
    top = results.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    found = top.groupBy("_qid").agg(F.avg("_y").alias("pred"))
    return asked.join(found, F.col("_id").eqNullSafe(F.col("_qid")), "left").select(F.col("_id").alias(query_id), "pred")
