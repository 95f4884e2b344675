"""Gradient-boosted regression trees that share their prefixes.

A search over boosted trees fits the same trees again and again: the model of 800 rounds
holds those of 100, 200 and 400 with the same rate and depth.  So points of a search are
grouped by (rate, depth), each group is grown once per fold to its most rounds, and
the errors of every asked number of rounds are taken on the way.

A fit is one Spark job, not one a tree level.  Its tasks hold the rows as bin numbers
(one byte a feature; at most BINS quantile bins, found by one aggregate over the
training part) and grow the trees level by level from histograms of the residuals.
Up to TASK_ROWS rows are one task; more rows are dealt to as many tasks as they
need, which run together (barrier mode) and add up their histograms at each level,
so every task takes the same splits.  What tasks exchange follows nodes, features and
bins, never the rows; a lost task makes Spark run the stage again.

Trees are as the reference booster grows them by default: squared error, start at
the mean, a leaf of at least 20 rows, no regularisation; growth is by level, to the depth
its leaf budget stands for.  Missing values go right at every split.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Model, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .split import count_rows, expanding_folds

BINS = 255
LEAF_ROWS = 20             # the reference booster's default (min_child_samples)
TASK_ROWS = 4_000_000      # training and test rows that one task holds
NODES = "tree int, node int, feature int, threshold double, left int, right int, value double"
ERRORS = "rounds int, n bigint, sse double, sae double"


def bin_edges(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Per feature, the ascending thresholds a split may take (``x <= edge`` goes left)."""
    places = [i / bins for i in range(1, bins)]
    known = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features]
    row = df.agg(*[F.percentile_approx(c, places, 100 * bins).alias(f"q{i}") for i, c in enumerate(known)],
                 *[F.max(c).alias(f"m{i}") for i, c in enumerate(known)]).first()
    out = []
    for i in range(len(features)):
        q = np.unique(np.array(row[f"q{i}"] or [], float))
        out.append(q[q < row[f"m{i}"]] if len(q) else q)       # nothing lies above the greatest value
    return out


def _binned(b: pa.RecordBatch, first: int, edges: list[np.ndarray]) -> np.ndarray:
    cols = [np.searchsorted(e, b.column(first + j).to_numpy(zero_copy_only=False).astype(float)) for j, e in enumerate(edges)]
    return np.stack(cols, axis=1).astype(np.uint8) if cols else np.zeros((b.num_rows, 0), np.uint8)


class _Together:
    """Sums over the tasks of a barrier stage; a single task has its own sums."""

    def __init__(self, parts: int):
        self.rank, self.context = 0, None
        if parts > 1:
            from pyspark import BarrierTaskContext
            self.context = BarrierTaskContext.get()
            self.rank = self.context.partitionId()

    def add(self, a: np.ndarray) -> np.ndarray:
        if self.context is None:
            return a
        said = self.context.allGather(base64.b64encode(np.ascontiguousarray(a, float).tobytes()).decode())
        return sum(np.frombuffer(base64.b64decode(s)).reshape(a.shape) for s in said)


def best_splits(count: np.ndarray, total: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, bin, found) per node of histograms (node, feature, bin): the greatest fall of the squared
    error with ``least`` rows on both sides; the first of equals."""
    left_n, left_s = np.cumsum(count, axis=2), np.cumsum(total, axis=2)
    n, s = left_n[:, :, -1:], left_s[:, :, -1:]
    right_n, right_s = n - left_n, s - left_s
    ok = (left_n >= least) & (right_n >= least)
    gain = np.where(ok, left_s ** 2 / np.maximum(left_n, 1) + right_s ** 2 / np.maximum(right_n, 1) - s ** 2 / np.maximum(n, 1), -1.0)
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(axis=1)
    found = flat[np.arange(len(flat)), at] > 1e-12 * np.maximum(1.0, (s ** 2 / np.maximum(n, 1))[:, 0, 0])
    return at // count.shape[2], at % count.shape[2], found


def grow(x: np.ndarray, residual: np.ndarray, wide: int, depth: int, least: int, together) -> tuple[list[list], Callable]:
    """One tree: its nodes [feature, bin, left, right, value] (a leaf has feature -1) and a function that gives
    the node of binned rows.  ``residual`` is of the training rows ``x``."""
    nodes: list[list] = [[-1, 0, 0, 0, 0.0]]
    at = np.zeros(len(x), np.int64)
    live, steps = np.zeros(1, np.int64), []
    d = x.shape[1]
    own = together.add(np.array([len(x), residual.sum()], float))
    nodes[0][4] = own[1] / max(own[0], 1)
    for _ in range(depth if d else 0):
        place = np.full(len(nodes), -1, np.int64)
        place[live] = np.arange(len(live))
        k = place[at]
        rows = np.flatnonzero(k >= 0)
        k, r, size = k[rows], residual[rows], len(live) * wide
        hist = np.empty((2, len(live), d, wide))
        for j in range(d):
            key = k * wide + x[rows, j]
            hist[0, :, j] = np.bincount(key, minlength=size).reshape(len(live), wide)
            hist[1, :, j] = np.bincount(key, weights=r, minlength=size).reshape(len(live), wide)
        count, total = together.add(hist)
        feature, cut, found = best_splits(count, total, least)
        if not found.any():
            break
        nxt = []
        for i in np.flatnonzero(found).tolist():
            f, c = int(feature[i]), int(cut[i])
            n, s = count[i, f], total[i, f]
            left = len(nodes)
            nodes[live[i]][:4] = [f, c, left, left + 1]
            ln, ls = n[:c + 1].sum(), s[:c + 1].sum()
            rn, rs = n[c + 1:].sum(), s[c + 1:].sum()
            nodes += [[-1, 0, 0, 0, ls / ln], [-1, 0, 0, 0, rs / rn]]
            nxt += [node for node, m in ((left, ln), (left + 1, rn)) if m >= 2 * least]
        steps.append(len(steps))
        at = _step(nodes, x, at)
        live = np.array(nxt, np.int64)
        if not len(live):
            break

    def leaf(rows: np.ndarray) -> np.ndarray:
        now = np.zeros(len(rows), np.int64)
        for _ in steps:
            now = _step(nodes, rows, now)
        return now
    return nodes, (at, leaf)


def _step(nodes: list[list], x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows one level down; rows in leaves stay."""
    t = np.array([n[:4] for n in nodes], np.int64)
    f = t[at, 0]
    value = x[np.arange(len(x)), np.maximum(f, 0)]
    return np.where(f < 0, at, np.where(value <= t[at, 1], t[at, 2], t[at, 3]))


def _train(edges: list[np.ndarray], rate: float, depth: int, rounds: Sequence[int], log: bool, parts: int, give_trees: bool):
    """Task of one fit.  Rows: (is training row, label, features ...).  Gives the trees (by the first task), or,
    per asked number of rounds, the errors over its test rows on the label's own scale."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        together = _Together(parts)
        role, ys, xs = [], [], []
        for b in batches:
            role.append(np.asarray(b.column(0)).astype(bool) if b.num_rows else np.zeros(0, bool))
            ys.append(b.column(1).to_numpy(zero_copy_only=False).astype(float))
            xs.append(_binned(b, 2, edges))
        train = np.concatenate(role) if role else np.zeros(0, bool)
        y = np.concatenate(ys) if ys else np.zeros(0)
        x = np.concatenate(xs) if xs else np.zeros((0, len(edges)), np.uint8)
        x, tx, y, ty = x[train], x[~train], y[train], y[~train]
        goal = np.log1p(y) if log else y
        wide = max((len(e) + 1 for e in edges), default=1)
        n, s = together.add(np.array([len(goal), goal.sum()], float))
        start = s / n if n else 0.0
        now, test = np.full(len(goal), start), np.full(len(ty), start)
        trees, errors = [[[-1, 0, 0, 0, start]]], []
        for k in range(1, max(rounds) + 1):
            nodes, (at, leaf) = grow(x, goal - now, wide, depth, LEAF_ROWS, together)
            value = np.array([v[4] for v in nodes]) * rate
            now += value[at]
            if len(test):
                test += value[leaf(tx)]
            if give_trees:
                trees.append([[*v[:4], v[4] * rate] for v in nodes])
            elif k in rounds:
                off = ty - (np.expm1(test) if log else test)
                errors.append((k, len(off), float((off * off).sum()), float(np.abs(off).sum())))
        if not give_trees:
            yield pa.RecordBatch.from_pylist([dict(zip(("rounds", "n", "sse", "sae"), e)) for e in errors],
                                             pa.schema([("rounds", pa.int32()), ("n", pa.int64()), ("sse", pa.float64()), ("sae", pa.float64())]))
        elif together.rank == 0:
            rows = [(t, i, f, float(edges[f][c]) if f >= 0 else None, left, right, v)
                    for t, nodes in enumerate(trees) for i, (f, c, left, right, v) in enumerate(nodes)]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)],
                                             ["tree", "node", "feature", "threshold", "left", "right", "value"])
    return run


def _known(label: str):
    return F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double"))


def _job(train: DataFrame, test: DataFrame | None, features, label: str, rate: float, depth: int, rounds, log: bool, give_trees: bool,
         parts: int | None, edges: list[np.ndarray] | None = None) -> DataFrame:
    ship(train.sparkSession)
    known = _known(label)
    cols = [F.col(label).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)]]
    train = train.where(known)
    rows = train.select(F.lit(True).alias("_train"), *cols)
    if test is not None:
        rows = rows.unionAll(test.where(known).select(F.lit(False), *cols))
    parts = parts or max(1, math.ceil(count_rows(rows) / TASK_ROWS))
    edges = bin_edges(train, features) if edges is None else edges
    return rows.repartition(parts).mapInArrow(_train(edges, rate, depth, sorted(set(rounds)), log, parts, give_trees),
                                              NODES if give_trees else ERRORS, barrier=parts > 1)


def fold_errors(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, rate: float, depth: int, rounds: Sequence[int],
                log_target: bool = False, parts: int | None = None, edges: list[np.ndarray] | None = None) -> dict[int, dict]:
    """Test errors of every number of ``rounds``, from one fit.  With ``log_target`` the trees learn
    ``log1p(label)`` and their predictions are mapped back before they are scored (M9)."""
    errors = _job(train, test, features, label, rate, depth, rounds, log_target, False, parts, edges)
    rows = errors.groupBy("rounds").agg(F.sum("n").alias("n"), F.sum("sse").alias("sse"), F.sum("sae").alias("sae")).collect()
    return {r["rounds"]: {"n": r["n"], "rmse": math.sqrt(r["sse"] / r["n"]) if r["n"] else None, "mae": r["sae"] / r["n"] if r["n"] else None}
            for r in rows}


# ---------------------------------------------------------------- the fitted model

class BoostedTreesModel(Model, HasFeaturesCol, HasPredictionCol, MLReadable, MLWritable):
    """Fitted trees as a pipeline stage: adds the sum of their leaves.  ``trees`` has the
    columns NODES; tree 0 is the start value."""

    @keyword_only
    def __init__(self, trees: pd.DataFrame | None = None, featuresCol: str = "features", predictionCol: str = "pred"):
        super().__init__()
        self.trees = trees
        self._set(featuresCol=featuresCol, predictionCol=predictionCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        ship(df.sparkSession)
        t = self.trees.sort_values(["tree", "node"])
        parts = [(g.feature.to_numpy(), g.threshold.to_numpy(float), g.left.to_numpy(), g.right.to_numpy(), g.value.to_numpy())
                 for _, g in t.groupby("tree")]

        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            rows = np.stack(x.to_numpy()) if len(x) else np.zeros((0, 0))
            out = np.zeros(len(rows))
            for f, threshold, left, right, value in parts:
                at = np.zeros(len(rows), np.int64)
                while (moving := f[at] >= 0).any():
                    below = rows[np.arange(len(rows)), np.maximum(f[at], 0)] <= threshold[at]       # missing values: false
                    at = np.where(moving, np.where(below, left[at], right[at]), at)
                out += value[at]
            return pd.Series(out)
        return df.withColumn(self.getPredictionCol(), predict(vector_to_array(F.col(self.getFeaturesCol()))))

    def first_rounds(self, rounds: int) -> BoostedTreesModel:
        """The model of the first ``rounds`` trees."""
        out = BoostedTreesModel(trees=self.trees[self.trees.tree <= rounds], featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())
        return out

    def write(self) -> MLWriter:
        return _TreesWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TreesReader(cls)


class _TreesWriter(MLWriter):
    def __init__(self, model: BoostedTreesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        DefaultParamsWriter.saveMetadata(self.model, path, spark)
        spark.createDataFrame(self.model.trees.astype(object).where(self.model.trees.notna(), None), NODES).coalesce(1).write.parquet(f"{path}/trees")


class _TreesReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> BoostedTreesModel:
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = BoostedTreesModel(trees=spark.read.parquet(f"{path}/trees").toPandas())
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def fit_boosted(df: DataFrame, features: Sequence[str], label: str, rounds: int = 500, rate: float = 0.05, depth: int = 5,
                parts: int | None = None) -> PipelineModel:
    """M2: boosted trees (the defaults: 500 rounds at 0.05, 31 leaves) as a pipeline that predicts ``pred``."""
    trees = _job(df, None, features, label, rate, depth, [rounds], False, True, parts).toPandas()      # nodes: rounds * 2 ** depth
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    return PipelineModel([assembler, BoostedTreesModel(trees=trees)])


# ---------------------------------------------------------------- searches over shared prefixes

def shared_groups(points: Sequence[dict]) -> dict[tuple[float, int], set[int]]:
    """(rate, depth) -> numbers of rounds asked for, of translated points (``boost_params``)."""
    out: dict[tuple[float, int], set[int]] = {}
    for p in points:
        out.setdefault((p["rate"], p["maxDepth"]), set()).add(p["rounds"])
    return out


def search_boosted(df: DataFrame, index_col: str, features: Sequence[str], label: str, points: Sequence[dict], translate: Callable[[dict], dict],
                   run_all: Callable[[Sequence[Callable], int], list], k: int = 3, n: int | None = None, by: str = "mean_rmse",
                   parallelism: int | None = None) -> tuple[dict, list[dict]]:
    """M5 / M6: mean expanding-fold errors of every point, as :func:`models.search` gives them, from one fit per
    (rate, depth) and fold.  Returns the point with the least ``by`` (the first of equals) and all results."""
    n = count_rows(df) if n is None else n
    folds = expanding_folds(df, index_col, k, n=n)
    groups = shared_groups([translate(p) for p in points])
    order = sorted(groups.items(), key=lambda g: -max(g[1]) * g[0][1])                         # the longest first
    threads = parallelism or df.sparkSession.sparkContext.defaultParallelism
    edges = run_all([lambda f=f: bin_edges(f[1].where(_known(label)), features) for f in folds], threads)   # of a fold's training part alone
    parts = max(1, math.ceil(n / TASK_ROWS))
    jobs = [lambda g=g, r=r, f=f: (g, f[0], fold_errors(f[1], f[2], features, label, g[0], g[1], sorted(r), parts=parts, edges=edges[f[0]]))
            for g, r in order for f in folds]
    found = {(g, j): e for g, j, e in run_all(jobs, threads)}
    results = []
    for i, p in enumerate(points):
        t = translate(p)
        mine = [found[(t["rate"], t["maxDepth"]), f[0]][t["rounds"]] for f in folds]
        results.append({"point": i, "params": p, "mean_rmse": float(np.mean([m["rmse"] for m in mine])),
                        "mean_mae": float(np.mean([m["mae"] for m in mine])), "mean_mse": float(np.mean([m["rmse"] ** 2 for m in mine]))})
    return min(results, key=lambda r: r[by])["params"], results


def cross_validate_boosted(df: DataFrame, index_col: str, features: Sequence[str], label: str, point: dict, run_all, k: int = 5,
                           log_target: bool = False, n: int | None = None) -> list[dict]:
    """M8 / M9 for one translated point: errors of each expanding fold."""
    folds = expanding_folds(df, index_col, k, n=n)
    jobs = [lambda f=f: {"fold": f[0], **fold_errors(f[1], f[2], features, label, point["rate"], point["maxDepth"], [point["rounds"]],
                                                     log_target)[point["rounds"]]} for f in folds]
    return run_all(jobs, len(jobs))
