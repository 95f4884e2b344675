"""Exact quantiles (pandas / numpy "linear" rule) that scale.

The first pass takes a mergeable KLL sketch of every column, beside its count (and beside whatever else the
caller aggregates, see :func:`sketch_aggs`).  The sketch gives each wanted order statistic a bracket ``[lo, hi]`` of
values whose ranks lie within the sketch's error of it.  The second pass counts, for all brackets of all columns at
once, the values below, at ``lo``, strictly inside and at ``hi``, and gathers the inside, which has about
``6 * error * n`` values: an end that holds a third of the column is counted, never gathered.  So the result is exact
after two scans at any number of columns.

An inside that is expected to pass ``direct_limit`` values is not gathered but sketched again, so every further
scan divides it by about 100; a bracket that missed its rank (the sketch's error is a bound in probability) is made
anew with a wider margin from the same sketch.  The driver sees a sketch a column (or open bracket) and a few numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .columns import finite

# Most values of a bracket that one final task gathers (8 bytes each).
DIRECT_LIMIT = 100_000
ACCURACY = 4096        # size k of a sketch: rank error 0.13 % of n, about 100 kB a column and task


def _k(accuracy: int) -> int:
    return max(8, min(65_535, int(accuracy)))


def rank_error(accuracy: int = ACCURACY) -> float:
    """Rank error of a sketch as a share of its values (99 % of the time), half as much again for fewer second tries."""
    return min(1.0, 1.5 * 2.296 / _k(accuracy) ** 0.9021)


def _num(col: str) -> Column:
    return F.col("`" + col.replace("`", "``") + "`").cast("double")


def sketch_aggs(col: str, name: str, accuracy: int = ACCURACY) -> list[Column]:
    """Aggregates ``<name>_n`` (count) and ``<name>_k`` (sketch) of a column, for a caller's own pass."""
    return [F.count(_num(col)).alias(f"{name}_n"), F.kll_sketch_agg_double(_num(col), _k(accuracy)).alias(f"{name}_k")]


def sketches(df: DataFrame, cols: Sequence[str], accuracy: int = ACCURACY) -> tuple[dict, dict]:
    """Counts ``{col: n}`` and sketches ``{col: bytes}`` of the columns: one pass."""
    cols = list(dict.fromkeys(cols))
    if not cols:
        return {}, {}
    row = finite(df.select(*cols)).agg(*[a for i, c in enumerate(cols) for a in sketch_aggs(c, f"q{i}", accuracy)]).first()
    return {c: row[f"q{i}_n"] for i, c in enumerate(cols)}, {c: row[f"q{i}_k"] for i, c in enumerate(cols)}


def _bounds(df: DataFrame, asked: Sequence[tuple]) -> list[tuple[float, float]]:
    """(lo, hi) for each (sketch, its number of values n, first and last rank, margin in ranks)."""
    if not asked:
        return []
    at = lambda r, n: F.lit(min(1.0, max(0.0, r / n)))
    one = df.sparkSession.sql("SELECT 1")       # the sketches are literals: nothing is read
    row = one.select(*[F.kll_sketch_get_quantile_double(F.lit(bytes(s)), F.array(at(a - m, n), at(b + 1 + m, n))).alias(f"b{i}")
                       for i, (s, n, a, b, m) in enumerate(asked)]).first()
    return [tuple(row[f"b{i}"]) for i in range(len(asked))]


def _margin(n: int, accuracy: int, wide: int) -> int:
    return math.ceil(n * min(1.0, wide * rank_error(accuracy))) + 2


def order_statistics_many(df: DataFrame, wants: dict[str, Sequence[Sequence[int]]], counts: dict[str, int], sketch: dict[str, bytes],
                          direct_limit: int = DIRECT_LIMIT, accuracy: int = ACCURACY) -> dict[str, dict[int, float]]:
    """``{col: {r: r-th smallest non-null value (0-based)}}``.

    ``wants``: groups of neighbouring ranks a column; each group has a bracket of its own, from the column's ``sketch``
    (:func:`sketches`, or :func:`sketch_aggs` of the same ``accuracy``).
    """
    cols = [c for c in wants if counts[c]]
    df = finite(df.select(*cols)) if cols else df          # NaN and inf count as NULL
    out: dict[str, dict[int, float]] = {c: {} for c in wants}
    # to be bracketed: column, ranks, sketch, the number of values in it, those below, widening, sketch size
    todo = [(c, tuple(sorted(set(g))), sketch[c], counts[c], 0, 1, accuracy) for c in cols for g in wants[c]]
    while todo:
        limits = _bounds(df, [(s, n, ranks[0] - below, ranks[-1] - below, _margin(n, k, wide)) for _, ranks, s, n, below, wide, k in todo])
        small, large, plan = [], [], []
        for j, ((c, ranks, s, n, below, wide, k), (lo, hi)) in enumerate(zip(todo, limits)):
            less = 2 * _margin(n, k, wide) + 2 * math.ceil(n * rank_error(k)) + len(ranks)      # values expected strictly inside
            finer = k if less <= n / 2 else min(4 * _k(k), 65_535)       # too coarse to narrow so few values
            gather = min(n, less) <= direct_limit
            plan.append((lo, hi, gather, finer))
            (small if gather else large).append((j, c, lo, hi, ranks if gather else finer))
        seen = {**_gathered(df, small), **_resketched(df, large)}
        after = []
        for j, ((c, ranks, s, n, below, wide, k), (lo, hi, gather, finer)) in enumerate(zip(todo, plan)):
            n_lo, n_at, n_in, n_hi, got = seen[j]
            start = n_lo + n_at
            end = start + n_in
            held, missed = [], []
            for at, r in enumerate(ranks):
                if n_lo <= r < start:
                    out[c][r] = lo
                elif end <= r < end + n_hi:
                    out[c][r] = hi
                elif not start <= r < end:
                    missed.append(r)
                elif gather:
                    out[c][r] = got[at]
                else:
                    held.append(r)
            if missed:      # the same sketch, with a wider margin
                if _margin(n, k, wide) > n:     # it reached from the least to the greatest value
                    raise RuntimeError(f"the values of {c!r} changed between two scans")
                after.append((c, tuple(missed), s, n, below, wide * 4, k))
            if held:
                after.append((c, tuple(held), got, n_in, start, 1, finer))
        todo = after
    return out


def _gathered(df: DataFrame, asked: Sequence[tuple]) -> dict[int, tuple]:
    """``{j: (below, at lo, strictly inside, at hi, values of the ranks)}`` for brackets (j, column, lo, hi, ranks): one scan.

    Each task counts by numpy, where hundreds of SQL aggregates would leave generated code, and passes on
    a row a bracket with the values inside; those of a bracket meet in one row.
    """
    if not asked:
        return {}
    cols = list(dict.fromkeys(a[1] for a in asked))
    jobs = [[(j, lo, hi) for j, c, lo, hi, _ in asked if c == col] for col in cols]
    ship(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {j: np.zeros(4, np.int64) for job in jobs for j, _, _ in job}
        values = {j: [] for j in sums}
        for batch in batches:
            for column, job in zip(batch.columns, jobs):
                x = column.drop_null().to_numpy(zero_copy_only=False)
                for j, lo, hi in job:
                    inside = x[(x > lo) & (x < hi)]
                    sums[j] += (np.count_nonzero(x < lo), np.count_nonzero(x == lo), len(inside), np.count_nonzero(x == hi) if hi > lo else 0)
                    if len(inside):
                        values[j].append(inside)
        yield pa.RecordBatch.from_pydict({
            "j": pa.array(list(sums), pa.int32()), **{f"n{i}": pa.array([int(v[i]) for v in sums.values()], pa.int64()) for i in range(4)},
            "v": pa.array([np.concatenate(values[j]) if values[j] else np.empty(0) for j in sums], pa.list_(pa.float64()))})

    parts = df.select(*[_num(c).alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(
        count, "j int, n0 bigint, n1 bigint, n2 bigint, n3 bigint, v array<double>")
    whole = parts.groupBy("j").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(4)], F.sort_array(F.flatten(F.collect_list("v"))).alias("v"))
    ranks = F.element_at(F.create_map(*[e for j, *_, r in asked for e in (F.lit(j), F.array(*[F.lit(x).cast("bigint") for x in r]))]), F.col("j"))
    # -1 and n2: not inside
    place = F.transform(ranks, lambda r: F.greatest(F.lit(-1), F.least(F.col("n2"), r - F.col("n0") - F.col("n1"))).cast("int"))
    rows = whole.withColumn("place", place).select("j", "n0", "n1", "n2", "n3", F.transform("place", lambda i: F.get("v", i)).alias("got")).collect()
    return {r["j"]: (r["n0"], r["n1"], r["n2"], r["n3"], r["got"]) for r in rows}       # one row a bracket


def _resketched(df: DataFrame, asked: Sequence[tuple]) -> dict[int, tuple]:
    """``{j: (below, at lo, strictly inside, at hi, sketch of the inside)}`` for brackets (j, column, lo, hi, sketch size): one scan."""
    if not asked:
        return {}
    aggs = []
    for j, c, lo, hi, k in asked:
        x = _num(c)
        within = F.when((x > lo) & (x < hi), x)
        aggs += [F.count_if(x < lo).alias(f"l{j}"), F.count_if(x == lo).alias(f"a{j}"), F.count(within).alias(f"i{j}"),
                 (F.count_if(x == hi) if hi > lo else F.lit(0)).alias(f"h{j}"), F.kll_sketch_agg_double(within, _k(k)).alias(f"g{j}")]
    row = df.agg(*aggs).first()
    return {j: tuple(row[f"{x}{j}"] for x in "laihg") for j, *_ in asked}


def exact_quantiles(df: DataFrame, spec: dict[str, Sequence[float]], counts: dict[str, int] | None = None, sketch: dict[str, bytes] | None = None,
                    direct_limit: int = DIRECT_LIMIT, accuracy: int = ACCURACY) -> dict[str, list]:
    """``{col: [q(p) for p in probs]}`` with linear interpolation between order
    statistics, over non-null values; ``None`` for an all-null column.
    ``counts`` / ``sketch`` (from :func:`sketch_aggs`) save the sketch
    pass when the caller already has them."""
    if sketch is None:
        counts, sketch = sketches(df, list(spec), accuracy)
    at = {c: [(counts[c] - 1) * p for p in spec[c]] for c in spec}
    kth = order_statistics_many(df, {c: [(math.floor(h), math.ceil(h)) for h in at[c]] for c in spec}, counts, sketch, direct_limit, accuracy)
    # linear rule, written as lo + (hi - lo) * d like numpy and DuckDB
    return {c: [kth[c][math.floor(h)] + (kth[c][math.ceil(h)] - kth[c][math.floor(h)]) * (h - math.floor(h)) for h in at[c]]
            if counts[c] else [None] * len(spec[c]) for c in spec}


def order_statistics(df: DataFrame, col: str, ranks: Sequence[int], direct_limit: int = DIRECT_LIMIT, accuracy: int = ACCURACY) -> dict[int, float]:
    """Exact r-th smallest values (0-based ranks) of ``col``."""
    counts, sketch = sketches(df, [col], accuracy)
    return order_statistics_many(df, {col: [(r,) for r in ranks]}, counts, sketch, direct_limit, accuracy)[col]
