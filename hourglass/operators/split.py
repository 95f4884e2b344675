"""Splits, folds and sampling.

Time splits and folds are index arithmetic on a dense row index, so each
fold is a filter (no copy of the data per fold); random splits hash a key, so
they do not depend on partitioning or on re-execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import md5_bucket


def count_rows(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]


_count = count_rows


def time_split(df: DataFrame, index_col: str, frac: float = 0.8, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The first ``int(n * frac)`` rows of the order are train, the rest test."""
    n = _count(df) if n is None else n
    cut = int(n * frac)
    return df.where(F.col(index_col) < cut), df.where(F.col(index_col) >= cut)


def with_split_role(df: DataFrame, index_col: str, frac: float = 0.8, n: int | None = None) -> DataFrame:
    n = _count(df) if n is None else n
    cut = int(n * frac)
    return df.withColumn("role", F.when(F.col(index_col) < cut, F.lit("train")).otherwise(F.lit("test")))


def hash_split(df: DataFrame, key: str, frac: float = 0.8, salt: str = "") -> tuple[DataFrame, DataFrame]:
    """Reproducible random split by a hash of the key, in millionths.

    ``h`` is the number in the first 8 hex digits of md5; its percent is
    ``h % 100`` and its place within the percent ``h / 100 % 10000``.  Every row is in
    one of the two parts: a NULL key hashes as the empty text.
    """
    if not 0 <= frac <= 1:
        raise ValueError(f"frac must be within 0..1, not {frac}")
    b = hash_place(key, salt)
    cut = round(frac * 1_000_000)
    return df.where(b < cut), df.where(b >= cut)


def hash_place(key: str, salt: str = ""):
    """0..999999 from md5 of the key's text (see :func:`hash_split`)."""
    h = md5_bucket(F.concat(F.lit(salt), F.coalesce(F.col(key).cast("string"), F.lit(""))), 1 << 32)
    return (h % 100) * 10_000 + F.floor(h / 100) % 10_000


def search_sample(train: DataFrame, key: str, frac: float = 0.2, salt: str = "sample:") -> DataFrame:
    """A hashed ``frac`` sample of train, whatever its size (labels travel with their rows)."""
    return hash_split(train, key, frac, salt=salt)[0]


def fold_bounds(n: int, k: int) -> list[tuple[int, int, int]]:
    """``(fold, test_start, test_end)`` of expanding folds: ``t = n // (k+1)``,
    test fold j is ``[n-(k-j)t, n-(k-j-1)t)``, train everything before it."""
    t = n // (k + 1)
    if t == 0:
        raise ValueError(f"{n} rows are too few for {k} folds")
    return [(j, n - (k - j) * t, n - (k - j - 1) * t) for j in range(k)]


def expanding_folds(df: DataFrame, index_col: str, k: int = 5, n: int | None = None):
    """T4: list of ``(fold, train, test)`` filters of ``df`` (nothing is copied)."""
    n = _count(df) if n is None else n
    idx = F.col(index_col)
    return [(j, df.where(idx < s), df.where((idx >= s) & (idx < e))) for j, s, e in fold_bounds(n, k)]


def test_fold(index_col: str, k: int, n: int):
    """The fold (0..k-1) whose test part a row is in, NULL for rows only trained on; test parts are disjoint."""
    t = n // (k + 1)
    if t == 0:
        raise ValueError(f"{n} rows are too few for {k} folds")
    first = n - k * t
    return F.when(F.col(index_col) >= first, F.floor((F.col(index_col) - F.lit(first)) / F.lit(t)).cast("int"))


def fold_membership(df: DataFrame, index_col: str, k: int = 5, n: int | None = None) -> DataFrame:
    """T4 as one frame: each row tagged with every ``(fold, role)`` it belongs to."""
    n = _count(df) if n is None else n
    idx = F.col(index_col)
    tags = []
    for j, s, e in fold_bounds(n, k):
        tags.append(F.when(idx < s, F.struct(F.lit(j).alias("fold"), F.lit("train").alias("role"))))
        tags.append(F.when((idx >= s) & (idx < e), F.struct(F.lit(j).alias("fold"), F.lit("test").alias("role"))))
    return (df.withColumn("_t", F.explode(F.filter(F.array(*tags), lambda x: x.isNotNull())))
            .select("*", "_t.fold", "_t.role").drop("_t"))
