"""Projection, filter and schema operators P1-P15."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_number, finite, string_columns

# Names a date column may have, in order of preference.
DATE_CANDIDATES = ("fecha", "Fecha", "date", "timestamp", "datetime")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Column names trimmed, lower-cased, spaces to underscores."""
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def detect_date_column(df: DataFrame, candidates: Sequence[str] = DATE_CANDIDATES,
                       out: str = "fecha") -> tuple[DataFrame, str | None]:
    """Parse the first present candidate into ``out`` (bad values NULL)."""
    for c in candidates:
        if c in df.columns:
            return df.withColumn(out, _to_ts(F.col(c), dict(df.dtypes)[c])), c
    return df, None


def _to_ts(col, dtype: str):
    if dtype == "string":
        return col.try_cast("timestamp_ntz")
    if dtype == "timestamp":
        return col.cast("timestamp_ntz")
    if dtype == "date":
        return col.cast("timestamp_ntz")
    return col


def parse_ts(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Text (or date) to a zone-less timestamp; unparseable values NULL."""
    return df.withColumn(out or col, _to_ts(F.col(col), dict(df.dtypes)[col]))


def narrow_integers(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """P5: float columns whose non-null values are all whole become BIGINT.

    One aggregate pass decides every column (``bool_and`` over ``c % 1 = 0``).
    """
    floats = [c for c, t in df.dtypes if t in ("double", "float") and (cols is None or c in cols)]
    if not floats:
        return df
    df = finite(df, floats)
    row = df.agg(*[F.coalesce(F.bool_and(F.when(F.col(c).isNotNull(), F.col(c) % 1 == 0)), F.lit(True))
                   .alias(c) for c in floats]).first()
    return df.withColumns({c: F.col(c).cast("bigint") for c in floats if row[c]})


def strings_to_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Text columns with decimal commas become DOUBLE, but only when every
    non-null value parses (otherwise the column is left as text)."""
    cols = list(cols) if cols is not None else string_columns(df)
    if not cols:
        return df
    parsed = {c: as_number(F.regexp_replace(F.col(c), ",", "."), "double") for c in cols}
    row = df.agg(*[F.count_if(F.col(c).isNotNull() & parsed[c].isNull()).alias(c) for c in cols]).first()
    return df.withColumns({c: parsed[c] for c in cols if row[c] == 0})


def exclude(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop the columns that are present (absent ones are ignored)."""
    return df.drop(*cols)


def align_columns(df: DataFrame, cols: Sequence[str], fill=0) -> DataFrame:
    """Exactly ``cols`` in that order; missing ones are ``fill``, NULL -> ``fill``
    (``fill`` None: both stay NULL)."""
    types = dict(df.dtypes)
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")

    def one(c):
        if c not in types:
            return F.lit(fill) if fill is not None else F.lit(None).cast("double")
        if fill is not None and (types[c] in numeric or types[c].startswith("decimal")):
            return F.coalesce(F.col(c), F.lit(fill))
        return F.col(c)
    return df.select(*[one(c).alias(c) for c in cols])


def known_target(df: DataFrame, target: str) -> DataFrame:
    """Rows whose target is known."""
    return df.where(F.col(target).isNotNull())


def head_ordered(df: DataFrame, order: Sequence[str], n: int = 10, tail: bool = False) -> DataFrame:
    """First (or last) ``n`` rows of the ordered table (TakeOrderedAndProject)."""
    keys = [F.col(c).desc() if tail else F.col(c).asc() for c in order]
    return df.orderBy(*keys).limit(n)


def schema_profile(df: DataFrame) -> DataFrame:
    """Shape and types: one row per column with its position, type and the row count."""
    spark = df.sparkSession
    meta = spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
                                 "position int, column string, dtype string")
    n = df.agg(F.count(F.lit(1))).first()[0]
    return meta.withColumns({"n_rows": F.lit(n).cast("bigint"), "n_columns": F.lit(len(df.columns))})
