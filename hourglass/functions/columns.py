"""Column expressions shared by the operators.  All are built-in Spark
functions, so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, ByteType, DecimalType, DoubleType, FloatType,
                               IntegerType, LongType, NumericType, ShortType, StringType)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trunc_ntz(ts, unit: str = "hour") -> Column:
    """Truncate a zone-less timestamp to the hour or day without any time-zone math."""
    ts = _c(ts)
    hour = F.hour(ts) if unit == "hour" else F.lit(0)
    if unit not in ("hour", "day"):
        raise ValueError(unit)
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), hour, F.lit(0), F.lit(0))


def weekday_mon0(ts) -> Column:
    """Day of week with Monday = 0 ... Sunday = 6 (``dayofweek`` is Sunday = 1)."""
    return F.weekday(_c(ts)).cast("bigint")


def is_weekend(dow) -> Column:
    return _c(dow).isin(5, 6).cast("bigint")


def finite_or_null_col(c) -> Column:
    """NaN and +/-inf become NULL (Spark orders NaN above every number)."""
    c = _c(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def finite(df: DataFrame, cols=None) -> DataFrame:
    """NaN and +/-inf become NULL in the float columns of ``cols`` (all by default):
    the rule every numeric operator applies first, so that NULL is the only missing value."""
    own = [c for c, t in df.dtypes if t in ("double", "float") and (cols is None or c in cols)]
    return df.withColumns({c: finite_or_null_col(F.col(f"`{c}`")) for c in own}) if own else df


def md5_bucket(key, buckets: int = 100) -> Column:
    """Stable hash bucket 0..buckets-1 from md5 of the key's text.

    Independent of partitioning and reproducible in any SQL engine
    (first 8 hex digits of md5, modulo ``buckets``).
    """
    return (F.conv(F.substring(F.md5(_c(key).cast("string")), 1, 8), 16, 10)
            .cast("bigint") % F.lit(buckets))


def round6(c) -> Column:
    return F.round(_c(c), 6)


NUMERIC_TYPES = (ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType, DecimalType)


def is_numeric_type(dt) -> bool:
    return isinstance(dt, NumericType) and not isinstance(dt, BooleanType)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Numeric columns in schema order."""
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in exclude]


#: A whole cell that is a number; Java's own reading would take ``5d`` and ``7f`` for numbers too.
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf(inity)?|nan))\s*$"


def as_number(c: Column, kind: str) -> Column:
    """Text cast to ``kind`` (bigint, double, ...), NULL where it isn't a plain number."""
    return F.when(c.rlike(NUMBER), c.try_cast(kind))
