"""Joining a fitted lookup table (category codes, target means) onto big data.

A lookup table is fitted from the data, so its size grows with the number of
distinct keys, not with a constant.  It is broadcast only after its row count
has been measured and its estimated bytes are under ``BROADCAST_LIMIT_BYTES``;
beyond that it is joined with a shuffle, where AQE's skew handling splits a
hot key's partition on the big side instead of sending it to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_LIMIT_BYTES = 32 << 20

_FIXED = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.DateType: 4, T.FloatType: 4}


def row_bytes(schema: T.StructType) -> int:
    """Rough in-memory bytes per row (strings counted at 64, other types 8)."""
    total = 16
    for f in schema.fields:
        t = type(f.dataType)
        total += 64 if t in (T.StringType, T.BinaryType) else _FIXED.get(t, 8)
    return total


def lookup_join(big: DataFrame, small: DataFrame, on, how: str = "left", rows: int | None = None,
                limit_bytes: int | None = None) -> DataFrame:
    """Join ``small`` onto ``big``; broadcast ``small`` only below ``limit_bytes``
    (default ``BROADCAST_LIMIT_BYTES``).

    ``rows`` is the measured row count of ``small`` when the caller has it
    (otherwise it is counted here, which is one job over the lookup table).
    """
    limit = BROADCAST_LIMIT_BYTES if limit_bytes is None else limit_bytes
    n = small.count() if rows is None else rows
    if n * row_bytes(small.schema) <= limit:
        small = F.broadcast(small)
    return big.join(small, on, how)
