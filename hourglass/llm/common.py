"""Helpers shared by the text operators: row keys, scratch tables, hash folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.order import with_row_index
from ..session import scratch_path, ship

KEY = "_hgl_key"
ARROW_ROWS = 1024


def ready(spark: SparkSession) -> None:
    """The package on the executors, and Arrow batches of at most ARROW_ROWS documents (Spark's
    default is 10,000), so that a batch of long texts stays small in a Python worker."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


_OPEN: list[list[str]] = []
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage is
    cut by files that survive a lost executor.  Spark drops the shuffle files of the write when it ends;
    else they stay until the driver happens to collect garbage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    was = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if was is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, was)
    if _OPEN:
        _OPEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The saved result of ``make``; tables that were saved on the way are deleted."""
    _OPEN.append([])
    try:
        out = make()
        left = _OPEN[-1]
    finally:
        _OPEN.pop()
    out = save(out, name)
    for path in left:
        at = out.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(out.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
    return out


def with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` plus KEY, a unique bigint that orders documents as their ids do.

    Unique non-null integer ids are the key themselves.  Otherwise (nulls,
    repeated ids, string ids) rows are numbered in the order (id, nulls last,
    text), so repeated rows are separate documents with a fixed order.
    """
    kind = docs.schema[id_col].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        ids = docs.groupBy(F.col(id_col)).count()
        if ids.where(F.col(id_col).isNull() | (F.col("count") > 1)).isEmpty():
            return docs.withColumn(KEY, F.col(id_col).cast("bigint"))
    return with_row_index(docs, [F.col(id_col).asc_nulls_last(), F.col(text_col).asc_nulls_last()], index_col=KEY)


def fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds`` (null id: of the empty text)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
