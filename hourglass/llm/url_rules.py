"""Operator 10: URL rules by a sort-merge range join.

A host's key is its labels reversed, each with a dot ("net.example."), so a rule's
host with all its subdomains is one interval of keys.  Pages and rules are dealt to
ranges of (key, path, row) by bounds from a sample; a rule goes to every range its interval
meets.  Each range is sorted once and swept: a stack keeps the rules whose
intervals are open (hosts nested in each other), and a page takes, among those whose path
its own starts with, the one with the longest host, then the longest path (then the first
verdict in alphabetical order).

A host with a third of all pages is split, as ranges go on over path and row.  The bounds
decide only where rows go.  A range needs its stack in memory, nothing else.

Null url or no "://": host and path empty, no rule.  No rule: ``default``.  Repeated rows,
null ids: row for row.  Rules with null or empty hosts fit nothing; null paths count as "/";
repeated rules count once.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

DEFAULT = "allow"
SAMPLES = 20               # sampled keys a range
#: The rules of the registered query (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_hgl_url, instr(_hgl_url, '://') + 3)")).otherwise(F.lit(""))
    return (F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _bounds(pages: DataFrame, parts: int) -> list[bytes]:
    """Upper ends of ranges, from a sample of at most about SAMPLES * parts keys."""
    n = pages.count()
    if not n or parts < 2:
        return []
    keys = sorted(bytes(r["k"]) for r in pages.select(F.col("_hgl_at").alias("k")).sample(min(1.0, SAMPLES * parts / n), seed=5).collect())
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def _sweep(names: list[str], default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[tuple[str, dict]] = []
        last = None
        for b in batches:
            n = len(names)
            part, key, path, label, verdict = (b.column(n + k).to_pylist() for k in range(5))
            rules, verdicts, page = [], [], []
            for i in range(b.num_rows):
                if part[i] != last:
                    open_, last = [], part[i]
                while open_ and not key[i].startswith(open_[-1][0]):
                    open_.pop()
                if label[i] is not None:
                    if not open_ or open_[-1][0] != key[i]:
                        open_.append((key[i], {}))
                    open_[-1][1].setdefault(path[i], (label[i], verdict[i]))
                    continue
                found = (None, default)
                for _, own in reversed(open_):
                    fit = [p for p in own if path[i].startswith(p)]
                    if fit:
                        found = own[max(fit, key=len)]
                        break
                page.append(i)
                rules.append(found[0])
                verdicts.append(found[1])
            yield pa.RecordBatch.from_arrays([b.column(k).take(pa.array(page, pa.int64())) for k in range(n)] + [
                pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=[*names, "_hgl_rule", "_hgl_verdict"])
    return run


def apply_rules(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """``pages`` plus _hgl_host, _hgl_path, _hgl_rule ("host/path" as the rule is written) and
    _hgl_verdict; ``rules`` has host, path, verdict.  Select the columns needed first: they are shuffled."""
    spark = pages.sparkSession
    common.ready(spark)
    host, path = host_and_path(F.col("_hgl_url"))
    rows = (pages.withColumn("_hgl_url", F.col(url_col)).withColumns({"_hgl_host": F.coalesce(host, F.lit("")), "_hgl_path": F.coalesce(path, F.lit(""))})
            .drop("_hgl_url").withColumn("_hgl_key", reversed_host(F.col("_hgl_host"))))
    spread = F.hex(F.xxhash64(*[F.col(c).cast("string") for c in pages.columns]))
    rows = rows.withColumn("_hgl_at", F.concat(F.col("_hgl_key"), F.lit("\x01"), F.col("_hgl_path"), F.lit("\x01"), spread).cast("binary"))
    bounds = _bounds(rows, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared = spark.sparkContext.broadcast(bounds)
    names = [*pages.columns, "_hgl_host", "_hgl_path"]

    def page_parts(batches):
        for b in batches:
            at = [bisect_right(shared.value, k) for k in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(at, pa.int32())], names=[*b.schema.names[:-1], "_hgl_part"])

    def rule_parts(batches):
        for b in batches:
            key = b.column(0).to_pylist()
            low = [bisect_right(shared.value, k.encode()) for k in key]
            high = [bisect_right(shared.value, k[:-1].encode() + b"/") for k in key]   # "/" follows "."
            n = np.array(high) - np.array(low) + 1 if key else np.zeros(0, np.int64)
            take = np.repeat(np.arange(len(key)), n)
            at = np.concatenate([np.arange(x, y + 1) for x, y in zip(low, high)]) if key else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(take)) for c in b.columns] + [pa.array(at.astype(np.int32))],
                                             names=[*b.schema.names, "_hgl_part"])

    part = T.StructField("_hgl_part", T.IntegerType())
    placed = rows.select(*names, "_hgl_key", "_hgl_at")
    placed = placed.mapInArrow(page_parts, T.StructType(placed.drop("_hgl_at").schema.fields + [part]))
    clean = rules.select("host", F.coalesce("path", F.lit("/")).alias("path"), "verdict").where("host <> ''").distinct()
    clean = clean.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    clean = clean.select(reversed_host(F.translate("host", UPPER, LOWER)).alias("_hgl_key"), F.col("path").alias("_hgl_rule_path"),
                         F.concat("host", "path").alias("_hgl_label"), F.col("verdict").alias("_hgl_said"))
    dealt = clean.mapInArrow(rule_parts, T.StructType(clean.schema.fields + [part]))
    events = placed.select(*names, "_hgl_part", "_hgl_key", F.col("_hgl_path").alias("_hgl_rule_path"),
                           F.lit(None).cast("string").alias("_hgl_label"), F.lit(None).cast("string").alias("_hgl_said"))
    events = events.unionByName(dealt, allowMissingColumns=True)
    kinds = T.StructType([pages.schema[c] for c in pages.columns] + [
        T.StructField(c, T.StringType()) for c in ("_hgl_host", "_hgl_path", "_hgl_rule", "_hgl_verdict")])
    return (events.repartition("_hgl_part")
            .sortWithinPartitions("_hgl_part", "_hgl_key", F.col("_hgl_label").asc_nulls_last())
            .mapInArrow(_sweep(names, default), kinds))


ORACLE = """
WITH u AS (SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
