"""Versioned model folders with one pointer to the version in use.

    <models_dir>/<name>/versions/<version>/model, metrics.json
    <models_dir>/<name>/CURRENT          the version in use, one line

A version is written whole to a folder of its own and never changed.  Promotion then replaces the
pointer by one rename of a finished file, so a reader finds the old version or the new one, also
while a model is written and when the writer stops half way.  (HDFS and local file systems rename
in one step; a store that can't needs its own pointer, behind :func:`point`.)
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

POINTER = "CURRENT"


def _at(spark: SparkSession, path: str):
    """(file system, path) of a Hadoop path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _read(spark: SparkSession, path: str) -> str | None:
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _write(spark: SparkSession, path: str, said: str) -> None:
    fs, p = _at(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(said.encode()))
    finally:
        stream.close()


def _folder(models_dir: str, name: str) -> str:
    return f"{models_dir.rstrip('/')}/{name}"


def save_version(spark: SparkSession, model: PipelineModel, models_dir: str, name: str, metrics: dict) -> str:
    """A new version of ``name``; returns its id.  Nobody reads it until it is pointed to."""
    version = uuid.uuid4().hex
    base = f"{_folder(models_dir, name)}/versions/{version}"
    model.write().save(f"{base}/model")
    _write(spark, f"{base}/metrics.json", json.dumps(metrics))
    return version


def current(spark: SparkSession, models_dir: str, name: str) -> str | None:
    """The version in use, None before the first promotion."""
    said = _read(spark, f"{_folder(models_dir, name)}/{POINTER}")
    return said.strip() if said else None


def point(spark: SparkSession, models_dir: str, name: str, version: str) -> None:
    """Make ``version`` the one in use, in one step."""
    if _read(spark, f"{_folder(models_dir, name)}/versions/{version}/metrics.json") is None:
        raise ValueError(f"{name} has no finished version {version}")
    new = f"{_folder(models_dir, name)}/.{POINTER}-{uuid.uuid4().hex}"
    _write(spark, new, version)
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    target = _at(spark, f"{_folder(models_dir, name)}/{POINTER}")
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target[0].getUri(), spark._jsc.hadoopConfiguration())
    files.rename(_at(spark, new)[1], target[1], options)


def metrics_of(spark: SparkSession, models_dir: str, name: str, version: str | None) -> dict:
    said = _read(spark, f"{_folder(models_dir, name)}/versions/{version}/metrics.json") if version else None
    return json.loads(said) if said else {}


def load_current(spark: SparkSession, models_dir: str, name: str) -> PipelineModel:
    """The model in use (raises when none is)."""
    version = current(spark, models_dir, name)
    if version is None:
        raise ValueError(f"no version of {name} is in use in {models_dir}")
    return PipelineModel.load(f"{_folder(models_dir, name)}/versions/{version}/model")


def _known(value) -> bool:
    return isinstance(value, (int, float)) and not math.isnan(value)


def promote(spark: SparkSession, model: PipelineModel, models_dir: str, name: str, metrics: dict, by: str = "rmse") -> dict:
    """Save the model as a new version, and make it the one in use if none is (or that has no ``by``), or if its ``by``
    is strictly less.  A model without the metric is saved but never promoted."""
    before = current(spark, models_dir, name)
    old, new = metrics_of(spark, models_dir, name, before).get(by), metrics.get(by)
    version = save_version(spark, model, models_dir, name, metrics)
    better = _known(new) and (not _known(old) or new < old)
    if better:
        point(spark, models_dir, name, version)
    return {"version": version, "previous": before, "candidate": new, "current": old, "promoted": better}
