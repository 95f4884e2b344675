"""Batch scoring by model name.

The reference scored one HTTP record at a time with lags set to 0; here a
whole batch goes through the stored pipeline.  Given the hourly history, lags
come from it (D12); text columns get the codes the model was trained with (D11).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.artefacts import load_mapping, load_model
from .features import calendar_features, history_lags, label_encode
from .models import predict
from .schema import align_columns


def expected_features(model) -> list[str]:
    """The feature contract is stored in the pipeline's assembler."""
    return list(model.stages[0].getInputCols())


def score(df: DataFrame, models_dir: str, name: str, ts: str | None = None,
          keep: Sequence[str] = (), fill=None, history: DataFrame | None = None, value: str = "n") -> DataFrame:
    """Calendar features -> lags from ``history`` -> label codes stored with the model
    -> align to the model's stored feature list -> predict.  Raises if the model does not exist.

    A feature that is missing or NULL takes ``fill`` where that is asked for; without it the features stay
    unknown, and a row whose prediction is not a number then has ``pred`` NULL (trees know what
    to do with unknown features, a linear model doesn't).

    ``history`` has ``ts`` and ``value``, one row an hour; each ``<value>_lag_<l>`` the model wants and
    the frame lacks is its value ``l`` hours before.
    """
    model = load_model(models_dir, name)
    if ts and "hour" not in df.columns:
        df = calendar_features(df, ts, "hourly")
    feats = expected_features(model)
    if history is not None:
        lags = [int(f.removeprefix(f"{value}_lag_")) for f in feats
                if re.fullmatch(re.escape(value) + r"_lag_\d+", f) and f not in df.columns]
        df = history_lags(df, history, value, lags, ts)
    mapping = load_mapping(df.sparkSession, models_dir, name)
    if mapping is not None:
        coded = [r["column"] for r in mapping.select("column").distinct().collect()]  # one row a column
        df, _ = label_encode(df.withColumns({c: F.lit(None).cast("string") for c in coded if c not in df.columns}), coded, mapping=mapping)
    x = align_columns(df, list(keep) + feats, fill=fill)
    return predict(model, x).select(*keep, F.when(~F.isnan("pred"), F.col("pred")).alias("pred")).withColumn("model", F.lit(name))
