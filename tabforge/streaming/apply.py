"""Apply fitted preprocessing and models to a streaming DataFrame.

Imputers, scalers and one-hot encoders from tabforge are projections with
literal parameters, and MLlib ``PipelineModel`` stages are row-wise, so the
same objects fitted on a batch table score a ``readStream`` source without
state. (Label encoding joins a mapping table; a stream-static join also
works, but the mapping must be fitted first.)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame


def apply_fitted(stream: DataFrame, steps: Sequence) -> DataFrame:
    """Apply fitted steps (objects with ``transform``) in order."""
    out = stream
    for s in steps:
        out = s.transform(out)
    return out


def score_stream(stream: DataFrame, model: PipelineModel, keep: Sequence[str] = ()) -> DataFrame:
    """Predictions for each micro-batch: ``keep`` columns plus ``prediction``."""
    return model.transform(stream).select(*keep, "prediction")
