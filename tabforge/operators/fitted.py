"""Fit/apply contract shared by imputation, encoding and scaling.

``fit`` runs one aggregate job whatever the number of columns and returns a
small parameter object (one entry per column, bounded by the schema width).
``transform`` is a pure projection with the parameters as literals, so it
can be applied to other data (a test split, a stream) and consecutive steps
collapse into one ``Project``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Fitted:
    kind: str
    params: dict[str, dict[str, Any]] = field(default_factory=dict)

    def columns(self) -> list[str]:
        return list(self.params)

    def to_df(self, spark: SparkSession) -> DataFrame:
        """Parameters as a DataFrame ``(column, name, value)`` (values as text)."""
        rows = [(col, k, None if v is None else str(v))
                for col, p in self.params.items() for k, v in p.items()]
        return spark.createDataFrame(rows, "column string, name string, value string")

    def transform(self, df: DataFrame) -> DataFrame:  # pragma: no cover - abstract
        raise NotImplementedError
