"""Versioned storage, head sample and exports."""

from __future__ import annotations

import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.functions.cols import c


def save_version(df: DataFrame, base: str, version: str) -> str:
    """Write a table version as parquet; returns its path."""
    path = os.path.join(base, version)
    df.write.mode("overwrite").parquet(path)
    return path


def load_version(spark: SparkSession, base: str, version: str) -> DataFrame:
    return spark.read.parquet(os.path.join(base, version))


def describe_version(df: DataFrame, version: str) -> DataFrame:
    """The reference's descriptor ``{id, shape, columns, dtypes}`` as one row."""
    cols = [f.name for f in df.schema.fields]
    types = [f.dataType.simpleString() for f in df.schema.fields]
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(version).alias("id"), "n_rows", F.lit(len(cols)).alias("n_cols"),
        F.array(*[F.lit(x) for x in cols]).alias("columns"),
        F.array(*[F.lit(x) for x in types]).alias("dtypes"))


def head(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows with +-inf shown as missing. Spark has no row
    order, so pass ``order_by`` for a reproducible sample."""
    out = df.orderBy(*[c(x) for x in order_by]) if order_by else df
    cleaned = [F.when(F.abs(c(f.name)) == F.lit(float("inf")), F.lit(None)).otherwise(c(f.name)).alias(f.name)
               if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c(f.name)
               for f in df.schema.fields]
    return out.limit(n).select(*cleaned)


def export_results(df: DataFrame, path: str) -> None:
    """Write evaluation results as JSON lines."""
    df.write.mode("overwrite").json(path)


def export_data(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write the preprocessed table (parquet or csv with header)."""
    w = df.write.mode("overwrite")
    if fmt == "parquet":
        w.parquet(path)
    elif fmt == "csv":
        # text as it is: blanks stay, quotes are doubled, a backslash is an ordinary sign
        (w.option("header", True).option("quote", '"').option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    else:
        raise ValueError(f"unknown format {fmt!r}")


def export_model(model: PipelineModel, path: str) -> None:
    """Save a fitted pipeline (features + estimator)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
