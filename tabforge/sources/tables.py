"""Named tables over a parquet folder (``<dir>/<name>.parquet``).

The reference ships four named sample tables; here the catalog is the set of
parquet tables in a folder, each with an optional default target and task.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tabforge.functions.cols import normalize_missing

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# default (target, task) per table where one is meaningful
TASK_HINTS = {
    "lineitem": ("l_returnflag", "classification"),
    "labels": ("quality", "classification"),
    "orders": ("o_totalprice", "regression"),
    "part": ("p_retailprice", "regression"),
    "customer": ("c_mktsegment", "classification"),
}


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load_table(spark: SparkSession, sf_dir: str, name: str,
               normalize: bool = True, spread: bool = False) -> DataFrame:
    """Read one table. ``normalize`` turns NaN into NULL once at ingestion, so
    NULL is the only missing marker downstream (a no-op projection for
    tables without float columns).

    ``spread`` (opt-in): a parquet file is split only at row-group boundaries, so a
    small table written as one row group scans in a single task while the
    other cores idle. When the scan yields fewer splits than half the
    default parallelism, the rows are dealt round-robin over the cores once.
    A large table (many files / row groups) already has enough splits and is
    left alone, so this adds no shuffle at scale.
    """
    if name not in TABLES and not os.path.exists(table_path(sf_dir, name)):
        raise KeyError(f"unknown table {name!r}")
    df = spark.read.parquet(table_path(sf_dir, name))
    if spread:
        df = spread_small(df)
    return normalize_missing(df) if normalize else df


def spread_small(df: DataFrame) -> DataFrame:
    target = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() * 2 <= target else df


def task_hint(name: str) -> tuple[str, str] | None:
    return TASK_HINTS.get(name)
