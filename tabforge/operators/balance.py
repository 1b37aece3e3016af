"""Class balancing (B1-B4): undersampling, oversampling, class weights; synthesis is in :mod:`smote`.

Which rows are kept or copied is decided by a seeded row hash, never by row
position. Rows are compared with a threshold of their class
(:mod:`tabforge.functions.selection`) and stay in their partition; only a row
that is repeated across a threshold is grouped and counted. A row with more than
``CHUNK`` copies is re-expanded in two steps (chunks, then rows inside a chunk)
so no single task has to emit an unbounded number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.functions import cols as C
from tabforge.functions import selection as SE
from tabforge.session import default_partitions

DEFAULT_SEED = 42
CHUNK = 1_000            # rows emitted per chunk when re-expanding copies


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """``(label, count)`` per class (missing labels form no class)."""
    return df.where(C.c(label).isNotNull()).groupBy(C.c(label).alias(label)) \
        .agg(F.count(F.lit(1)).alias("count"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``(label, count, weight)`` with ``weight = n / (k * n_c)``."""
    cc = class_counts(df, label)
    total = cc.agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("k")).first()
    return cc.select(label, "count", (F.lit(total["n"]) / (F.lit(total["k"]) * F.col("count"))).alias("weight"))


def with_class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Attach the B3 weight to every row (usable as an MLlib ``weightCol``)."""
    w = class_weights(df, label).select(F.col(label).alias("__y"), F.col("weight").alias(name))
    return df.join(w, C.c(label).eqNullSafe(F.col("__y")), "left").drop("__y")


def class_groups(df: DataFrame, label: str) -> SE.Groups:
    """The classes and their sizes; a missing label is an error."""
    found = SE.group_sizes(df, [label])
    if any(r[0] is None or r[0] != r[0] for r in found.rows):
        raise ValueError(f"{label} has missing values; drop or fill those rows before balancing")
    return found


def row_order(df: DataFrame, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[C.c(n) for n in df.columns])


def expand(df: DataFrame, copies: Column, columns: list[str]) -> DataFrame:
    """Emit each row ``copies`` times, in chunks of ``CHUNK`` that are spread over tasks first, so that
    neither a hot row nor a small class that grows a lot is written by one task. ``df`` has a hash in ``__h``."""
    t = df.withColumn("__n", copies.cast("long")).where(F.col("__n") > 0)
    chunks = t.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"),
                                                      F.floor((F.col("__n") - 1) / CHUNK).cast("long"))))
    chunks = chunks.withColumn("__m", F.least(F.lit(CHUNK).cast("long"), F.col("__n") - F.col("__k") * CHUNK))
    chunks = chunks.repartition(default_partitions(df.sparkSession), "__h", "__k")
    rows = chunks.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__m"))))
    return rows.select(*[C.c(n) for n in columns])


def undersample(df: DataFrame, label: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """B1: every class cut to the size of the smallest class; the kept rows
    are the first in seeded hash order."""
    classes = class_groups(df, label)
    least = min(classes.sizes, default=0)
    out = SE.deal(df, row_order(df, seed), classes, [[least]] * len(classes.sizes), "__part")
    return out.where(F.col("__part") == 0).drop("__part")


def oversample(df: DataFrame, label: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """B2: every class grown to the size of the largest class: each row is
    repeated ``floor(M / n_c)`` times and the remainder is taken in seeded
    hash order."""
    classes = class_groups(df, label)
    most = max(classes.sizes, default=0)
    out = SE.deal(df, row_order(df, seed), classes, [[most % n] for n in classes.sizes], "__part",
                  [("__q", T.LongType(), [most // n for n in classes.sizes])])
    copies = F.col("__q") + (F.col("__part") == 0).cast("long")
    cols = df.columns
    few = out.where(F.col("__q") < CHUNK).withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    few = few.select(*[C.c(n) for n in cols])
    if all(most // n < CHUNK for n in classes.sizes):
        return few
    many = out.where(F.col("__q") >= CHUNK).withColumn("__h", row_order(df, seed))
    return few.unionByName(expand(many, copies, cols))
