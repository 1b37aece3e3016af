"""Classes grown by synthesis (SMOTE): new rows between a row and one of its nearest rows of the same class.

Every class gets as many rows as the largest has. A class's new rows are dealt
evenly over its rows (the remainder in seeded hash order); each lies at a random
place between its row and one of the row's ``k`` nearest neighbours in the class.
Which neighbour and which place are hashes of the row's values and the number of
the copy, so the result is the same for any partitioning and on retries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.functions import cols as C
from tabforge.functions import selection as SE
from tabforge.operators import balance as BA
from tabforge.operators import neighbours as NB
from tabforge.session import default_partitions

NEIGHBOURS = 5


def synthetic(df: DataFrame, label: str, features: Sequence[str], k: int = NEIGHBOURS, seed: int = BA.DEFAULT_SEED,
              leaf: int = NB.LEAF) -> DataFrame:
    """(label, base, neighbour, gap, x): the new points of every class with the points that they lie between.

    A class of one row has no neighbours: its new points equal it.
    """
    classes = BA.class_groups(df, label)
    most = max(classes.sizes, default=0)
    rows = df.select(*[C.c(n) for n in dict.fromkeys([label, *features])])
    dealt = SE.deal(rows, BA.row_order(rows, seed), classes, [[(most - n) % n] for n in classes.sizes], "__part",
                    [("__q", T.LongType(), [(most - n) // n for n in classes.sizes]),
                     ("__c", T.IntegerType(), list(range(len(classes.sizes)))), ("__all", T.LongType(), list(classes.sizes))])
    small = dealt.where(F.col("__all") < most)
    points = NB.points_of(small, features, "__c")
    due = small.groupBy(F.col("__c").alias("g"), F.array(*[C.c(f).cast("double") + F.lit(0.0) for f in features]).alias("x")).agg(
        F.sum(F.col("__q") + (F.col("__part") == 0).cast("long")).alias("due"), F.min("__all").alias("all"))
    base = due.where("due > 0").join(NB.nearest(points, k, max(1, len(classes.sizes)), leaf), ["g", "x"])
    # copies in chunks that are spread first: a point with many rows, or a small class, is no task of its own
    chunk = F.lit(BA.CHUNK).cast("long")
    base = base.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("due") - 1) / chunk))))
    base = base.repartition(default_partitions(df.sparkSession), F.xxhash64("x"), "c")
    base = base.withColumn("i", F.explode(F.sequence(F.col("c") * chunk, F.least((F.col("c") + 1) * chunk, F.col("due")) - 1)))
    draw = F.xxhash64(F.lit(seed + 1), "g", "x", "i")
    slots = F.least(F.lit(k).cast("long"), F.col("all") - 1)
    upto = F.transform("near", lambda e, j: F.struct(
        e["x"].alias("x"), F.aggregate(F.slice("near", 1, j + 1), F.lit(0).cast("long"), lambda a, b: a + b["n"]).alias("upto")))
    slot = F.pmod(draw, F.greatest(slots, F.lit(1)))
    pick = F.get(F.filter(upto, lambda e: e["upto"] > slot), F.lit(0))["x"]
    gap = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 2), "g", "x", "i"), 11) / F.lit(float(1 << 53))
    out = base.select("g", F.col("x").alias("base"), F.coalesce(pick, F.col("x")).alias("neighbour"), gap.alias("gap"))
    out = out.withColumn("x", F.zip_with("base", "neighbour", lambda a, b: a + F.col("gap") * (b - a)))
    names = df.sparkSession.createDataFrame([(i, r[0]) for i, r in enumerate(classes.rows)],
                                            T.StructType([T.StructField("g", T.IntegerType()), T.StructField(label, C.field(df, label).dataType)]))
    return out.join(F.broadcast(names), "g").select(C.c(label), "base", "neighbour", "gap", "x")


def smote(df: DataFrame, label: str, features: Sequence[str] | None = None, k: int = NEIGHBOURS,
          seed: int = BA.DEFAULT_SEED, mark: str | None = None) -> DataFrame:
    """The rows of ``df`` and the new ones; features become doubles, other columns are NULL in new rows.

    ``features`` are all columns but the label unless given; they must be numeric and without missing values.
    ``mark`` names an optional boolean column that is true for new rows.
    """
    features = list(features) if features is not None else [n for n in df.columns if n != label]
    text = [n for n in features if not C.is_numeric(C.field(df, n).dataType)]
    if text:
        raise ValueError(f"encode these columns before synthesis (non-numeric features): {text}")
    new = synthetic(df, label, features, k, seed)
    at = {n: i for i, n in enumerate(features)}
    old = df.select(*[C.c(n).cast("double").alias(n) if n in at else C.c(n) for n in df.columns])
    made = new.select(*[F.get("x", F.lit(at[n])).alias(n) if n in at else C.c(n) if n == label
                        else F.lit(None).cast(C.field(df, n).dataType).alias(n) for n in df.columns])
    if mark:
        old, made = old.withColumn(mark, F.lit(False)), made.withColumn(mark, F.lit(True))
    return old.unionByName(made)
