"""Connected components of a graph given as an edge table; nothing but a row count reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import FEW, cut, few


def components(edges: DataFrame) -> DataFrame:
    """(v, c) for every vertex of edges (a, b): c is the smallest vertex that v is connected to.

    Each round takes the smallest label among the neighbours and then the label's label, so that long paths
    halve; it ends when a round changes nothing. The labels of at most ``FEW`` vertices are broadcast and lie in
    no more partitions than there are cores: a round is one small shuffle then.
    """
    back = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    both = cut(edges.select(F.inline(F.array(F.struct("a", "b"), back))))
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("c")))
    n, cores = labels.count(), edges.sparkSession.sparkContext.defaultParallelism
    while True:
        near = both.join(few(labels, n), F.col("b") == F.col("v")).groupBy("a").agg(F.min("c").alias("m"))
        if n <= FEW:
            near = near.coalesce(cores)
        step = near.join(few(labels, n), F.col("a") == F.col("v")).select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        target = step.select(F.col("v").alias("t"), F.col("c").alias("further"))
        step = cut(step.join(few(target, n), F.col("c") == F.col("t")).select("v", "old", F.col("further").alias("c")))
        labels = step.select("v", "c")
        if step.where("old <> c").isEmpty():
            return labels
