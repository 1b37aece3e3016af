"""Large tables as weighted cells: what a tree learner sees of a table, each combination once.

MLlib's tree learners bin every feature (``maxBins``, 32) before they look at a
row, so rows with the same bins, label and fold are the same row to them. A
table far larger than the number of its cells is binned here first, by
quantiles over all rows (a feature of at most 32 values keeps them), counted
per cell and fold in one aggregation, and every fit and score reads the cells
with their numbers of rows as weights. No row is left out. The bins are a
``Bucketizer`` stage of the fitted pipeline, so a model applies to raw rows.

* Class labels are part of the cell. A numeric label is kept as its mean and
  squared deviations per cell and fold: split gains, leaf means and gradients
  of squared error need sums only, scores need the deviations too.
* Least rows per node are least weights.
* A forest's bootstrap stays one of rows: a cell of n rows is drawn
  Poisson(n) times for each tree, the sum of its rows' draws, and the mean of
  the drawn labels varies as a mean of that many rows does (normal, exact in
  its first two moments). Each tree is a fit of its own weights.

Bins differ from those that MLlib takes from a sample of about 10,000 rows, and
draws differ from its generator's: models equal those of rows up to that.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.functions import cols as C
from tabforge.plans import models as MD
from tabforge.session import python_workers

MAX_BINS = 32            # fixed value: MLlib's default, also for small tables
FROM_ROWS = 1 << 20      # smaller tables are trained as rows
RANKS = 1000             # a quantile's rank is off by 1/1000 of the rows at most; a bin holds 1/32
PAYS = 4                 # rows per cell from which cells are worth their aggregation
CELLS_PER_TASK, MOST_CELLS_PER_TASK = 50_000, 2_000_000
TREES_AT_ONCE = 3        # trees of one forest fitted at the same time
#: parameters whose meaning for weighted cells is known; with others rows are used
KNOWN = {"n_estimators", "max_depth", "min_samples_split", "learning_rate"}


@dataclass
class Facts:
    """What one scan tells of a table."""
    rows: int
    unlabelled: int              # rows without a target
    incomplete: int              # rows without a target or a feature
    distinct: dict[str, int]     # estimates


def facts(df: DataFrame, features: Sequence[str], target: str) -> Facts:
    """Sizes of a table and estimates of the distinct values of its columns, in one scan."""
    lacks = {n: C.is_missing(n, C.field(df, n).dataType) for n in [*features, target]}
    any_ = F.greatest(*lacks.values(), F.lit(False))
    found = df.agg(F.count(F.lit(1)), F.count_if(lacks[target]), F.count_if(any_), *[
        F.approx_count_distinct(C.c(n) if n == target else C.c(n).cast("double"), 0.02) for n in lacks]).first()
    return Facts(found[0], found[1], found[2], dict(zip(lacks, found[3:])))


def _edges(df: DataFrame, features: Sequence[str], distinct: dict[str, int]) -> dict[str, list[float]]:
    """Inner edges of each feature's bins (booleans have none): between all values if there are at most ``MAX_BINS``,
    else quantiles of all rows. One scan; about 50 values and 31 quantiles per feature reach the driver."""
    of = {n: C.c(n).cast("double") for n in features if not isinstance(C.field(df, n).dataType, T.BooleanType)}
    if not of:
        return {}
    number = [distinct[n] for n in of]
    shares = [i / MAX_BINS for i in range(1, MAX_BINS)]
    # the estimate decides who is asked for what, with a margin; the values themselves are exact
    found = df.agg(*[F.percentile_approx(x, shares, RANKS).alias(f"q{i}") for i, x in enumerate(of.values()) if number[i] > MAX_BINS / 1.5],
                   *[F.collect_set(x).alias(f"v{i}") for i, x in enumerate(of.values()) if number[i] <= 1.5 * MAX_BINS]).first().asDict()
    out = {}
    for i, n in enumerate(of):
        values = sorted(set(found.get(f"v{i}") or []))
        if values and len(values) <= MAX_BINS:
            out[n] = [(a + b) / 2 for a, b in zip(values, values[1:])]
        else:
            out[n] = [math.nextafter(q, math.inf) for q in found.get(f"q{i}") or []]
        out[n] = sorted({x for x in out[n] if math.isfinite(x)})
    return out


@dataclass
class Binning:
    """The feature stages of a pipeline over cells."""
    bucketizer: Bucketizer | None
    columns: list[str]
    cells: int           # estimate

    @property
    def stages(self) -> list:
        assembler = VectorAssembler(inputCols=self.columns, outputCol="features", handleInvalid="error")
        return [*([self.bucketizer] if self.bucketizer else []), assembler]


def binning(df: DataFrame, features: Sequence[str], target: str, task: str, known: Facts | None = None) -> Binning | None:
    """Bins for ``df``, or None where its cells are too many to be worth it: an estimate by one more scan, which a
    table with rows enough for all combinations of its bins and classes does not need."""
    known = known or facts(df, features, target)
    if known.rows < FROM_ROWS:
        return None
    if known.incomplete:
        return None  # rows with missing features are the assembler's error
    edges = _edges(df, features, known.distinct)
    taken = set(df.columns)
    names = {n: next(x for x in (f"__bin{j}_{i}" for j in range(len(taken) + 1)) if x not in taken) for i, n in enumerate(features)}
    cut = [n for n in features if edges.get(n)]
    bucketizer = Bucketizer(splitsArray=[[-math.inf, *edges[n], math.inf] for n in cut], inputCols=cut,
                            outputCols=[names[n] for n in cut], handleInvalid="error") if cut else None
    columns = [names[n] if n in cut else n for n in features]
    most = math.prod(len(edges[n]) + 1 if n in cut else known.distinct[n] for n in features)
    if task == "classification":
        most *= known.distinct[target]
    if most * PAYS <= known.rows:
        return Binning(bucketizer, columns, most)
    binned = bucketizer.transform(df) if bucketizer else df
    key = [C.c(n) for n in columns] + ([C.c(target)] if task == "classification" else [])
    cells = binned.agg(F.approx_count_distinct(F.xxhash64(*key), 0.02)).first()[0]
    if cells * PAYS > known.rows:
        return None
    return Binning(bucketizer, columns, cells)


class Cells:
    """A table's cells with the rows and the label of each part: one per fold, the test rows as the last."""

    def __init__(self, marked: DataFrame, bins: Binning, task: str, folds: int, label: str):
        self.task, self.folds = task, folds
        self.names = [f"b{i}" for i in range(len(bins.columns))]
        self.assembler = VectorAssembler(inputCols=self.names, outputCol="features", handleInvalid="error")
        cores = marked.sparkSession.sparkContext.defaultParallelism
        part = F.when(F.col("__split") == "train", F.col("fold").cast("int")).otherwise(folds).alias("part")
        table = marked.select(*[C.c(n).cast("double").alias(b) for n, b in zip(bins.columns, self.names)],
                              C.c(label).cast("double").alias("label"), part)
        key = [*self.names, "label"] if task == "classification" else self.names
        facts = {"n": F.count(F.lit(1)).cast("double")}
        if task == "regression":
            facts |= {"m": F.avg("label"), "s": F.var_pop("label") * F.count(F.lit(1))}
        per = table.groupBy(*key, "part").agg(*[x.alias(f) for f, x in facts.items()])
        # few cells are few tasks: a fit is a dozen short jobs
        tasks = max(min(cores, math.ceil(bins.cells / CELLS_PER_TASK)), math.ceil(bins.cells / MOST_CELLS_PER_TASK))
        own = [F.array(*[F.coalesce(F.sum(F.when(F.col("part") == j, F.col(f))), F.lit(0.0)) for j in range(folds + 1)]).alias(f)
               for f in facts]
        self.table = per.repartition(tasks, *key).groupBy(*key).agg(*own).sortWithinPartitions(*key).persist(StorageLevel.MEMORY_AND_DISK)
        self.table.count()

    def unpersist(self) -> None:
        self.table.unpersist()

    def _some(self, parts: Sequence[int]) -> DataFrame:
        """``label``, ``weight`` and ``within`` of the cells over some parts."""
        def total(of):
            return sum((of(j) for j in parts[1:]), of(parts[0]))
        if self.task == "classification":
            out = self.table.select(*self.names, "label", total(lambda j: F.col("n")[j]).alias("weight"))
            return out.where(F.col("weight") > 0)
        # a cell without rows has nothing to divide by
        rows = self.table.withColumn("weight", total(lambda j: F.col("n")[j])).where(F.col("weight") > 0)
        rows = rows.withColumn("label", total(lambda j: F.col("n")[j] * F.col("m")[j]) / F.col("weight"))
        within = total(lambda j: F.col("s")[j] + F.col("n")[j] * (F.col("m")[j] - F.col("label")) * (F.col("m")[j] - F.col("label")))
        return rows.select(*self.names, "label", "weight", within.alias("within"))

    def without(self, fold: int | None = None) -> DataFrame:
        """The train rows, or those of all folds but one."""
        return self._some([j for j in range(self.folds) if j != fold])

    def rows_of(self, fold: int) -> DataFrame:
        return self.assembler.transform(self._some([fold]))

    def train(self) -> DataFrame:
        return self.assembler.transform(self.without())

    def test(self) -> DataFrame:
        return self.rows_of(self.folds)

    def fit(self, model: str, n_classes: int, params: dict, fold: int | None = None):
        """Fit on the train rows, or on those of all folds but one."""
        data = self.without(fold)
        if MD.family(model) == "gbt":
            data = self.assembler.transform(data).select("features", "label", "weight").persist(StorageLevel.MEMORY_AND_DISK)
            try:
                return self._weighted(MD.make_estimator(model, self.task, n_classes, params, weight="weight"), data).fit(data)
            finally:
                data.unpersist()
        est = MD.make_estimator(model, self.task, n_classes, params, weight="weight")
        trees = est.getNumTrees()
        drawn = self._drawn(data, trees, MD.SEED + (0 if fold is None else fold + 1)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            def one(t):
                y = F.col("label") if self.task == "classification" else F.col("ys")[t]
                own = drawn.select("features", y.cast("double").alias("label"), F.col("ns")[t].cast("double").alias("weight"))
                own = own.where(F.col("weight") > 0)
                single = MD.make_estimator(model, self.task, n_classes, {**params, "n_estimators": 1}, weight="weight")
                single.setBootstrap(False).setSeed(MD.SEED + t)
                return self._weighted(single, own).fit(own)
            with ThreadPoolExecutor(max_workers=TREES_AT_ONCE) as ex:
                return MD.joined(list(ex.map(one, range(trees))))
        finally:
            drawn.unpersist()

    def _weighted(self, est, data: DataFrame):
        """Least rows per node as least weight: a cell may be many rows."""
        inner = est.getClassifier() if hasattr(est, "getClassifier") else est
        least = inner.getMinInstancesPerNode()
        if least > 1:
            rows = data.agg(F.sum("weight")).first()[0]
            inner.setMinInstancesPerNode(1).setMinWeightFractionPerNode(min(0.49999, (least - 0.5) / rows))
        return est

    def _drawn(self, data: DataFrame, trees: int, seed: int) -> DataFrame:
        """Bootstrap draws of each cell's rows for each tree: ``ns``, and for a numeric label the drawn rows' mean ``ys``."""
        python_workers(data.sparkSession)
        numeric = self.task == "regression"

        def draw(batches):
            rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
            for frame in batches:
                n = frame["weight"].to_numpy()
                ns = rng.poisson(n[:, None], (len(n), trees))
                out = {c: frame[c] for c in frame.columns if c not in ("weight", "within")}
                if numeric:
                    spread = np.sqrt(frame["within"].to_numpy() / n)[:, None] / np.sqrt(np.maximum(ns, 1))
                    out["ys"] = list(frame["label"].to_numpy()[:, None] + spread * rng.standard_normal(ns.shape))
                yield pd.DataFrame({**out, "ns": list(ns.astype(np.int32))})

        fields = [f"{b} double" for b in self.names] + ["label double"] + (["ys array<double>"] if numeric else []) + ["ns array<int>"]
        frames = data.mapInPandas(draw, ", ".join(fields))
        return self.assembler.transform(frames).select("features", "label", "ns", *(["ys"] if numeric else []))


class Rows:
    """The assembled table itself, with the same parts and fits."""

    def __init__(self, base: DataFrame, task: str):
        self.base, self.task = base, task
        self._train = base.where(F.col("__split") == "train").select("features", "label", "fold")

    def unpersist(self) -> None:
        self.base.unpersist()

    def rows_of(self, fold: int) -> DataFrame:
        return self._train.where(F.col("fold") == fold)

    def train(self) -> DataFrame:
        return self._train

    def test(self) -> DataFrame:
        return self.base.where(F.col("__split") == "test").select("features", "label")

    def fit(self, model: str, n_classes: int, params: dict, fold: int | None = None):
        data = self._train if fold is None else self._train.where(F.col("fold") != fold)
        return MD.make_estimator(model, self.task, n_classes, params).fit(data)
