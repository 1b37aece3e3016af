"""Task detection (T1-T3), train/test split (T4) and fold assignment (H5).

Row placement is a function of the row's values (a seeded ``xxhash64``), not
of its position, so it does not change when the table is repartitioned or a
task is retried. The hashed forms put identical rows on the same side; the
exact forms (:func:`exact_split`, :func:`exact_folds`) compare each row with the
hash at a rank and deal only the copies of a row that a rank divides.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.functions import cols as C
from tabforge.functions import selection as SE
from tabforge.functions.ordered import prefix_sums

# Fixed values from the reference.
DEFAULT_TEST_SIZE = 0.2
DEFAULT_SEED = 42
DEFAULT_FOLDS = 5
# An int32/int64 target with at most this many distinct values is a class label.
CLASS_MAX_DISTINCT = 20
# A numeric target whose distinct/rows ratio is below this is a class label.
CLASS_MAX_RATIO = 0.05
_BUCKETS = 10_000


def row_hash(df: DataFrame, seed: int = DEFAULT_SEED, key_cols: Sequence[str] | None = None) -> Column:
    cols = list(key_cols) if key_cols else df.columns
    return F.xxhash64(F.lit(seed), *[C.c(n) for n in cols])


# ---------------------------------------------------------------- T1-T3

def task_stats(df: DataFrame, target: str) -> DataFrame:
    """``(target, dtype, n_unique, n_rows, task_type)``.

    Rule: non-numeric -> classification; int32/int64 with at most 20 distinct
    values -> classification; distinct / rows < 0.05 -> classification;
    otherwise regression. Distinct ignores missing values, rows include them.
    """
    if target not in df.columns:
        raise KeyError(f'Target column "{target}" not found')
    dt = C.field(df, target).dataType
    numeric = C.is_numeric(dt) or isinstance(dt, T.BooleanType)
    small_int = isinstance(dt, (T.IntegerType, T.LongType))
    u = df.select(C.c(target)).where(C.c(target).isNotNull()).distinct() \
        .agg(F.count(F.lit(1)).alias("n_unique"))
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    j = u.select("n_unique", F.lit(None).cast("long").alias("n_rows")) \
        .unionByName(n.select(F.lit(None).cast("long").alias("n_unique"), "n_rows")) \
        .agg(F.max("n_unique").alias("n_unique"), F.max("n_rows").alias("n_rows"))
    if not numeric:
        task = F.lit("classification")
    else:
        ratio = F.try_divide(F.col("n_unique"), F.col("n_rows"))
        task = (F.when(F.lit(small_int) & (F.col("n_unique") <= CLASS_MAX_DISTINCT), "classification")
                .when(ratio < CLASS_MAX_RATIO, "classification").otherwise("regression"))
    return j.select(F.lit(target).alias("target"), F.lit(C.dtype_name(dt)).alias("dtype"),
                    "n_unique", "n_rows", task.alias("task_type"))


def detect_task(df: DataFrame, target: str) -> str:
    if target in df.columns:
        dt = C.field(df, target).dataType
        if not (C.is_numeric(dt) or isinstance(dt, T.BooleanType)):
            return "classification"  # whatever its counts
    return task_stats(df, target).first()["task_type"]


def features_and_label(df: DataFrame, target: str) -> tuple[list[str], str]:
    """Every other column is a feature, in table order."""
    if target not in df.columns:
        raise KeyError(f'Target column "{target}" not found')
    return [n for n in df.columns if n != target], target


# ---------------------------------------------------------------- T4

def mark_split(df: DataFrame, test_size: float = DEFAULT_TEST_SIZE, seed: int = DEFAULT_SEED,
               key_cols: Sequence[str] | None = None, name: str = "split") -> DataFrame:
    """Add ``split`` = 'train' | 'test' by seeded row hash (approximate size)."""
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must be in (0, 1)")
    b = F.pmod(row_hash(df, seed, key_cols), F.lit(_BUCKETS))
    return df.withColumn(name, F.when(b < F.lit(int(round(test_size * _BUCKETS))), "test").otherwise("train"))


def train_test_split(df: DataFrame, test_size: float = DEFAULT_TEST_SIZE, seed: int = DEFAULT_SEED,
                     key_cols: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    m = mark_split(df, test_size, seed, key_cols, "__split")
    return (m.where(F.col("__split") == "train").drop("__split"),
            m.where(F.col("__split") == "test").drop("__split"))


# ---------------------------------------------------------------- H5

def assign_folds(df: DataFrame, k: int = DEFAULT_FOLDS, seed: int = DEFAULT_SEED,
                 stratify: str | None = None, key_cols: Sequence[str] | None = None,
                 name: str = "fold") -> DataFrame:
    """Add ``fold`` in ``[0, k)``.

    Without ``stratify``: seeded hash modulo ``k``. With ``stratify=label``
    the rows of every class are ranked by hash and dealt round-robin, so each
    fold gets its share of each class (exact up to identical rows, which stay
    together). The ranking is a distributed running count over distinct
    (label, hash) keys, never a window over a whole class.
    """
    h = row_hash(df, seed, key_cols)
    if stratify is None:
        return df.withColumn(name, F.pmod(h, F.lit(k)).cast("int"))
    keyed = df.withColumn("__h", h)
    counts = keyed.groupBy(C.c(stratify).alias("__y"), "__h").agg(F.count(F.lit(1)).alias("__c"))
    ranked = prefix_sums(counts, "__y", ["__h"], ["__c"], prefix="__cum")
    ranked = ranked.select(F.col("__y").alias("__y2"), F.col("__h").alias("__h2"),
                           F.pmod(F.col("__cum__c") - F.col("__c"), F.lit(k)).cast("int").alias(name))
    joined = keyed.join(ranked, (F.col("__h") == F.col("__h2"))
                        & C.c(stratify).eqNullSafe(F.col("__y2")), "inner")
    return joined.select(*[C.c(n) for n in df.columns], F.col(name))


# ---------------------------------------------------------------- exact sizes

def _dealt(df: DataFrame, seed: int, groups: Sequence[str], shares: Sequence[tuple[object, object]], name: str) -> DataFrame:
    """Each row once, with column ``name``: its part by rank. Identical rows are counted first, their ranks follow
    from running counts in seeded hash order within ``groups``; ``shares`` gives each part's value and the number
    of its ranks below a bound, so a repeated row is dealt over the parts like different ones."""
    from tabforge.operators.balance import expand
    cols = df.columns
    counted = df.groupBy(*[C.c(n) for n in cols]).agg(F.count(F.lit(1)).alias("__c")).withColumn("__h", row_hash(df, seed))
    keys = [f"__g{i}" for i in range(len(groups))] or ["__g"]
    counted = counted.withColumns({k: C.c(g) for k, g in zip(keys, groups)} if groups else {"__g": F.lit(0)})
    ranked = prefix_sums(counted, keys, ["__h"], ["__c"], prefix="__cum")
    until, since = F.col("__cum__c"), F.col("__cum__c") - F.col("__c")
    parts = ranked.withColumn("__p", F.explode(F.array(*[
        F.struct(F.lit(v).alias("v"), (below(until) - below(since)).alias("n")) for v, below in shares])))
    parts = parts.withColumn(name, F.col("__p.v"))
    return expand(parts, F.col("__p.n"), [*cols, name])


def exact_split(df: DataFrame, test_size: float = DEFAULT_TEST_SIZE, seed: int = DEFAULT_SEED, name: str = "split",
                rows: int | None = None) -> DataFrame:
    """``split`` = 'train' | 'test' per row: ceil(n * test_size) test rows, also where rows repeat.

    The test rows are the first by seeded hash, told by one threshold that a histogram of the hashes finds: no row
    is shuffled but copies of the row at the threshold. :func:`mark_split` saves the histogram's two scans.
    ``rows`` is the number of rows, where it is known.
    """
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must be in (0, 1)")
    whole = SE.group_sizes(df, [], rows)
    n_test = math.ceil(Fraction(str(test_size)) * whole.sizes[0])
    out = SE.deal(df, row_hash(df, seed), whole, [[n_test]], "__part")
    return out.withColumn(name, F.when(F.col("__part") == 0, "test").otherwise("train")).drop("__part")


def exact_folds(df: DataFrame, k: int = DEFAULT_FOLDS, seed: int = DEFAULT_SEED,
                stratify: str | Sequence[str] | None = None, name: str = "fold") -> DataFrame:
    """``fold`` in [0, k) per row; within each stratum the folds' sizes differ by one at most, also where rows repeat.

    Folds are runs of ranks by seeded hash, told by k - 1 thresholds per stratum; no row is shuffled but copies of
    rows at a threshold. With more than ``selection.MAX_GROUPS`` strata all rows are ranked instead (shuffles of the
    table).
    """
    groups = [stratify] if isinstance(stratify, str) else list(stratify or [])
    try:
        strata = SE.group_sizes(df, groups)
    except SE.TooManyGroups:
        shares = [(j, lambda r, j=j: F.floor((r + (k - 1 - j)) / k).cast("long")) for j in range(k)]
        return _dealt(df, seed, groups, shares, name)
    return SE.deal(df, row_hash(df, seed), strata, [[(j * n + k - 1) // k for j in range(1, k)] for n in strata.sizes], name)
