"""Distributed ordered statistics: running sums, exact quantiles, top-k, dense rank.

A SQL window ``ORDER BY`` without ``PARTITION BY`` (or partitioned by a key
with only a handful of values, such as a column name) runs in a single task.
That is fine on a few hundred rows and fatal on a 100 TB table, so the
helpers here never do it on data-sized inputs:

* the input is first reduced to distinct keys with counts (map-side partial
  aggregation absorbs hot values: a value holding a third of all rows becomes
  one row per map task);
* for running sums over every key (:func:`prefix_sums`), the distinct keys
  are range-partitioned, every range partition computes a local running sum,
  and a table with one row per (range partition, group), bounded by the
  partition count, supplies the offsets of earlier partitions;
* for a few order statistics (:func:`exact_quantiles`) only the value
  interval around each wanted rank is ever sorted.

The range-partitioned table is written once with ``checkpoint()`` (to the
cluster's ``spark.checkpoint.dir``) and both branches read that copy. Range
bounds come from sampling, and column pruning can give the two branches
different exchanges, so without the stored partition id a row could be
placed by one sample and offset by another. The checkpoint also cuts the
lineage, so a lost executor does not re-run the sampling.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.session import ensure_checkpoint_dir

_PID = "__pid"
BROADCAST_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 64 << 20  # both bound the broadcast: offset tables of running sums beyond this are joined by a shuffle


def _cols(xs) -> list[str]:
    return [xs] if isinstance(xs, str) else list(xs or [])


def prefix_sums(df: DataFrame, group: Sequence[str] | str | None,
                order: Sequence[Column | str], values: Sequence[str],
                num_partitions: int | None = None,
                prefix: str = "cum_") -> DataFrame:
    """Inclusive running sums of ``values`` within ``group`` in ``order``.

    ``order`` must make rows unique within a group (callers aggregate to
    distinct keys first); ties would make the running sum order-dependent.
    Adds one column ``{prefix}{v}`` per value column.
    """
    group = _cols(group)
    order_exprs = [F.col(o) if isinstance(o, str) else o for o in order]
    keys = [*[F.col(g) for g in group], *order_exprs]
    # Without an explicit count AQE may coalesce neighbouring ranges to its
    # advisory partition size; coalesced ranges stay in key order, so the
    # partition id still orders the partitions.
    ranged = (df.repartitionByRange(num_partitions, *keys) if num_partitions
              else df.repartitionByRange(*keys)).withColumn(_PID, F.spark_partition_id())
    ranged = materialize(ranged)

    w_local = (Window.partitionBy(_PID, *group).orderBy(*order_exprs)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ranged.select("*", *[F.sum(v).over(w_local).alias(f"__lc_{v}") for v in values])

    # one row per (range partition, group): bounded by partitions + groups
    part = ranged.groupBy(_PID, *group).agg(*[F.sum(v).alias(f"__pt_{v}") for v in values])
    w_off = (Window.partitionBy(*group).orderBy(_PID)
             .rowsBetween(Window.unboundedPreceding, -1))
    offs = part.select(_PID, *group, *[
        F.coalesce(F.sum(f"__pt_{v}").over(w_off), F.lit(0)).alias(f"__off_{v}")
        for v in values])

    # offsets: one row per (range partition, group) -- partitions + groups rows.
    # Broadcast when that is small (columns, classes); otherwise a shuffle join.
    # A NULL group is a group too: match it null-safely.
    offs = offs.select(F.col(_PID).alias("__opid"), *[F.col(g).alias(f"__og{i}") for i, g in enumerate(group)],
                       *[f"__off_{v}" for v in values])
    cond = F.col(_PID) == F.col("__opid")
    for i, g in enumerate(group):
        cond = cond & F.col(g).eqNullSafe(F.col(f"__og{i}"))
    width = F.lit(8 * (1 + len(values)))
    for i in range(len(group)):
        width = width + 8 + F.coalesce(F.octet_length(F.col(f"__og{i}").cast("string")), F.lit(0))
    n_offs, size = offs.agg(F.count(F.lit(1)), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    small = n_offs <= BROADCAST_MAX_ROWS and size <= BROADCAST_MAX_BYTES
    out = local.join(F.broadcast(offs) if small else offs, cond)
    return out.select(*[F.col(x) for x in df.columns], *[
        (F.col(f"__lc_{v}") + F.col(f"__off_{v}")).alias(f"{prefix}{v}") for v in values])


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into ``spark.checkpoint.dir`` (never a local checkpoint)."""
    if ensure_checkpoint_dir(df.sparkSession) is None:
        raise RuntimeError("spark.checkpoint.dir is not set; ordered statistics need a shared "
                           "checkpoint folder on a cluster")
    return df.checkpoint(eager=True)


def _in_cell(v: Column, lo: float, hi: float) -> Column:
    return v.isNotNull() & (v >= F.lit(lo)) & (v <= F.lit(hi))


_LOG_SHIFT, _LOG_INF = 1100.0, 2200.0     # log2 of a finite double lies within +-1075


def _signed_log(v: float) -> float:
    if v == 0.0:
        return 0.0
    return math.copysign(_LOG_INF if math.isinf(v) else math.log2(abs(v)) + _LOG_SHIFT, v)


_DOUBLINGS = 40  # below the largest magnitude of a cell that its log places tell apart


def _place(lo: float, hi: float) -> tuple[int, float, float, float, float, float]:
    """How :func:`_share` places the values of a cell: (kind, start, width, unit, first log, width of the logs)."""
    if math.isinf(lo) or math.isinf(hi):
        a = _signed_log(lo)
        return _BY_INF, 0.0, 1.0, 1.0, a, _signed_log(hi) - a
    kind, start, width = (_BY_HALF, lo / 2, hi / 2 - lo / 2) if math.isinf(hi - lo) else (_BY_VALUE, lo, hi - lo)
    low, high = sorted((abs(lo), abs(hi)))
    unit = high * 2.0 ** -_DOUBLINGS
    if unit < 1e-290 or lo * hi > 0 and high <= 2 * low:
        return kind, start, width, 1.0, 0.0, 0.0

    def log(v: float) -> float:
        return math.copysign(math.log2(abs(v) / unit + 1.0), v)
    return kind, start, width, unit, log(lo), log(hi) - log(lo)


_BY_VALUE, _BY_HALF, _BY_INF = 0, 1, 2
_PLACE = ("kind", "start", "width", "unit", "log_start", "log_width")


def _share() -> Column:
    """Monotone place of v in its cell, about 0 to 1: half by value, so that even columns take one round, half by the
    log of the magnitude, so that heavy tails do. One expression for all cells, whose numbers are columns: as many
    expressions as cells would be too long a method to be compiled."""
    v, kind = F.col("v"), F.col("kind")
    size = F.when(F.abs(v) == F.lit(float("inf")), F.lit(_LOG_INF)).otherwise(F.log2(F.abs(v)) + F.lit(_LOG_SHIFT))
    far = (F.when(v == 0.0, F.lit(0.0)).otherwise(F.signum(v) * size) - F.col("log_start")) / F.col("log_width")
    value = (F.when(kind == _BY_HALF, v / 2).otherwise(v) - F.col("start")) / F.col("width")
    log = (F.signum(v) * F.log2(F.abs(v) / F.col("unit") + F.lit(1.0)) - F.col("log_start")) / F.col("log_width")
    return F.when(kind == _BY_INF, far).when(F.col("log_width") == 0.0, value).otherwise((value + log) / 2)


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    buckets: int = 1024, max_rows: int = 50_000,
                    stats: dict[str, tuple] | None = None) -> DataFrame:
    """Exact linearly-interpolated quantiles of several numeric columns.

    Same definition as ``percentile`` / ``quantile_cont``: position
    ``h = (n - 1) * p`` over the sorted non-missing values, result
    ``x[floor h] + (h - floor h) * (x[ceil h] - x[floor h])``.
    Returns ``(column, p, quantile)``; columns without values get no row.

    Selection by refinement, never a sort of a whole column. Every wanted
    rank sits in a closed value interval ("cell") ``[lo, hi]`` of actual
    values, with ``base`` values below it; at first the cell is the whole
    column. While a cell holds more than ``max_rows`` values, one scan counts
    its values in ``buckets`` sub-ranges (count, min, max per bucket) and the
    rank moves to the bucket that holds it. A value's place in its cell is the
    mean of its place by value and by ``log2`` of the magnitude (:func:`_share`),
    so even columns and heavy tails take a round each, infinities one more. It
    is monotone in ``v``: each bucket is a contiguous run of values and its
    exact min/max bound the next cell. The ends of a cell fall into different
    buckets, so every round narrows it and the search ends. Finally the values
    of each small cell are counted per distinct value and ranked by a window
    partitioned by cell. A hot value collapses into one
    (value, count) row, and a cell with a single value is resolved without a
    window. Only cell statistics (cells x buckets rows) reach the driver.

    ``stats`` (column -> (count, min, max) of the non-missing values, as
    doubles) skips the first scan when the caller has already aggregated them.
    """
    from tabforge.functions.cols import field, value_or_null
    if not columns:
        raise ValueError("no columns")
    names = list(columns)
    # NaN is missing; adding 0.0 folds -0.0 into 0.0
    val = {n: value_or_null(n, field(df, n).dataType).cast("double") + F.lit(0.0) for n in names}
    if stats is not None and all(n in stats for n in names):
        first = {}
        for i, n in enumerate(names):
            first[f"n{i}"], first[f"a{i}"], first[f"b{i}"] = stats[n]
    else:
        first = df.agg(*[F.count(val[n]).alias(f"n{i}") for i, n in enumerate(names)],
                       *[F.min(val[n]).alias(f"a{i}") for i, n in enumerate(names)],
                       *[F.max(val[n]).alias(f"b{i}") for i, n in enumerate(names)]).first().asDict()
    total = {n: first[f"n{i}"] for i, n in enumerate(names)}

    # wanted (column, rank) -> [lo, hi, base, rows, resolved value]
    want: dict[tuple[str, int], list] = {}
    for i, n in enumerate(names):
        if total[n]:
            lo, hi = first[f"a{i}"] + 0.0, first[f"b{i}"] + 0.0  # -0.0 -> 0.0, as the values
            for p in probs:
                h = (total[n] - 1) * float(p)
                for r in {math.floor(h), math.ceil(h)}:
                    want[(n, r)] = [lo, hi, 0, total[n], lo if lo == hi else None]

    while True:
        cells = sorted({(n, st[0], st[1]) for (n, _r), st in want.items()
                        if st[4] is None and st[3] > max_rows})
        if not cells:
            break
        long = df.select(F.inline(F.array(*[
            F.struct(F.lit(i).alias("cell"), F.when(_in_cell(val[n], lo, hi), val[n]).alias("v"),
                     *[F.lit(x).alias(k) for k, x in zip(_PLACE, _place(lo, hi))])
            for i, (n, lo, hi) in enumerate(cells)]))).where(F.col("v").isNotNull())
        long = long.select("cell", "v", F.least(F.floor(_share() * F.lit(buckets)), F.lit(buckets - 1)).alias("b"))
        stats = long.groupBy("cell", "b").agg(
            F.count(F.lit(1)).alias("k"), F.min("v").alias("mn"), F.max("v").alias("mx")).collect()
        per_cell: dict[int, list] = {}
        for r in stats:
            per_cell.setdefault(r["cell"], []).append((r["b"], r["k"], r["mn"], r["mx"]))
        for i, (n, lo, hi) in enumerate(cells):
            rows = sorted(per_cell.get(i, []))
            for (wn, rank), st in want.items():
                if (wn, st[0], st[1]) != (n, lo, hi) or st[4] is not None or st[3] <= max_rows:
                    continue
                before = st[2]
                for _b, k, mn, mx in rows:
                    if before + k > rank:
                        st[0], st[1], st[2], st[3] = mn, mx, before, k
                        if mn == mx:
                            st[4] = mn
                        break
                    before += k

    # final: rank inside each remaining cell
    cells = sorted({(n, st[0], st[1]) for (n, _r), st in want.items() if st[4] is None})
    if cells:
        cell_id = {cell: i for i, cell in enumerate(cells)}
        long = df.select(F.inline(F.array(*[
            F.struct(F.lit(i).alias("cell"), F.when(_in_cell(val[n], lo, hi), val[n]).alias("v"))
            for i, (n, lo, hi) in enumerate(cells)])))
        vc = long.where(F.col("v").isNotNull()).groupBy("cell", "v").agg(F.count(F.lit(1)).alias("k"))
        w = Window.partitionBy("cell").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = vc.withColumn("cum", F.sum("k").over(w))
        tgt = [(cell_id[(n, st[0], st[1])], rank - st[2], n, rank)
               for (n, rank), st in want.items() if st[4] is None]
        tdf = df.sparkSession.createDataFrame(tgt, "tcell int, trank long, tcol string, rank long")
        hit = ranked.join(F.broadcast(tdf), (F.col("cell") == F.col("tcell"))
                          & (F.col("trank") >= F.col("cum") - F.col("k")) & (F.col("trank") < F.col("cum")))
        for r in hit.select("tcol", "rank", "v").collect():  # one row per wanted rank
            want[(r["tcol"], r["rank"])][4] = r["v"]

    out = []
    for n in names:
        if not total[n]:
            continue
        for p in probs:
            h = (total[n] - 1) * float(p)
            x0, x1 = want[(n, math.floor(h))][4], want[(n, math.ceil(h))][4]
            q = x0 if x0 == x1 else x0 + (h - math.floor(h)) * (x1 - x0)
            out.append((n, float(p), q))
    return df.sparkSession.createDataFrame(out, "column string, p double, quantile double")


def approx_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                     accuracy: int = 10000) -> DataFrame:
    """Opt-in sketch variant (``percentile_approx``), one aggregate for all columns."""
    from tabforge.functions.cols import c
    arr = F.array(*[F.lit(float(p)) for p in probs])
    row = df.agg(*[F.percentile_approx(c(n).cast("double"), arr, accuracy).alias(f"q{i}")
                   for i, n in enumerate(columns)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("column"), F.col(f"q{i}").alias("qs"))
        for i, n in enumerate(columns)]))) \
        .select("column", F.posexplode("qs").alias("i", "quantile")) \
        .select("column", F.element_at(arr, F.col("i") + 1).alias("p"), "quantile")


def top_k_per_group(df: DataFrame, group: str, order: Sequence[Column], k: int) -> DataFrame:
    """Exact top-k rows per group; adds ``rank`` (1-based). ``order`` must be total.

    A single ``row_number`` window filtered to ``rank <= k``: Catalyst plans
    it with a partial ``WindowGroupLimit`` below the shuffle, so each map task
    forwards at most ``k`` rows per group and the final per-group window sees
    at most ``k`` x (map tasks) rows, even for a group with billions of rows.
    """
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dense_index(distinct: DataFrame, group: str | None, order: Sequence[Column | str],
                num_partitions: int | None = None, name: str = "index") -> DataFrame:
    """0-based dense rank of distinct keys within ``group`` (distributed)."""
    one = distinct.withColumn("__one", F.lit(1).cast("long"))
    ranked = prefix_sums(one, group, order, ["__one"], num_partitions, prefix="__cum")
    return ranked.withColumn(name, F.col("__cum__one") - 1).drop("__one", "__cum__one")
