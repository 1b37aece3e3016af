"""Exact shares of a table by selection: rows are kept where they are and compared with thresholds.

Dealing rows into parts of exact sizes (test rows, folds, the rows a class
keeps) needs no sort: rows are ordered by a seeded hash of their values, and a
part ends at the hash of one rank. :func:`thresholds` finds those hashes per
group by a radix histogram: every round counts the rows of the buckets that
hold a wanted rank by the next hash bits, until each such bucket is one hash
(two scans up to some hundred million rows; a round for a few bits more each).
The histogram has at most ``CELLS`` rows, whatever the table.

:func:`deal` then is a projection: a row's part follows from its hash and its
group's thresholds. Only where a threshold falls into repeated rows (one hash,
several rows) are those rows grouped, counted and dealt by number; nothing
else is shuffled and no table is stored. As everything depends on values alone,
the parts are the same for any partitioning and on retries.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.functions import cols as C

CELLS = 1 << 18        # rows of a histogram that the driver reads
MAX_GROUPS = 4096      # groups with thresholds of their own (a broadcast table of as many rows)
PLAIN_CUTS = 32        # thresholds of a group that a row is compared with one by one, in generated code
_H, _G, _P, _T, _S, _N = "__sel_h", "__sel_g", "__sel_part", "__sel_t", "__sel_split", "__sel_n"


class TooManyGroups(ValueError):
    """More groups than a broadcast table of thresholds is meant for."""


@dataclass
class Groups:
    """The groups of a table and their sizes; group 0 is the whole table if there are no columns to group by."""
    columns: list[str]
    rows: list[tuple]
    sizes: list[int]
    schema: T.StructType


def group_sizes(df: DataFrame, columns: Sequence[str], rows: int | None = None) -> Groups:
    columns = list(columns)
    if not columns:
        return Groups([], [()], [df.count() if rows is None else rows], T.StructType())
    found = df.groupBy(*[C.c(n) for n in columns]).agg(F.count(F.lit(1)).alias(_N)).limit(MAX_GROUPS + 1).collect()
    if len(found) > MAX_GROUPS:
        raise TooManyGroups(f"more than {MAX_GROUPS} groups by {columns}")
    found.sort(key=lambda r: str(tuple(r)[:-1]))
    return Groups(columns, [tuple(r)[:-1] for r in found], [r[-1] for r in found],
                  T.StructType([C.field(df, n) for n in columns]))


def _with_groups(df: DataFrame, groups: Groups, facts: Sequence[tuple[str, T.DataType, list]]) -> DataFrame:
    """``df`` with each row's group number and the facts (name, type, value per group) of its group."""
    facts = [(_G, T.IntegerType(), list(range(len(groups.sizes)))), *facts]
    if not groups.columns:
        def literal(x):
            return F.array(*[F.lit(y) for y in x]) if isinstance(x, list) else F.lit(x)
        return df.withColumns({n: literal(v[0]).cast(t) for n, t, v in facts})
    keys = [f"__sel_k{i}" for i in range(len(groups.columns))]
    schema = T.StructType([T.StructField(k, groups.schema[n].dataType) for k, n in zip(keys, groups.columns)])
    for n, t, _ in facts:
        schema = schema.add(n, t)
    rows = [(*k, *(v[i] for _, _, v in facts)) for i, k in enumerate(groups.rows)]
    table = df.sparkSession.createDataFrame(rows, schema)
    on = [C.c(n).eqNullSafe(F.col(k)) for k, n in zip(keys, groups.columns)]
    return df.join(F.broadcast(table), on, "inner").drop(*keys)


@dataclass
class _Wanted:
    group: int
    rank: int            # the threshold has at least this many rows up to it
    below: int = 0       # rows before the bucket
    prefix: int = 0
    hash: int | None = None
    upto: int = 0        # rows up to and with the threshold


def thresholds(df: DataFrame, h: Column, groups: Groups, ranks: Sequence[Sequence[int]]) -> list[list[_Wanted]]:
    """For each group the hash at each rank (1 to the group's size): the least with at least ``rank`` rows up to it."""
    wanted = [[_Wanted(g, r) for r in rs] for g, rs in enumerate(ranks)]
    open_ = [w for ws in wanted for w in ws]
    if not open_:
        return wanted
    rows = _with_groups(df.withColumn(_H, h), groups, []).select(_G, _H)
    room = max(4, min(12, (CELLS // max(1, len(groups.sizes))).bit_length() - 1))
    bits, left = 0, sum(groups.sizes)
    while open_:
        part = rows
        if bits:
            table = df.sparkSession.createDataFrame(sorted({(w.group, w.prefix) for w in open_}), f"{_G} int, {_P} long")
            part = rows.withColumn(_P, F.shiftright(_H, 64 - bits)).join(F.broadcast(table), [_G, _P], "left_semi")
            room = max(4, min(12, (CELLS // max(1, table.count())).bit_length() - 1))
        before = bits
        bits = 64 if left <= CELLS // 2 else min(64, bits + room)
        cells = part.groupBy(_G, F.shiftright(_H, 64 - bits).alias(_P) if bits < 64 else F.col(_H).alias(_P)).agg(
            F.count(F.lit(1)).alias("n"), F.min(_H).alias("lo"), F.max(_H).alias("hi")).orderBy(_G, _P).toArrow()
        g, p, n, lo, hi = (cells.column(c).to_numpy() for c in (_G, _P, "n", "lo", "hi"))
        parent = p >> (bits - before) if before else np.zeros(len(p), np.int64)
        seen = set()
        for w in open_:
            own = np.flatnonzero((g == w.group) & (parent == w.prefix)) if before else np.flatnonzero(g == w.group)
            upto = np.cumsum(n[own]) + w.below
            k = int(np.searchsorted(upto, w.rank))
            i = own[k]
            w.below, w.upto, w.prefix = int(upto[k] - n[i]), int(upto[k]), int(p[i])
            if lo[i] == hi[i]:
                w.hash = int(lo[i])
            else:
                seen.add(int(i))
        open_ = [w for w in open_ if w.hash is None]
        left = int(n[sorted(seen)].sum()) if seen else 0
    return wanted


def _passed(most: int) -> Column:
    """Number of the row's thresholds, at most ``most``, that are below its hash. A lambda over the array would keep
    Spark from generating code for every scan that asks for the part."""
    if most > PLAIN_CUTS:
        return F.size(F.filter(_T, lambda t: t < F.col(_H)))
    return sum((F.when(F.get(_T, F.lit(i)) < F.col(_H), 1).otherwise(0) for i in range(most)), F.lit(0))


def deal(df: DataFrame, h: Column, groups: Groups, cuts: Sequence[Sequence[int]], name: str,
         facts: Sequence[tuple[str, T.DataType, list]] = ()) -> DataFrame:
    """``df`` with ``name``, each row's part: rows of a group with a rank (by ``h``, from 0) below its first cut
    are part 0, below its second part 1, and so on. All groups have as many cuts, in rising order.

    ``facts`` are added as columns (name, type, one value per group). Rows that a cut divides (repeated rows, or
    different rows with one hash) are counted and dealt by number.
    """
    from tabforge.operators.balance import expand
    zero = [sum(c <= 0 for c in cs) for cs in cuts]  # every row is beyond these
    inner = [[c for c in cs if 0 < c < n] for cs, n in zip(cuts, groups.sizes)]
    found = thresholds(df, h, groups, inner)
    divided = [sorted({w.hash for w in ws if w.upto > w.rank}) for ws in found]
    facts = [("__sel_z", T.IntegerType(), zero), (_T, T.ArrayType(T.LongType()), [[w.hash for w in ws] for ws in found]), *facts]
    keep = [*df.columns, *(n for n, _, _ in facts[2:])]
    rows = _with_groups(df.withColumn(_H, h), groups, facts)
    part = F.col("__sel_z") + _passed(max((len(ws) for ws in found), default=0))
    if not any(divided):
        return rows.select(*[C.c(n) for n in keep], part.cast("int").alias(name))
    table = df.sparkSession.createDataFrame([(g, x) for g, xs in enumerate(divided) for x in xs], f"{_G} int, {_H} long")
    whole = rows.join(F.broadcast(table), [_G, _H], "left_anti").select(*[C.c(n) for n in keep], part.cast("int").alias(name))
    # where the divided hashes lie: the rows before them and the cuts of their group
    lies = {(w.group, w.hash): w.below for ws in found for w in ws if w.hash in divided[w.group]}
    plan = df.sparkSession.createDataFrame(
        [(g, x, b, [int(c) for c in cuts[g]]) for (g, x), b in sorted(lies.items())], f"{_G} int, {_H} long, __sel_b long, __sel_c array<long>")
    some = rows.join(F.broadcast(table), [_G, _H], "left_semi")
    cols = [n for n in keep]
    each = some.groupBy(*[C.c(n) for n in cols], _G, _H).agg(F.count(F.lit(1)).alias(_N)).join(F.broadcast(plan), [_G, _H])
    # rows of one hash: nearly always one row's copies
    tie = Window.partitionBy(_G, _H).orderBy(*[C.c(n) for n in df.columns]).rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("__sel_b", F.col("__sel_b") + F.coalesce(F.sum(_N).over(tie), F.lit(0)))
    upto = F.col("__sel_b") + F.col(_N)

    def up_to(c):
        return F.least(F.greatest(c, F.col("__sel_b")), upto)
    bounds = F.concat(F.array(F.lit(0).cast("long")), F.col("__sel_c"), F.array(F.lit((1 << 63) - 1)))
    shares = F.transform(F.sequence(F.lit(0), F.size("__sel_c")), lambda i: F.struct(
        i.cast("int").alias("part"), (up_to(F.element_at(bounds, i + 2)) - up_to(F.element_at(bounds, i + 1))).alias("n")))
    each = each.withColumn("__sel_x", F.explode(shares)).withColumns({name: F.col("__sel_x.part"), "__h": F.col(_H)})
    return whole.unionByName(expand(each, F.col("__sel_x.n"), [*cols, name]))
