"""Embedding whitening by a covariance that knows how often each vector occurs.

``encode`` turns a vector into integers floor(scale * c) and packs them into a
short key (the smallest of 1, 2, 4 or 8 bytes an entry that holds the vector),
so that only keys are shuffled. A constant added to all entries would change
nothing that is returned and is left out. ``distinct`` counts equal keys
with partial sums. The fit weighs each distinct vector by its count or by one:
sums per dimension are exact (128-bit decimals), the covariance is a weighted
centred matrix product per task, added up by Spark per cell. The driver holds
one dims x dims matrix (``MAX_DIMS`` at most, else an error) and takes its
eigenvectors. Each distinct vector is whitened once, in a stored table that is
joined back to the rows; a vector with at least 1/``HOT`` of all rows is joined
from a broadcast of at most ``HOT`` vectors, so no task gets all its rows.

Defined results: rows whose vector is NULL, or has a NULL, NaN or infinite
entry, are dropped; rows that repeat are each returned; vectors of different
lengths are whitened apart, each length by its own fit; entries beyond the
range of a long are held near its end; components without variance (below dims *
2**-52 of the largest) don't exist, so equal vectors alone give no rows, as do
empty vectors and an empty table; a deviation beyond a long is NULL. Other
columns are ignored.
"""

from __future__ import annotations

import decimal
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.llm.common import cut, documents, mapped, ready

COMPONENTS, SCALE = 16, 64
MAX_DIMS, HOT = 4096, 1024
WIDTHS = (1, 2, 4, 8)
_TOP = 2.0 ** 63


def encode(df: DataFrame, vector: str, carry: Sequence[str], scale: int = SCALE) -> DataFrame:
    """``carry`` columns and ``_k``, the key of each usable vector's floor(scale * c)."""

    def keys(col: pa.ChunkedArray | pa.ListArray):
        """Row numbers and keys of the usable vectors."""
        valid = np.asarray(col.is_valid())
        flat = col.flatten()  # entries of valid rows
        size = np.asarray(col.value_lengths().fill_null(0)).astype(np.int64)
        ok = np.asarray(flat.is_valid())
        c = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
        ok &= np.isfinite(c)
        with np.errstate(over="ignore", invalid="ignore"):
            y = np.clip(np.where(ok, np.floor(c * scale), 0), -_TOP, _TOP - 1024).astype(np.int64)
        ends = np.cumsum(size)
        bad = np.concatenate([[0], np.cumsum(~ok)])
        rows = np.flatnonzero(valid & (size > 0) & (bad[ends] == bad[ends - size]))
        out = []
        for i in rows:
            v = y[ends[i] - size[i]:ends[i]]
            low, high = int(v.min()), int(v.max())
            w = next(w for w in WIDTHS if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
            out.append(bytes([w]) + v.astype(f"<i{w}").tobytes())
        return rows, out

    def run(batches):
        for b in batches:
            rows, found = keys(b.column(b.num_columns - 1))
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([*(b.column(j).take(at) for j in range(len(carry))), pa.array(found, pa.binary())],
                                             names=[*(f"_c{j}" for j in range(len(carry))), "_k"])

    rows = df.select(*(F.col(f"`{c}`").alias(f"_c{j}") for j, c in enumerate(carry)), F.col(f"`{vector}`").alias("_v"))
    return mapped(rows, run, T.StructType(rows.schema.fields[:-1]).add("_k", "binary"))


def _vectors(keys: pa.Array):
    """(positions, matrix of longs) of each length and width among keys."""
    raw = keys.to_pylist()
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, k in enumerate(raw):
        kinds.setdefault((k[0], len(k)), []).append(i)
    for (w, _), at in kinds.items():
        yield np.array(at), np.frombuffer(b"".join(raw[i][1:] for i in at), f"<i{w}").reshape(len(at), -1).astype(np.int64)


def _total(values: np.ndarray, weights: np.ndarray) -> list[int]:
    """Exact weighted sums of the columns of a matrix of longs."""
    if np.abs(values.astype(np.float64)).max() * float(weights.sum()) < 2.0 ** 62:
        return [int(x) for x in weights @ values]
    return [sum(int(w) * int(x) for w, x in zip(weights, col)) for col in values.T]


def sums(distinct: DataFrame, by_count: bool) -> dict[int, tuple[int, list[int]]]:
    """Per length: the total weight and the exact weighted sum of each dimension."""

    def run(batches):
        acc: dict[int, list[int]] = {}
        for b in batches:
            n = b.column("_n").to_numpy()
            for at, v in _vectors(b.column("_k")):
                w = n[at] if by_count else np.ones(len(at), np.int64)
                new = [*_total(v, w), int(w.sum())]
                acc[v.shape[1]] = [a + x for a, x in zip(acc.get(v.shape[1], [0] * len(new)), new)]
        for dims, s in acc.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([dims] * len(s), pa.int32()), pa.array(np.arange(len(s)), pa.int32()),
                pa.array([decimal.Decimal(x) for x in s], pa.decimal128(38, 0))], names=["dims", "j", "s"])

    rows = mapped(distinct, run, "dims int, j int, s decimal(38,0)").groupBy("dims", "j").agg(F.sum("s").alias("s")).collect()
    found: dict[int, dict[int, int]] = {}
    for r in rows:  # dims + 1 rows a length
        found.setdefault(r.dims, {})[r.j] = int(r.s)
    if found and max(found) > MAX_DIMS:
        raise ValueError(f"vectors of {max(found)} entries; {MAX_DIMS} at most")
    return {d: (x[d], [x[j] for j in range(d)]) for d, x in found.items()}


def _centred(v: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """v - s / n: the whole part of the mean leaves as integers, so nothing is lost to the size of v."""
    whole = np.array([x // n for x in s], dtype=np.int64)
    if max(int(np.abs(v.astype(np.float64)).max(initial=0)), int(np.abs(whole.astype(np.float64)).max())) >= 1 << 62:
        return v.astype(np.float64) - whole
    return (v - whole).astype(np.float64) - np.array([x % n for x in s], dtype=np.float64) / n


def _products(rows: DataFrame, run, n: dict[int, int]) -> dict[int, np.ndarray]:
    """Sums of the (dims, i, j, v) partial products that ``run`` gives, over n, as symmetric matrices."""
    cells = mapped(rows, run, "dims int, i int, j int, v double").groupBy("dims", "i", "j").agg(F.sum("v").alias("v")).toArrow()
    dims, i, j, v = (cells.column(c).to_numpy() for c in ("dims", "i", "j", "v"))
    out = {}
    for d in np.unique(dims):
        own = dims == d
        m = np.zeros((j[own].max() + 1,) * 2)
        m[i[own], j[own]] = m[j[own], i[own]] = v[own] / n[int(d)]
        out[int(d)] = m
    return out


def _cells(acc: dict[int, np.ndarray]):
    for d, m in acc.items():
        i, j = np.triu_indices(len(m))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d), pa.int32()), pa.array(i, pa.int32()),
                                          pa.array(j, pa.int32()), pa.array(m[i, j])], names=["dims", "i", "j", "v"])


def fit(distinct: DataFrame, by_count: bool, components: int = COMPONENTS) -> dict[int, dict]:
    """Per length: n, sums, eigenvalues, whitening matrix (dims x components) and explained shares."""
    totals = sums(distinct, by_count)
    shared = distinct.sparkSession.sparkContext.broadcast(totals)

    def run(batches):
        acc: dict[int, np.ndarray] = {}
        for b in batches:
            n = b.column("_n").to_numpy()
            for at, v in _vectors(b.column("_k")):
                c = _centred(v, *shared.value[v.shape[1]])
                acc[v.shape[1]] = acc.get(v.shape[1], 0) + (c.T * n[at] if by_count else c.T) @ c
        yield from _cells(acc)

    out = {}
    for d, cov in _products(distinct, run, {d: n for d, (n, _) in totals.items()}).items():
        e, u = np.linalg.eigh(cov)
        e, u = e[::-1], u[:, ::-1]
        k = int((e[:components] > max(e[0], 0.0) * d * 2.0 ** -52).sum()) if e[0] > 0 else 0
        out[d] = {"n": totals[d][0], "s": totals[d][1], "e": e[:k], "w": u[:, :k] / np.sqrt(e[:k]),
                  "explained": e[:k] / e.clip(0).sum()}
    return out


def whitened(distinct: DataFrame, model: dict[int, dict]) -> DataFrame:
    """(_k, _n, dims, w: coordinates, deviation: exact sum of (n * x - S)^2) of each distinct vector."""
    shared = distinct.sparkSession.sparkContext.broadcast(model)

    def deviations(v: np.ndarray, n: int, s: list[int]) -> list[int]:
        """The integers may be far above a double's: summed in longs where they fit, as Python integers else."""
        spread = [max(abs(n * int(hi) - t), abs(n * int(lo) - t)) for hi, lo, t in zip(v.max(axis=0), v.min(axis=0), s)]
        exact = max(n * int(np.abs(v.astype(object)).max()), max(map(abs, s)), sum(x * x for x in spread)) < 2 ** 62
        d = v * n - np.array(s) if exact else v.astype(object) * n - np.array(s, dtype=object)
        return [int(x) for x in (d * d).sum(axis=1)]

    def run(batches):
        for b in batches:
            for at, v in _vectors(b.column("_k")):
                m = shared.value[v.shape[1]]
                w = _centred(v, m["n"], m["s"]) @ m["w"]
                far = [x if x < 2 ** 63 else None for x in deviations(v, m["n"], m["s"])]
                offs = np.arange(len(at) + 1, dtype=np.int32) * w.shape[1]
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([
                    b.column("_k").take(rows), b.column("_n").take(rows), pa.array(np.full(len(at), v.shape[1]), pa.int32()),
                    pa.ListArray.from_arrays(offs, w.ravel()), pa.array(far, pa.int64())],
                    names=["_k", "_n", "dims", "w", "deviation"])

    return mapped(distinct, run, "_k binary, _n long, dims int, w array<double>, deviation long")


def identity_errors(white: DataFrame, model: dict[int, dict], by_count: bool) -> dict[int, float]:
    """Largest difference between the covariance of the whitened vectors (as stored) and the identity."""

    def run(batches):
        acc: dict[int, np.ndarray] = {}
        for b in batches:
            n, dims = b.column("_n").to_numpy(), b.column("dims").to_numpy()
            size = np.asarray(b.column("w").value_lengths())
            ends, flat = np.cumsum(size), b.column("w").flatten().to_numpy()
            for d in np.unique(dims[size > 0]):
                own = np.flatnonzero(dims == d)
                k = size[own[0]]
                w = flat[(ends[own] - k)[:, None] + np.arange(k)]
                w = np.hstack([w, np.ones((len(w), 1))])  # the last row and column are the sums
                acc[int(d)] = acc.get(int(d), 0) + (w.T * n[own] if by_count else w.T) @ w
        yield from _cells(acc)

    out = {}
    for d, m in _products(white, run, {d: x["n"] for d, x in model.items()}).items():
        mean = m[:-1, -1]
        out[d] = float(np.abs(m[:-1, :-1] - np.outer(mean, mean) - np.eye(len(mean))).max())
    return out


def whiten(df: DataFrame, vector: str = "embedding", carry: Sequence[str] = ("vec_id",), by_count: bool = False,
           components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``carry`` columns, component (from 1), n, deviation, whitened, explained and identity_error of each usable row.

    ``by_count`` weighs distinct vectors by their rows (n is then the number of rows), else each counts once.
    """
    rows = encode(df, vector, carry, scale)
    distinct = cut(rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")))
    model = fit(distinct, by_count, components)
    white = cut(whitened(distinct, model))
    errors = identity_errors(white, model, by_count)
    spark = df.sparkSession
    facts = spark.createDataFrame(
        [(d, j + 1, m["n"], float(x), errors[d]) for d, m in model.items() for j, x in enumerate(m["explained"])],
        "dims int, component int, n long, explained double, identity_error double")
    total = distinct.agg(F.sum("_n")).first()[0] or 0
    hot = F.col("_n") > max(total // HOT, HOT)  # fewer than HOT vectors
    few, rest = (ready(white).where(x).select("_k", "dims", "w", "deviation") for x in (hot, ~hot))
    marked = rows.join(F.broadcast(few), "_k", "left")
    found = marked.where("dims is not null").unionByName(
        marked.where("dims is null").drop("dims", "w", "deviation").join(rest, "_k"))
    each = found.select(*(f"_c{j}" for j in range(len(carry))), "dims", "deviation", F.posexplode("w").alias("_p", "whitened"))
    out = each.join(F.broadcast(facts.withColumnRenamed("dims", "_d")),
                    (F.col("dims") == F.col("_d")) & (F.col("_p") + 1 == F.col("component")))
    return out.select(*(F.col(f"_c{j}").alias(c) for j, c in enumerate(carry)),
                      "component", "n", "deviation", "whitened", "explained", "identity_error")


def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted on distinct vectors, each counted once."""
    return whiten(documents(spark, sf, "embeddings"))


QUERIES = {"op11_whitening": op11_whitening}
SQL: dict[str, str] = {}
