"""Exact k nearest neighbours of all points, group by group, without comparing all pairs.

Equal points are one point with a count. A k-d tree over the points is grown in
rounds: every leaf with more than ``LEAF`` points is split by medians of a hash
sample of it (at most about ``SAMPLE`` points, in the leaf's own task), so leaves
stay small however dense a region is; only the splitting planes reach the driver
(``MAX_LEAVES`` of them, 16 bytes each; beyond that leaves grow with the table).
A leaf's points are one packed row.

Each leaf first compares its own points: the distance of a point's k-th
neighbour there bounds its search. The point then asks every leaf whose cell is
not farther than that, in rows of points from one leaf to another; a leaf that
many ask is repeated so that each copy answers ``SHARE`` rows at most. Whatever
is nearer than the k-th distance lies in a leaf that is asked, so the result is
that of all pairs. Points at equal distance are ordered by their coordinates.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.functions import cols as C
from tabforge.functions.ordered import materialize
from tabforge.session import python_workers

LEAF, SAMPLE, MAX_LEAVES, SHARE = 512, 2048, 1 << 20, 64
_SLACK = 1 + 1e-9  # sums of squares in another order


@dataclass
class Tree:
    """Splitting planes; a node without one (dim -1) is a leaf. Rows with x[dim] <= at go left."""
    dim: np.ndarray
    at: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @classmethod
    def of_roots(cls, n: int) -> Tree:
        none = np.full(n, -1, np.int32)
        return cls(none.copy(), np.zeros(n), none.copy(), none.copy())

    def leaf_of(self, node: np.ndarray, x: np.ndarray) -> np.ndarray:
        node = node.copy()
        inner = np.flatnonzero(self.dim[node] >= 0)
        while len(inner):
            at = node[inner]
            right = x[inner, self.dim[at]] > self.at[at]
            node[inner] = np.where(right, self.right[at], self.left[at])
            inner = inner[self.dim[node[inner]] >= 0]
        return node

    def grow(self, node: int, dims: Sequence[int], ats: Sequence[float]) -> None:
        """Hang a subtree, given in preorder (dim -1: leaf), at a leaf."""
        base = len(self.dim)
        new = Tree.of_roots(len(dims) - 1)  # its root is the leaf itself
        for a in ("dim", "at", "left", "right"):
            setattr(self, a, np.concatenate([getattr(self, a), getattr(new, a)]))
        open_: list[int] = []
        for i, (d, t) in enumerate(zip(dims, ats)):
            me = node if i == 0 else base + i - 1
            if i:
                up = open_[-1]
                if self.left[up] < 0:
                    self.left[up] = me
                else:
                    self.right[up] = me
                    open_.pop()
            self.dim[me], self.at[me] = d, t
            if d >= 0:
                open_.append(me)

    def near(self, root: int, x: np.ndarray, bound: np.ndarray):
        """(leaf, rows of x) for each leaf with rows whose squared distance to its cell is within their bound."""
        stack = [(root, np.arange(len(x)), np.zeros_like(x))]
        while stack:
            node, rows, off = stack.pop()
            d = self.dim[node]
            if d < 0:
                yield node, rows
                continue
            gap = x[rows, d] - self.at[node]
            for child, beyond in ((self.left[node], gap > 0), (self.right[node], gap <= 0)):
                more = off.copy()
                more[beyond, d] = np.maximum(more[beyond, d], gap[beyond] ** 2)
                keep = more.sum(axis=1) <= bound[rows] * _SLACK
                if keep.any():
                    stack.append((child, rows[keep], more[keep]))


def split_plan(x: np.ndarray, size: int, leaf: int) -> tuple[list[int], list[float]]:
    """Planes in preorder that cut ``size`` points, known by the sample x, into leaves of about half of ``leaf``."""
    dims, ats = [], []

    def cut(part: np.ndarray, n: float):
        spread = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(1)
        d = int(spread.argmax())
        if n <= leaf * 0.6 or len(part) < 2 or not spread[d] > 0:
            dims.append(-1)
            ats.append(0.0)
            return
        v = np.sort(part[:, d])
        t = v[(len(v) - 1) // 2]
        if t == v[-1]:  # half of them or more lie at the end
            t = v[np.searchsorted(v, t) - 1]
        left = part[:, d] <= t
        dims.append(d)
        ats.append(float(t))
        cut(part[left], n * left.mean())
        cut(part[~left], n * (1 - left.mean()))

    cut(x, size)
    return dims, ats


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, always added up in the order of the dimensions."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j, None] - b[None, :, j]
        out += gap * gap
    return out


def _matrix(col) -> np.ndarray:
    """A list<double> column as a matrix."""
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def points_of(df: DataFrame, features: Sequence[str], group: str | None = None) -> DataFrame:
    """(g, x, n): distinct points (features as doubles) per value of the int column ``group``, with their rows.

    A missing or infinite feature is an error.
    """
    x = F.array(*[C.c(f).cast("double") + F.lit(0.0) for f in features])
    bad = df.where(F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    if not bad.isEmpty():
        raise ValueError(f"distances need finite values in {list(features)}; impute or drop the others first")
    g = C.c(group).cast("int") if group else F.lit(0)
    return df.select(g.alias("g"), x.alias("x")).groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))


def _located(points: DataFrame, tree: Tree) -> DataFrame:
    shared = points.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        for b in batches:
            if b.num_rows:
                node = shared.value.leaf_of(b.column("g").to_numpy().astype(np.int32), _matrix(b.column("x")))
                yield pa.RecordBatch.from_arrays([b.column("g"), b.column("x"), b.column("n"), pa.array(node, pa.int32())],
                                                 names=["g", "x", "n", "node"])

    return points.select("g", "x", "n").mapInArrow(run, "g int, x array<double>, n long, node int")


def grow_tree(points: DataFrame, groups: int, leaf: int = LEAF) -> Tree:
    """A tree with a root per group and at most ``leaf`` points in each of its leaves."""
    tree, seed = Tree.of_roots(groups), 0
    while True:
        located = _located(points, tree)
        big = located.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > leaf)
        sizes = {r["node"]: r["size"] for r in big.collect()}
        if not sizes:
            return tree
        if len(tree.dim) > 2 * MAX_LEAVES:
            leaf *= 2
            continue
        seed += 1
        table = points.sparkSession.createDataFrame(sorted(sizes.items()), "node int, size long")
        draw = F.pmod(F.xxhash64(F.lit(seed), "x"), F.lit(1 << 30)) < F.least(F.lit(1.0), SAMPLE / F.col("size")) * (1 << 30)
        some = located.join(F.broadcast(table), "node").where(draw).select("node", "size", "x")

        most = leaf

        def plan(part: pd.DataFrame) -> pd.DataFrame:
            dims, ats = split_plan(np.stack(part.x.to_numpy()), int(part["size"].iloc[0]), most)
            return pd.DataFrame({"node": part.node.iloc[:1], "dims": [dims], "ats": [ats]})

        for r in some.groupBy("node").applyInPandas(plan, "node int, dims array<int>, ats array<double>").collect():
            if len(r["dims"]) > 1:
                tree.grow(r["node"], r["dims"], r["ats"])


def nearest(points: DataFrame, k: int, groups: int = 1, leaf: int = LEAF) -> DataFrame:
    """(g, x, near) for each point (g, x, n) of :func:`points_of`: ``near`` holds the nearest other points of its
    group in order, (d2, x, n) with squared distance and rows, at least ``k`` rows in all or all that there are; a
    repeated point's other copies are its first neighbour. ``g`` is below ``groups``."""
    python_workers(points.sparkSession)
    points = materialize(points)
    tree = grow_tree(points, groups, leaf)
    shared = points.sparkSession.sparkContext.broadcast(tree)

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(part.x.to_numpy())
        order = np.lexsort(x.T[::-1])  # ties go to the smaller coordinates
        return pd.DataFrame({"node": part.node.iloc[:1], "g": part.g.iloc[:1], "dims": [x.shape[1]], "xs": [x[order].tobytes()],
                             "ns": [part.n.to_numpy(np.int64)[order].tobytes()]})

    def unpacked(row, x="xs"):
        return np.frombuffer(row[x]).reshape(-1, row["dims"]), np.frombuffer(row["ns"], np.int64)

    def ask(batches):
        """From each leaf, its points to the leaves (its own too) that may hold one of their k nearest."""
        for b in batches:
            for row in b.to_pylist():
                x, n = unpacked(row)
                d2 = squared(x, x)
                order = np.argsort(d2, axis=1, kind="stable")
                # rows up to each neighbour; a point's own row isn't one
                held = np.cumsum(n[order] - (order == np.arange(len(x))[:, None]), axis=1)
                enough = held >= k
                at = enough.argmax(axis=1)
                bound = np.where(enough.any(axis=1), d2[np.arange(len(x)), order[np.arange(len(x)), at]], np.inf)
                out = [(int(leaf_), row["node"], row["g"], row["dims"], x[rows].tobytes(), bound[rows].tobytes())
                       for leaf_, rows in shared.value.near(row["g"], x, bound)]
                for i in range(0, len(out), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i:i + 64]), types)], names=names)

    names = ["node", "source", "g", "dims", "qs", "bounds"]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def answer(batches):
        for b in batches:
            for row in b.to_pylist():
                x, n = unpacked(row)
                q, bound = np.frombuffer(row["qs"]).reshape(-1, row["dims"]), np.frombuffer(row["bounds"])
                d2 = squared(q, x)
                rows, near = [], []
                order = np.argsort(d2, axis=1, kind="stable")[:, :k + 1]  # one of them may be the point itself
                for i in range(len(q)):
                    found = []
                    for j in order[i]:
                        if d2[i, j] > bound[i]:
                            break
                        others = int(n[j]) - int((q[i] == x[j]).all())
                        if others:
                            found.append({"d2": float(d2[i, j]), "x": x[j].tolist(), "n": others})
                    if found:
                        rows.append(q[i].tolist())
                        near.append(found)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([row["g"]] * len(rows), pa.int32()), pa.array(rows, pa.list_(pa.float64())),
                                                      pa.array(near, pa.list_(found_type))], names=["g", "x", "near"])

    found_type = pa.struct([("d2", pa.float64()), ("x", pa.list_(pa.float64())), ("n", pa.int64())])
    leaves = materialize(_located(points, tree).groupBy("node").applyInPandas(pack, "node int, g int, dims int, xs binary, ns binary"))
    asked = materialize(leaves.mapInArrow(ask, "node int, source int, g int, dims int, qs binary, bounds binary"))
    shares = asked.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("copies"))
    copies = leaves.join(shares, "node").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select("node", "copy", "xs", "ns")
    dealt = asked.join(shares, "node").withColumn("copy", F.pmod(F.xxhash64("source"), F.col("copies")).cast("int"))
    found = dealt.join(copies, ["node", "copy"]).select("g", "dims", "qs", "bounds", "xs", "ns").mapInArrow(
        answer, "g int, x array<double>, near array<struct<d2:double,x:array<double>,n:long>>")
    merged = found.groupBy("g", "x").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    empty = F.array().cast("array<struct<d2:double,x:array<double>,n:long>>")
    return points.select("g", "x").join(merged, ["g", "x"], "left").withColumn("near", F.coalesce("near", empty))
