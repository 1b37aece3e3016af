"""Exact neighbours against all pairs; synthesis lies between a row and one of its nearest."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.operators import neighbours as NB
from tabforge.operators import smote as SM

SF = "/root/testdata/sf0.01"


def all_pairs(x: np.ndarray, k: int):
    """{point: [(d2, point, rows)]} of the k nearest distinct points, ties by coordinates."""
    points, n = np.unique(x, axis=0, return_counts=True)
    out = {}
    for p, c in zip(points, n):
        d2 = np.zeros(len(points))
        for j in range(x.shape[1]):
            d2 += (points[:, j] - p[j]) ** 2
        found = sorted((d, tuple(q), int(m) - (tuple(q) == tuple(p))) for d, q, m in zip(d2, points, n))
        out[tuple(p)] = [f for f in found if f[2]][:k]
    return out


def enough(near, k):
    """The first neighbours that hold k rows."""
    out, held = [], 0
    for f in near:
        if held >= k:
            break
        out.append(f)
        held += f[2]
    return out


@pytest.mark.parametrize("leaf", [512, 16])
@pytest.mark.parametrize("kind", ["spread", "dense", "grid", "copies", "line"])
def test_neighbours_are_those_of_all_pairs(spark, kind, leaf):
    rng = np.random.default_rng(5)
    x = {"spread": rng.normal(size=(900, 3)), "grid": rng.integers(0, 9, (900, 3)).astype(float),
         "dense": np.vstack([rng.normal(size=(600, 3)) * 1e-6, rng.normal(size=(300, 3)) * 100]),
         "copies": np.vstack([np.ones((400, 3)), rng.integers(0, 3, (200, 3)).astype(float)]),
         "line": np.column_stack([np.arange(700.0), np.zeros(700), np.zeros(700)])}[kind]
    df = spark.createDataFrame([(*map(float, r), 0) for r in x], "a double, b double, c double, g int")
    points = NB.points_of(df, ["a", "b", "c"], "g")
    got = {tuple(r.x): [(e.d2, tuple(e.x), e.n) for e in r.near] for r in NB.nearest(points, 5, 1, leaf).collect()}
    want = all_pairs(x, 5)
    assert got.keys() == want.keys()
    for p in want:
        assert enough(got[p], 5) == enough(want[p], 5)


def test_neighbours_of_a_table(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_returnflag = 'A'")
    names = ["l_quantity", "l_discount", "l_tax"]
    got = {tuple(r.x): [(e.d2, tuple(e.x), e.n) for e in r.near] for r in NB.nearest(NB.points_of(df, names), 5).collect()}
    want = all_pairs(np.array([list(r) for r in df.select(*names).collect()]), 5)
    assert got.keys() == want.keys() and all(enough(got[p], 5) == enough(want[p], 5) for p in want)


def test_leaves_are_small_in_a_dense_cluster(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(20_000, 2)) * 1e-9, rng.normal(size=(500, 2)) * 1e3])
    points = NB.points_of(spark.createDataFrame(x.tolist(), "a double, b double"), ["a", "b"])
    NB.python_workers(spark)
    tree = NB.grow_tree(points, 1, 128)
    sizes = [r["count"] for r in NB._located(points, tree).groupBy("node").count().collect()]
    assert sum(sizes) == len(x) and max(sizes) <= 128 and len(sizes) < 4 * len(x) / 128


def test_new_rows_lie_between_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [("big", *map(float, r)) for r in rng.normal(size=(400, 2))] + [("mid", *map(float, r)) for r in rng.integers(0, 6, (150, 2))] \
        + [("few", float(i), 0.0) for i in range(4)] + [("one", 3.5, 4.5)]
    df = spark.createDataFrame(rows, "y string, a double, b double").repartition(3)
    new = SM.synthetic(df, "y", ["a", "b"], 5, leaf=32).collect()
    assert collections.Counter(r.y for r in new) == {"mid": 250, "few": 396, "one": 399}
    by_class = {c: all_pairs(np.array([r[1:] for r in rows if r[0] == c]), 5) for c in ("mid", "few", "one")}
    used = collections.defaultdict(set)
    for r in new:
        near = by_class[r.y][tuple(r.base)]
        assert (tuple(r.neighbour) in [f[1] for f in enough(near, 5)]) if near else r.neighbour == r.base
        assert 0 <= r.gap < 1 and np.allclose(r.x, np.array(r.base) + r.gap * (np.array(r.neighbour) - r.base))
        used[r.y, tuple(r.base)].add(tuple(r.neighbour))
    assert all(len(used["few", (float(i), 0.0)]) == 3 for i in range(4))  # each of the others is drawn
    per = collections.Counter(tuple(r.base) for r in new if r.y == "few")
    assert set(per.values()) == {99}


def test_result_table(spark):
    df = spark.createDataFrame([(i, "a", 1.5 * i, None) for i in range(30)] + [(i, "b", 2.0 * i, "x") for i in range(7)],
                               "i int, y string, v double, note string")
    out = SM.smote(df, "y", ["i", "v"], mark="new")
    assert dict(out.groupBy("y").count().collect()) == {"a": 30, "b": 30}
    assert out.where("new").where("note is not null").isEmpty() and dict(out.dtypes)["i"] == "double"
    a = SM.smote(df.repartition(5), "y", ["i", "v"], mark="new")
    assert a.exceptAll(out).isEmpty() and out.exceptAll(a).isEmpty()
    with pytest.raises(ValueError, match="note"):
        SM.smote(df, "y")
    with pytest.raises(ValueError, match="finite"):
        SM.smote(df.withColumn("v", F.when(F.col("i") == 3, None).otherwise(F.col("v"))), "y", ["v"])
    with pytest.raises(ValueError, match="missing"):
        SM.smote(df.withColumn("y", F.when(F.col("i") == 3, None).otherwise(F.col("y"))), "y", ["v"])
    assert SM.smote(df.limit(0), "y", ["v"]).count() == 0
