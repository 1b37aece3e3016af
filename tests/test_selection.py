"""Exact shares by thresholds: sizes, order, repeated rows, plans without whole rows in a shuffle."""

import collections

import pytest
from pyspark.sql import functions as F

from tabforge.functions import selection as SE
from tabforge.operators import balance as BA
from tabforge.operators import split as SP

SF = "/root/testdata/sf0.001"


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange" in x and "Broadcast" not in x]


@pytest.mark.parametrize("cells", [1 << 18, 64, 256])
def test_thresholds_are_order_statistics(spark, monkeypatch, cells):
    monkeypatch.setattr(SE, "CELLS", cells)
    rows = [(g, (i * 2654435761) % 9973 - 5000 if g else 7) for g in (0, 1, None) for i in range(700)]
    df = spark.createDataFrame(rows, "g int, x long")
    groups = SE.group_sizes(df, ["g"])
    h = F.when(F.col("g") == 1, F.xxhash64("x")).otherwise(F.col("x"))
    ranks = [[1, 2, 350, 699, 700]] * 3
    hashes = collections.defaultdict(list)
    for r in df.select("g", h.alias("h")).collect():
        hashes[r.g].append(r.h)
    for g, found in enumerate(SE.thresholds(df, h, groups, ranks)):
        v = sorted(hashes[groups.rows[g][0]])
        for w in found:
            assert w.hash == v[w.rank - 1] and w.below == sum(x < w.hash for x in v) and w.upto == sum(x <= w.hash for x in v)


@pytest.mark.parametrize("copies", [1, 37])
def test_split_sizes_and_rows(spark, copies):
    rows = [(i, f"v{i % 5}", float("nan") if i % 3 == 0 else None if i % 3 == 1 else 1.5) for i in range(23) for _ in range(copies)]
    df = spark.createDataFrame(rows, "i int, s string, d double").repartition(5)
    for size, want in ((0.2, -(-len(rows) * 2 // 10)), (0.37, -(-len(rows) * 37 // 100)), (0.00001, 1), (0.99999, len(rows))):
        out = SP.exact_split(df, size)
        n = collections.Counter(r.split for r in out.collect())
        assert n["test"] == want and n["train"] == len(rows) - want
        assert out.drop("split").exceptAll(df).isEmpty() and df.exceptAll(out.drop("split")).isEmpty()
    assert SP.exact_split(df.limit(0)).count() == 0


def test_same_parts_for_any_partitioning(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet")
    a, b = (SP.exact_folds(x, 5, stratify="l_returnflag") for x in (df, df.repartition(7, "l_tax")))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_folds_of_repeated_rows(spark):
    rows = [("a", 1)] * 101 + [("b", i) for i in range(12)] + [(None, 2)] * 3 + [("c", 0)]
    df = spark.createDataFrame(rows, "y string, x int")
    out = SP.exact_folds(df, 5, stratify="y")
    n = collections.Counter((r.y, r.fold) for r in out.collect())
    for y, total in (("a", 101), ("b", 12), (None, 3), ("c", 1)):
        per = [n[y, f] for f in range(5)]
        assert sum(per) == total and max(per) - min(per) <= 1
    assert out.drop("fold").exceptAll(df).isEmpty() and out.count() == len(rows)


def test_many_strata_fall_back(spark, monkeypatch):
    monkeypatch.setattr(SE, "MAX_GROUPS", 10)
    df = spark.createDataFrame([(i % 50, i) for i in range(500)], "y int, x int")
    per = SP.exact_folds(df, 5, stratify="y").groupBy("y", "fold").count().collect()
    assert len(per) == 250 and {r["count"] for r in per} == {2}


def test_rows_stay_where_they_are(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet")
    for out in (SP.exact_split(df), SP.exact_folds(df, 5, stratify="l_returnflag"), BA.undersample(df, "l_returnflag"), BA.oversample(df, "l_returnflag")):
        assert _exchanges(out) == []


def test_balancing_of_one_hot_row(spark):
    rows = [("a", 1)] * 90 + [("a", i) for i in range(10)] + [("b", 5)] * 40 + [("c", i) for i in range(3)]
    df = spark.createDataFrame(rows, "y string, x int")
    under, over = BA.undersample(df, "y"), BA.oversample(df, "y")
    assert dict(under.groupBy("y").count().collect()) == {"a": 3, "b": 3, "c": 3} and under.exceptAll(df).isEmpty()
    assert dict(over.groupBy("y").count().collect()) == {"a": 100, "b": 100, "c": 100}
    assert df.exceptAll(over).isEmpty() and over.join(df.distinct(), ["y", "x"], "left_anti").isEmpty()
    spread = [r["count"] for r in over.where("y = 'c'").groupBy("x").count().collect()]
    assert sorted(spread) == [33, 33, 34]


def test_parts_are_told_in_generated_code(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_tax", "l_quantity", "l_extendedprice", "l_returnflag")
    out = SP.exact_folds(df, 5, stratify="l_returnflag")
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(SE, "PLAIN_CUTS", 0)  # more thresholds than that are counted by a lambda
    assert collections.Counter(out.collect()) == collections.Counter(SP.exact_folds(df, 5, stratify="l_returnflag").collect())


def test_groups_of_few_thresholds_beside_others(spark):
    # a class of one row has no threshold inside it, the others have one or four
    rows = [("a", 0)] + [("b", i) for i in range(3)] + [("c", i) for i in range(40)] + [(None, i) for i in range(11)]
    out = SP.exact_folds(spark.createDataFrame(rows, "y string, x int"), 5, stratify="y").collect()
    assert sorted((r.y or "", r.x) for r in out) == sorted((y or "", x) for y, x in rows)
    for y, n in (("a", 1), ("b", 3), ("c", 40), (None, 11)):
        sizes = collections.Counter(r.fold for r in out if r.y == y)
        assert sum(sizes.values()) == n and max(sizes.values()) == -(-n // 5) and min(sizes[k] for k in range(5)) == n // 5
