import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st

from tabforge.functions import ordered
from tabforge.functions.ordered import exact_quantiles, prefix_sums, top_k_per_group, dense_index
from pyspark.sql import functions as F

values = st.lists(st.one_of(st.integers(-50, 50).map(float), st.floats(-1e6, 1e6, allow_nan=False)),
                  min_size=1, max_size=60)


@settings(max_examples=15, deadline=None)
@given(values)
def test_exact_quantiles_match_numpy(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = {r["p"]: r["quantile"] for r in exact_quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.75, 1.0], buckets=3, max_rows=5).collect()}
    for p, q in got.items():
        assert np.isclose(q, np.quantile(np.array(xs), p), rtol=1e-9, atol=1e-9)


def test_quantiles_skip_nulls_and_hot_value(spark):
    rows = [(None,)] * 5 + [(7.0,)] * 1000 + [(1.0,), (100.0,)]
    df = spark.createDataFrame(rows, "x double")
    got = {r["p"]: r["quantile"] for r in exact_quantiles(df, ["x"], [0.0, 0.5, 1.0]).collect()}
    assert got == {0.0: 1.0, 0.5: 7.0, 1.0: 100.0}


def test_prefix_sums_equal_cumsum(spark):
    pdf = pd.DataFrame({"g": ["a", "b"] * 50, "k": range(100), "v": np.arange(100) % 7})
    df = spark.createDataFrame(pdf)
    out = prefix_sums(df, "g", ["k"], ["v"], num_partitions=5).toPandas().sort_values(["g", "k"])
    exp = pdf.sort_values(["g", "k"]).groupby("g")["v"].cumsum()
    assert list(out["cum_v"]) == list(exp)


def test_prefix_sums_descending(spark):
    df = spark.createDataFrame([(i, 1) for i in range(20)], "k int, v int")
    out = {r["k"]: r["cum_v"] for r in prefix_sums(df, None, [F.col("k").desc()], ["v"], 4).collect()}
    assert out[19] == 1 and out[0] == 20


def test_top_k_per_group_is_exact(spark):
    pdf = pd.DataFrame({"g": ["x"] * 200 + ["y"] * 5, "v": list(range(200)) + list(range(5)),
                        "cnt": [i % 13 for i in range(200)] + [1] * 5})
    df = spark.createDataFrame(pdf)
    out = top_k_per_group(df.repartition(7), "g", [F.col("cnt").desc(), F.col("v")], 10).toPandas()
    exp = pdf.sort_values(["g", "cnt", "v"], ascending=[True, False, True]).groupby("g").head(10)
    assert sorted(zip(out["g"], out["v"])) == sorted(zip(exp["g"], exp["v"]))
    assert out.groupby("g")["rank"].max().to_dict() == {"x": 10, "y": 5}


def test_dense_index(spark):
    df = spark.createDataFrame([("c", "b"), ("c", "a"), ("c", "z"), ("d", "q")], "column string, value string")
    out = {(r["column"], r["value"]): r["index"] for r in dense_index(df, "column", ["value"], 3).collect()}
    assert out == {("c", "a"): 0, ("c", "b"): 1, ("c", "z"): 2, ("d", "q"): 0}


def test_quantile_refinement_with_hot_value(spark):
    rows = [(7.0,)] * 3000 + [(float(i),) for i in range(500)]
    df = spark.createDataFrame(rows, "x double")
    xs = np.array([r[0] for r in rows])
    ps = [0.01, 0.1, 0.5, 0.9, 0.999]
    got = {r["p"]: r["quantile"] for r in exact_quantiles(df, ["x"], ps, buckets=8, max_rows=50).collect()}
    for p in ps:
        assert np.isclose(got[p], np.quantile(xs, p))


def test_prefix_sums_many_groups_shuffle_path(spark, monkeypatch):
    import tabforge.functions.ordered as O
    monkeypatch.setattr(O, "BROADCAST_MAX_ROWS", 0)
    pdf = pd.DataFrame({"g": [i % 37 for i in range(2000)], "k": range(2000), "v": 1})
    out = O.prefix_sums(spark.createDataFrame(pdf), "g", ["k"], ["v"], num_partitions=9).toPandas()
    exp = pdf.sort_values(["g", "k"]).groupby("g")["v"].cumsum()
    assert list(out.sort_values(["g", "k"])["cum_v"]) == list(exp)


def test_quantiles_with_infinities(spark):
    xs = [float("-inf"), float("inf")] + [float(i) for i in range(100)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = {r["p"]: r["quantile"] for r in exact_quantiles(df, ["x"], [0.0, 0.5, 1.0], buckets=4, max_rows=10).collect()}
    assert got == {0.0: float("-inf"), 0.5: 49.5, 1.0: float("inf")}


def test_prefix_sums_default_partitioning(spark):
    pdf = pd.DataFrame({"g": [i % 3 for i in range(5000)], "k": range(5000), "v": [i % 11 for i in range(5000)]})
    out = prefix_sums(spark.createDataFrame(pdf).repartition(13), "g", ["k"], ["v"]).toPandas()
    exp = pdf.sort_values(["g", "k"]).groupby("g")["v"].cumsum()
    assert list(out.sort_values(["g", "k"])["cum_v"]) == list(exp)


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_running_sums_with_and_without_broadcast_offsets(spark, monkeypatch, most):
    monkeypatch.setattr(ordered, "BROADCAST_MAX_BYTES", most)
    rows = [(g, i, i % 7) for g in ("a" * 50, None, "é") for i in range(40)]
    df = spark.createDataFrame(rows, "g string, k int, n long")
    got = {(r["g"], r["k"]): r["cum_n"] for r in prefix_sums(df, "g", ["k"], ["n"], 5).collect()}
    assert got == {(g, k): sum(i % 7 for i in range(k + 1)) for g, k, _ in rows}
