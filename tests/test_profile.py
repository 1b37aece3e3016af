import math

import pandas as pd
import pytest

from tabforge.functions.cols import normalize_missing
from tabforge.operators import profile as P


@pytest.fixture()
def frame(spark):
    rows = [(1.0, "a", 1), (float("nan"), "b", 1), (None, None, 2), (3.0, "a", None), (3.0, "b", 2)]
    return normalize_missing(spark.createDataFrame(rows, "x double, y string, z int"))


def test_nan_becomes_null(frame):
    m = {r["column"]: r["missing"] for r in P.missing_counts(frame).collect()}
    assert m == {"x": 2, "y": 1, "z": 1}


def test_unique_and_mode_ties(frame):
    u = {r["column"]: r["unique"] for r in P.unique_counts(frame).collect()}
    assert u == {"x": 2, "y": 2, "z": 2}
    cs = P.categorical_summary(frame).collect()[0]
    assert (cs["top"], cs["freq"], cs["count"]) == ("a", 2, 4)  # tie a/b -> smallest


def test_numeric_summary_matches_pandas(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, 2.0, 10.0, None], "b": [5, 5, 5, 5, 5]})
    df = spark.createDataFrame(pdf.astype({"a": "float64"})).selectExpr("a", "cast(b as int) as b")
    df = normalize_missing(df)
    got = {r["column"]: r for r in P.numeric_summary(df).collect()}
    d = pdf.describe()
    for c in ["a", "b"]:
        for k, name in [("count", "count"), ("mean", "mean"), ("min", "min"), ("p25", "25%"),
                        ("p50", "50%"), ("p75", "75%"), ("max", "max")]:
            assert math.isclose(got[c][k], d.loc[name, c], rel_tol=1e-12)
    assert math.isclose(got["a"]["std"], d.loc["std", "a"], rel_tol=1e-12)
    assert got["b"]["std"] == 0.0


def test_duplicate_count_and_readiness(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (3, "c")], "k int, v string")
    d = P.duplicate_count(df).first()
    assert (d["n_rows"], d["n_distinct"], d["duplicates"]) == (5, 3, 2)
    r = P.readiness(df).first()
    assert (r["missing_total"], r["duplicates"], r["status"]) == (2, 2, "Required")


def test_empty_frame(spark):
    df = spark.createDataFrame([], "x double, y string")
    assert P.shape(df).first()["n_rows"] == 0
    assert {r["column"]: r["unique"] for r in P.unique_counts(df).collect()} == {"x": 0, "y": 0}
    assert P.duplicate_count(df).first()["duplicates"] == 0


def test_scalable_rule(spark):
    rows = [(i, i % 2, 7.0, float(i % 10), float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "width long, b int, k double, v double, u double")
    got = {r["column"]: r["reason"] for r in P.scalable_columns(df).collect()}
    assert got == {"width": "id-like name", "b": "binary 0/1", "k": "two or fewer values",
                   "v": "ok", "u": "unique per row"}
    word = {r["column"]: r["scalable"] for r in P.scalable_columns(df, match="word").collect()}
    assert word["width"] is False  # unique per row still excludes it


def test_value_counts_rules(spark):
    rows = [(i % 25, f"s{i % 3}") for i in range(100)]
    df = spark.createDataFrame(rows, "n int, s string")
    vc = P.value_counts_top(df).toPandas()
    assert set(vc["column"]) == {"s"}  # n has 25 distinct values > 20
    assert list(vc.sort_values("rank")["value"]) == ["s0", "s1", "s2"]


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, None)], "`sepal width (cm)` double, `a.b` double")
    m = {r["column"]: r["missing"] for r in P.missing_counts(df).collect()}
    assert m == {"sepal width (cm)": 0, "a.b": 1}
    assert P.numeric_summary(df).count() == 2


def test_numeric_summary_approx_option(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1001)], "x double")
    exact = P.numeric_summary(df).first()
    approx = P.numeric_summary(df, method="approx").first()
    assert exact["p50"] == 500.0 and abs(approx["p50"] - 500.0) <= 1.0


def test_nan_counts_as_missing_without_normalising(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double")
    assert P.missing_counts(df).first()["missing"] == 2
    assert P.unique_counts(df).first()["unique"] == 1


def test_profile_bundle(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "a", 2.0), (2, None, 3.0)], "k int, s string, x double")
    out = P.profile(df)
    assert out["shape"].first()["n_rows"] == 3
    assert out["duplicates"].first()["duplicates"] == 1
    assert {r["column"] for r in out["numeric_summary"].collect()} == {"k", "x"}


def test_column_lists_after_onehot(spark):
    from tabforge.operators import encode as EN
    df = spark.createDataFrame([(i, float(i % 7), f"c{i % 3}") for i in range(40)], "row_id int, v double, c string")
    out = {r["list"]: r["columns"] for r in P.column_lists(EN.onehot_encode(df, ["c"])).collect()}
    assert out == {"columns": "row_id, v, c_c1, c_c2", "numeric": "row_id, v, c_c1, c_c2",
                   "categorical": "", "scalable": "v"}


def test_numeric_summary_ignores_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (3.0,), (None,)], "x double")
    r = P.numeric_summary(df).first()
    assert (r["count"], r["min"], r["max"], r["p50"]) == (2, 1.0, 3.0, 2.0)
    assert P.column_ranges(df).first()["max"] == 3.0


def test_unique_counts_sketch_option(spark):
    df = spark.createDataFrame([(i % 1000, float("nan") if i % 7 == 0 else float(i % 50)) for i in range(5000)],
                               "a int, b double")
    got = {r["column"]: r["unique"] for r in P.unique_counts(df, rsd=0.01).collect()}
    assert abs(got["a"] - 1000) <= 30 and abs(got["b"] - 50) <= 2


def test_numeric_summary_all_null_column(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    got = {r["column"]: r for r in P.numeric_summary(df).collect()}
    assert got["b"]["count"] == 0 and got["b"]["p50"] is None and got["a"]["p50"] == 1.5
