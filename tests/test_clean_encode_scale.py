import pytest
from pyspark.sql import functions as F

from tabforge.operators import clean as CL
from tabforge.operators import encode as EN
from tabforge.operators import scale as SC


def test_impute_strategies(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (None, None, None), (3, 5.0, "b"), (3, 6.0, "b")],
                               "i int, d double, s string")
    mean = CL.impute(df, "mean", ["i", "d", "s"]).collect()  # s skipped (not numeric)
    assert mean[1]["i"] == pytest.approx(7 / 3) and mean[1]["d"] == pytest.approx(4.0) and mean[1]["s"] is None
    med = CL.impute(df, "median").collect()
    assert med[1]["i"] == 3.0 and med[1]["d"] == 5.0
    mode = CL.impute(df, "mode").collect()
    assert (mode[1]["i"], mode[1]["d"], mode[1]["s"]) == (3, 1.0, "b")  # ties -> smallest
    drop = CL.impute(df, {"d": "drop"})
    assert drop.count() == 3


def test_all_null_column_stays(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert CL.impute(df, "mean").where(F.col("x").isNull()).count() == 2
    assert CL.impute(df, "mode").where(F.col("x").isNull()).count() == 2


def test_remove_columns_errors(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        CL.remove_columns(df, [])
    with pytest.raises(ValueError):
        CL.remove_columns(df, ["zz"])
    assert CL.remove_columns(df, ["a", "zz"]).columns == ["b"]


def test_dedup_idempotent(spark):
    df = spark.createDataFrame([(0.0, None), (-0.0, None), (float("nan"), 1), (float("nan"), 1)], "x double, y int")
    once = CL.drop_duplicates(df)
    assert once.count() == 2 and CL.drop_duplicates(once).count() == 2


def test_label_codes_dense_and_sorted(spark):
    df = spark.createDataFrame([("10",), ("9",), ("Z",), (None,), ("9",)], "v string")
    out = [r["v"] for r in EN.label_encode(df, ["v"]).collect()]
    codes = dict(zip(["10", "9", "Z", None, "9"], out))
    assert codes == {"10": 0, "9": 1, "Z": 2, None: 3}  # 10 < 9 < Z < nan


def test_onehot_layout(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c")], "k int, c string")
    out = EN.onehot_encode(df, ["c"])
    assert out.columns == ["k", "c_b", "c_c"]
    rows = {r["k"]: (r["c_b"], r["c_c"]) for r in out.collect()}
    assert rows == {1: (1, 0), 2: (0, 0), 3: (0, 0), 4: (0, 1)}
    assert all(sum(v) <= 1 for v in rows.values())


def test_onehot_cardinality_guard(spark):
    ok = spark.createDataFrame([(f"v{i}",) for i in range(50)], "c string")
    assert len(EN.fit_onehot(ok, ["c"]).output_names()["c"]) == 49
    bad = spark.createDataFrame([(f"v{i}",) for i in range(51)], "c string")
    with pytest.raises(ValueError, match=r"c \(51 unique values\)"):
        EN.fit_onehot(bad, ["c"])


def test_scalers(spark):
    df = spark.createDataFrame([(float(i), 5.0, None if i == 3 else float(i)) for i in range(10)],
                               "x double, k double, m double")
    st = SC.scale(df, "StandardScaler")
    a = st.agg(F.avg("x"), F.stddev_pop("x"), F.max(F.abs("k"))).first()
    assert abs(a[0]) < 1e-12 and abs(a[1] - 1) < 1e-12 and a[2] == 0.0
    mm = SC.scale(df, "MinMaxScaler").agg(F.min("x"), F.max("x"), F.max("k")).first()
    assert (mm[0], mm[1], mm[2]) == (0.0, 1.0, 0.0)
    rb = SC.fit_scaler(df, "RobustScaler", ["x"]).params["x"]
    assert rb == {"center": 4.5, "scale": 4.5}
    assert SC.scale(df, "minmax").where(F.col("m").isNull()).count() == 1
    with pytest.raises(ValueError):
        SC.fit_scaler(df, "Nope")


def test_scaler_fit_on_train_only(spark):
    train = spark.createDataFrame([(0.0,), (10.0,)], "x double")
    test = spark.createDataFrame([(20.0,)], "x double")
    assert SC.scale(test, "minmax", fit_on=train).first()["x"] == 2.0


def test_label_encode_codes(spark):
    df = spark.createDataFrame([(f"k{i % 30}", i) for i in range(90)], "c string, i int")
    out = EN.label_encode(df, ["c"]).collect()
    codes = {r["i"]: r["c"] for r in out}
    expected = {v: n for n, v in enumerate(sorted({f"k{i % 30}" for i in range(90)}))}
    assert all(codes[i] == expected[f"k{i % 30}"] for i in range(90))


def test_onehot_boolean_and_date_columns(spark):
    import datetime as dt
    df = spark.createDataFrame([(True, dt.date(2024, 1, 2)), (False, dt.date(2024, 1, 1)), (None, dt.date(2024, 1, 2))],
                               "flag boolean, day date")
    out = EN.onehot_encode(df, ["flag", "day"])
    assert out.columns == ["flag_True", "day_2024-01-02"]
    assert [tuple(r) for r in out.collect()] == [(1, 1), (0, 0), (0, 1)]


def test_mode_imputation_dates_and_timestamps(spark):
    import datetime as dt
    rows = [(dt.date(2024, 1, 2), dt.datetime(2024, 5, 1, 10, 0)), (dt.date(2024, 1, 2), dt.datetime(2024, 5, 1, 10, 0)),
            (dt.date(2023, 1, 1), dt.datetime(2020, 1, 1)), (None, None)]
    df = spark.createDataFrame(rows, "d date, t timestamp")
    out = CL.impute(df, "mode").collect()
    assert out[3]["d"] == dt.date(2024, 1, 2)
    assert out[3]["t"] == out[0]["t"]


def test_label_encode_two_columns(spark):
    df = spark.createDataFrame([(f"a{i % 3}", f"b{i % 30:02d}", i) for i in range(60)], "x string, y string, i int")
    out = {r["i"]: (r["x"], r["y"]) for r in EN.label_encode(df, ["x", "y"]).collect()}
    assert all(out[i] == (i % 3, i % 30) for i in range(60))
    empty = spark.createDataFrame([], "x string")
    assert EN.label_encode(empty, ["x"]).count() == 0


def test_label_codes_do_not_shuffle_the_table(spark):
    df = spark.range(1000).selectExpr("id", "if(id % 2 = 0, 'x', 'y') as s")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = EN.label_encode(df, ["s"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_few_label_codes_are_compared_not_joined(spark):
    df = spark.createDataFrame([("x", 1), (None, 2), ("q", 3), ("x", 4)], "a string, n int")
    out = EN.label_encode(df, ["a"], plain=True)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in out.collect()) == [(0, 2), (1, 3), (2, 1), (2, 4)] and dict(out.dtypes)["a"] == "bigint"
    # unknown values are NULL; a value with two codes stays two rows; null values match nothing
    maps = spark.createDataFrame([("a", "x", 5), ("a", "x", 6), ("a", None, 7), ("b", "q", 8)], "column string, value string, code long")
    assert sorted(tuple(r) for r in EN.label_encode(df, ["a"], maps, plain=True).where("a is not null").collect()) == [(5, 1), (5, 4), (6, 1), (6, 4)]
    plain = EN.label_encode(df, ["a"], maps.where("code > 5"), plain=True)
    assert sorted((r["n"], r["a"]) for r in plain.collect()) == [(1, 6), (2, None), (3, None), (4, 6)]
    assert [r["a"] for r in EN.label_encode(df, ["a"], maps.where("false"), plain=True).collect()] == [None] * 4
    many = spark.range(100).selectExpr("cast(id as string) as a", "id as n")
    assert sorted(r["a"] for r in EN.label_encode(many, ["a"], plain=True).collect()) == list(range(100))
    numbers = spark.createDataFrame([(2.5,), (None,), (1.0,)], "a double")
    assert sorted(r["a"] for r in EN.label_encode(numbers, ["a"], plain=True).collect()) == [0, 1, 2]
