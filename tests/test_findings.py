"""Behaviour that earlier reviews found wrong."""

import math

import pytest
from pyspark.sql import functions as F

from tabforge.functions.ordered import exact_quantiles
from tabforge.operators import balance as BA
from tabforge.operators import clean as CL
from tabforge.operators import encode as EN
from tabforge.operators import scale as SC
from tabforge.operators import split as SP
from tabforge.plans import models as MD
from tabforge.plans.workflow import Workflow
from tabforge.sources import csv as CSV
from tabforge.sources import store as ST


def _csv(tmp_path, text, name="t.csv"):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_csv_quotes_backslashes_and_line_ends(spark, tmp_path):
    df = CSV.read_csv(spark, _csv(tmp_path, 'a,b\n"say ""hi"", ok",1\n"C:\\dir\\",2\n"two\nlines",3\n pad ,4\n'))
    assert dict(df.dtypes) == {"a": "string", "b": "bigint"}
    assert {r["b"]: r["a"] for r in df.collect()} == {1: 'say "hi", ok', 2: "C:\\dir\\", 3: "two\nlines", 4: " pad "}


def test_csv_surplus_and_missing_fields(spark, tmp_path):
    with pytest.raises(ValueError, match="more than the header"):
        CSV.read_csv(spark, _csv(tmp_path, "x,y\n1,2\n3,4,5\n"))
    assert [tuple(r) for r in CSV.read_csv(spark, _csv(tmp_path, "x,y\n1,2\n3\n", "s.csv")).collect()] == [(1, 2.0), (3, None)] or \
        [tuple(r) for r in CSV.read_csv(spark, _csv(tmp_path, "x,y\n1,2\n3\n", "s.csv")).collect()] == [(1, 2), (3, None)]


@pytest.mark.parametrize("row", ["3,4,,5", "3,4,", "3,4,,", '3,"4,5",6', '"a ""q"", b",4,"x\ny"'])
def test_csv_surplus_of_any_kind(spark, tmp_path, row):
    with pytest.raises(ValueError, match="1 rows have more than the header"):
        CSV.read_csv(spark, _csv(tmp_path, f"x,y\n1,2\n{row}\n"))
    kept = CSV.read_csv(spark, _csv(tmp_path, 'x,y\n1,"a,b,""c"", d"\n"e,f,g"\n', "k.csv"))
    assert sorted(tuple(r) for r in kept.collect()) == [("1", 'a,b,"c", d'), ("e,f,g", None)]


def test_csv_number_types(spark, tmp_path):
    text = "a,b,c,d,e,f,g,h\n1,1.5,True,x,1,9223372036854775807,NA,0x1p3\n 2 ,-.5e3,false,1,True,9223372036854775808,,NAN\n+3,inf,TRUE,2.5,NA,1,nan,1f\n"
    df = CSV.read_csv(spark, _csv(tmp_path, text))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string", "string", "string", "double", "string"]


def test_csv_type_checks_are_one_pass_over_wide_tables(spark, tmp_path):
    names = [f"c{i}" for i in range(300)]
    df = CSV.read_csv(spark, _csv(tmp_path, ",".join(names) + "\n" + "\n".join(",".join(str(i * j / 2) for j in range(300)) for i in range(20)) + "\n"))
    assert {t for _, t in df.dtypes} == {"double"} and df.count() == 20


def test_rows_without_target_are_an_error(spark):
    from tabforge.plans import training as TR
    df = spark.createDataFrame([(float(i), None if i % 4 == 0 else "a" if i % 2 else "b") for i in range(40)], "x double, y string")
    with pytest.raises(ValueError, match="10 rows have no y"):
        TR.train(df, "y")


def test_csv_types_and_blank_header(spark, tmp_path):
    df = CSV.read_csv(spark, _csv(tmp_path, "a,,c,d\n123456789012345678901,12d,1e3,.5\n2,7f,-2,3.\n"))
    assert df.columns == ["a", "Unnamed: 1", "c", "d"]
    assert [t for _, t in df.dtypes] == ["string", "string", "double", "double"]
    assert df.orderBy("a").first()["a"] == "123456789012345678901"


def test_csv_export_keeps_text(spark, tmp_path):
    rows = [(1, " pad "), (2, 'a "q", b'), (3, "back\\slash\\"), (4, "line\nend"), (5, "tab\there")]
    path = str(tmp_path / "out.csv")
    ST.export_data(spark.createDataFrame(rows, "i long, t string"), path, "csv")
    assert sorted(tuple(r) for r in CSV.read_csv(spark, path).collect()) == rows


def test_depth_beyond_the_ceiling_raises():
    with pytest.raises(ValueError, match="max_depth"):
        MD.make_estimator("Random Forest", "classification", params={"max_depth": 50})
    assert MD.make_estimator("Random Forest", "classification").getMaxDepth() == 30


@pytest.mark.parametrize("values", [
    [math.exp(40 * math.sin(i * 12.9898) * 4) * (1 if i % 3 else -1) for i in range(5000)],
    [float("inf"), float("-inf"), 0.0, -0.0, 1e300, -1e300, 5e-324, *[float(i) for i in range(3000)]],
    [3.5] * 4000, [1.0 + i * 2**-52 for i in range(3000)]])
def test_quantiles_of_hard_columns(spark, values):
    import numpy as np
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r["p"]: r["quantile"] for r in exact_quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.9, 1.0], max_rows=20).collect()}
    v = sorted(x + 0.0 for x in values)
    for p, q in got.items():
        h = (len(v) - 1) * p
        a, b = v[math.floor(h)], v[math.ceil(h)]
        want = a if a == b else a + (h - math.floor(h)) * (b - a)
        assert q == want or np.isclose(q, want, rtol=1e-12)


def test_balancing_missing_labels_and_spread(spark):
    df = spark.createDataFrame([(i, None if i == 3 else "a") for i in range(9)], "x int, y string")
    for f in (BA.undersample, BA.oversample):
        with pytest.raises(ValueError, match="missing"):
            f(df, "y")
    rows = [(i, "a") for i in range(20_000)] + [(i, "b") for i in range(4)]
    out = BA.oversample(spark.createDataFrame(rows, "x int, y string"), "y")
    per = out.where("y = 'b'").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per) == 20_000 and len(per) > 1


def test_label_codes_of_doubles(spark):
    values = [0.0001, 0.5, 1e7, 123456.789, 1e16, 1e-5, -2.5e-7, 1.5e20, 0.00123, 1.0, -0.001, 12345678.9, 9007199254740993.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    text = [r[0] for r in df.select(EN.double_text(F.col("x"))).collect()]
    assert text == [repr(v) for v in values]
    codes = {v: n for n, v in enumerate(sorted(map(repr, values)))}
    assert [r[0] for r in EN.label_encode(df.select("x", F.col("x").alias("y")), ["x"]).orderBy("y").select("x").collect()] == \
        [codes[repr(v)] for v in sorted(values)]


def test_label_encoder_is_saved_and_applied(spark, tmp_path):
    train = spark.createDataFrame([("b", 1), ("a", 2), (None, 3)], "c string, i int")
    EN.LabelEncoder.fit(train, ["c"]).save(str(tmp_path / "codes"))
    new = spark.createDataFrame([("a", 1), ("zz", 2), (None, 3), ("b", 4)], "c string, i int")
    got = EN.LabelEncoder.load(spark, str(tmp_path / "codes")).transform(new)
    assert {r["i"]: r["c"] for r in got.collect()} == {1: 0, 2: None, 3: 2, 4: 1}
    with pytest.raises(ValueError, match="no label codes"):
        EN.label_encode(spark.createDataFrame([([1],)], "a array<int>"), ["a"])


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double")
    assert sorted(r[0] for r in CL.impute(df, "mean").collect()) == [1.0, 2.0, 3.0]
    assert CL.drop_missing_columns(df).columns == []
    for m in ("standard", "minmax", "robust"):
        got = [r[0] for r in SC.scale(df, m).collect()]
        assert sum(v is None for v in got) == 1 and not any(v is not None and math.isnan(v) for v in got)


def test_workflow_drop_strategies(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], "x int, y string")
    assert Workflow(df).impute({"x": "drop"}).df.count() == 2
    assert Workflow(df).handle_missing("Drop rows").df.count() == 1
    assert Workflow(df).handle_missing("Drop columns", ["y"]).df.columns == ["x"]


def test_exact_split_and_folds_with_repeated_rows(spark):
    rows = [(i % 3, "abc"[i % 3]) for i in range(150)] + [(i, "d") for i in range(37)]
    df = spark.createDataFrame(rows, "x int, y string").repartition(3)
    parts = {r["split"]: r["count"] for r in SP.exact_split(df, 0.2).groupBy("split").count().collect()}
    assert parts == {"test": 38, "train": 149}
    folds = SP.exact_folds(df, 5, stratify="y")
    assert sorted(map(tuple, folds.select("x", "y").collect())) == sorted(rows)
    for y in "abcd":
        n = {r["fold"]: r["count"] for r in folds.where(F.col("y") == y).groupBy("fold").count().collect()}
        assert len(n) == 5 and max(n.values()) - min(n.values()) <= 1
