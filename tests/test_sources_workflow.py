import os

from pyspark.sql import functions as F

from tabforge.plans.workflow import Workflow
from tabforge.sources import csv as CSV
from tabforge.sources import store as ST
from tabforge.sources.tables import load_table

SF = "/root/testdata/sf0.001"


def _write(path, data: bytes):
    if path.startswith("file:"):
        path = path[len("file:"):]
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_csv_latin1_duplicate_headers_na(spark, tmp_dir):
    p = f"{tmp_dir}/a.csv"
    _write(p, "x,x,name,flag,n\n1,NA,né,True,5\n2,3.5,,False,\n".encode("latin-1"))
    df = CSV.read_csv(spark, p)
    assert df.columns == ["x", "x.1", "name", "flag", "n"]
    types = dict(df.dtypes)
    assert types == {"x": "bigint", "x.1": "double", "name": "string", "flag": "boolean", "n": "bigint"}
    rows = df.orderBy("x").collect()
    assert rows[0]["name"] == "né" and rows[0]["x.1"] is None and rows[1]["n"] is None


def test_csv_rejects(spark, tmp_dir):
    import pytest
    with pytest.raises(ValueError):
        CSV.read_csv(spark, f"{tmp_dir}/a.txt")
    p = f"{tmp_dir}/empty.csv"
    _write(p, b"a,b\n")
    with pytest.raises(ValueError):
        CSV.read_csv(spark, p)


def test_save_load_head(spark, tmp_dir):
    df = spark.createDataFrame([(1, float("inf")), (2, 1.0)], "k int, v double")
    ST.save_version(df, tmp_dir, "v1")
    back = ST.load_version(spark, tmp_dir, "v1")
    h = ST.head(back, 5, order_by=["k"]).collect()
    assert h[0]["v"] is None and h[1]["v"] == 1.0


def test_workflow_log(spark):
    df = load_table(spark, SF, "orders").selectExpr(
        "o_totalprice", "case when o_orderkey % 5 = 0 then null else o_orderpriority end as prio", "o_orderstatus")
    w = Workflow(df)
    w.handle_missing("mode", ["prio"]).encode("One-Hot Encoding", ["prio"]).encode("Label Encoding", ["o_orderstatus"])
    w.scale("StandardScaler", ["o_totalprice"]).remove_duplicates()
    assert [r["step"] for r in w.log_df(spark).collect()] == [
        "Missing Values", "One-Hot Encoding", "Label Encoding", "Feature Scaling", "Remove Duplicates"]
    assert w.summary()[0].startswith("✅ Missing Values")
    assert w.df.where(F.col("o_totalprice").isNull()).count() == 0


def test_streaming_apply(spark, tmp_dir):
    from tabforge.operators import scale as SC
    from tabforge.streaming.apply import apply_fitted
    src = f"{tmp_dir}/in"
    batch = spark.createDataFrame([(float(i),) for i in range(10)], "x double")
    batch.write.parquet(src)
    model = SC.fit_scaler(batch, "minmax")
    stream = spark.readStream.schema(batch.schema).parquet(src)
    q = (apply_fitted(stream, [model]).writeStream.format("memory").queryName("scaled_stream")
         .trigger(availableNow=True).option("checkpointLocation", f"{tmp_dir}/ck").start())
    q.awaitTermination(120)
    got = sorted(r["x"] for r in spark.table("scaled_stream").collect())
    assert got[0] == 0.0 and got[-1] == 1.0 and len(got) == 10


def test_score_stream_with_pipeline_model(spark, tmp_dir):
    from tabforge.plans import training as TR
    from tabforge.streaming.apply import score_stream
    df = load_table(spark, SF, "lineitem").selectExpr("l_quantity", "l_discount", "l_tax",
                                                     "case when l_returnflag = 'R' then 1 else 0 end as y")
    r = TR.train(df, "y", "Random Forest", params={"n_estimators": 3, "max_depth": 2}, use_cv=False)
    src = f"{tmp_dir}/stream_in"
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = (score_stream(stream, r.model, keep=["y"]).writeStream.format("memory").queryName("scored")
         .trigger(availableNow=True).option("checkpointLocation", f"{tmp_dir}/ck2").start())
    q.awaitTermination(120)
    assert spark.table("scored").count() == df.count()


def test_workflow_checkpoint_every(spark):
    df = load_table(spark, SF, "orders").select("o_totalprice", "o_orderstatus")
    w = Workflow(df, checkpoint_every=1)
    w.scale("MinMaxScaler", ["o_totalprice"]).encode("Label Encoding", ["o_orderstatus"])
    assert w.df.count() == df.count() and len(w.log) == 2


def test_csv_odd_header_names(spark, tmp_dir):
    from tabforge.operators import profile as P
    p = f"{tmp_dir}/iris.csv"
    _write(p, b"sepal width (cm),a.b,target\n3.5,1,0\n3.0,,1\n3.2,2,1\n")
    df = CSV.read_csv(spark, p)
    assert df.columns == ["sepal width (cm)", "a.b", "target"]
    assert dict(df.dtypes) == {"sepal width (cm)": "double", "a.b": "bigint", "target": "bigint"}
    s = {r["column"]: r["p50"] for r in P.numeric_summary(df).collect()}
    assert s == {"sepal width (cm)": 3.2, "a.b": 1.5, "target": 1.0}


def test_workflow_info(spark):
    w = Workflow(load_table(spark, SF, "customer"))
    info = w.info()
    assert info["shape"].first()["n_rows"] == 150
    assert {r["column"] for r in info["categorical_summary"].collect()} == {"c_name", "c_mktsegment"}
