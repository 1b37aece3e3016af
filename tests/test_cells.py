"""Large tables as weighted cells: same models as rows, within what bins and draws differ."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tabforge.plans import cells as CE
from tabforge.plans import models as MD
from tabforge.plans import training as TR


@pytest.fixture(scope="module")
def rows(spark):
    """12,000 rows, 40 values of ``a``, a boolean, 7 values of ``c``: 560 cells of the features at most."""
    df = spark.range(12_000).selectExpr("cast(pmod(xxhash64(id, 1), 40) as double) as a", "pmod(xxhash64(id, 2), 2) = 0 as b",
                                        "cast(pmod(xxhash64(id, 3), 7) as int) as c", "pmod(xxhash64(id, 4), 1000) / 1000 as e")
    return df.selectExpr("a", "b", "c", "a * 3 + c * c - if(b, 20, 0) + 10 * e as y",
                         "case when a + 5 * c + 20 * e > 60 then 'hi' when b then 'lo' else 'mid' end as k").cache()


@pytest.fixture()
def as_cells(monkeypatch):
    made = []

    class Seen(CE.Cells):
        def __init__(self, *a):
            super().__init__(*a)
            made.append(self.table.agg(F.count("*"), F.sum(F.aggregate("n", F.lit(0.0), lambda x, y: x + y))).first())
    monkeypatch.setattr(CE, "FROM_ROWS", 1000)
    monkeypatch.setattr(CE, "Cells", Seen)
    return made


CASES = [("y", "XGBoost", {"n_estimators": 5, "max_depth": 3}, 0.01), ("y", "Random Forest", {"n_estimators": 4, "max_depth": 4}, 0.02),
         ("k", "Random Forest", {"n_estimators": 4, "max_depth": 5, "min_samples_split": 10}, 0.06),
         ("k", "LightGBM", {"n_estimators": 3, "max_depth": 3}, 0.02)]


@pytest.mark.parametrize("target, model, params, near", CASES)
def test_cells_train_what_rows_train(spark, rows, as_cells, monkeypatch, target, model, params, near):
    df = rows.select("a", "b", "c", target)
    one = TR.train(df, target, model, params=params, use_cv=False, exact=False)
    assert len(as_cells) == 1 and as_cells[0][0] <= 560 * 3 and as_cells[0][1] == 12_000  # every row is in a cell
    monkeypatch.setattr(CE, "FROM_ROWS", 1 << 40)
    two = TR.train(df, target, model, params=params, use_cv=False, exact=False)
    assert len(as_cells) == 1 and one.metrics.keys() == two.metrics.keys()
    assert abs(one.train_score - two.train_score) < near and abs(one.test_score - two.test_score) < near
    assert all(abs(x["importance"] - y["importance"]) < 0.15 for x, y in zip(
        *(sorted(r.importance(spark).collect(), key=lambda x: x["feature"]) for r in (one, two))))
    # the model applies to raw rows, and its score over them is the score that cells gave
    pred = one.model.transform(df)
    if target == "k":
        pred = pred.select("prediction", "label")
    else:
        pred = pred.select("prediction", F.col("y").alias("label"))
    whole = TR._score(pred, one.task_type)
    assert min(one.train_score, one.test_score) - 1e-9 <= whole <= max(one.train_score, one.test_score) + 1e-9


def test_search_and_folds_over_cells(rows, as_cells):
    r = TR.train(rows.select("a", "b", "c", "y"), "y", "XGBoost", tuning="Random Search", n_iter=3, use_cv=True, exact=False,
                 grid={"n_estimators": [2, 4], "max_depth": [2, 3], "learning_rate": [0.3]})
    assert len(as_cells) == 1 and len(r.search) == 3 and len(r.cv_scores) == 5
    assert all(abs(s - r.test_score) < 0.05 for s in r.cv_scores)


def test_model_of_cells_is_saved_whole(rows, as_cells, tmp_dir):
    df = rows.select("a", "b", "c", "y")
    r = TR.train(df, "y", "Random Forest", params={"n_estimators": 3, "max_depth": 3}, use_cv=False, exact=False)
    r.model.write().save(tmp_dir)
    both = PipelineModel.load(tmp_dir).transform(r.model.transform(df).select("a", "b", "c", "y", F.col("prediction").alias("p")))
    assert as_cells and both.where("abs(p - prediction) > 1e-9").count() == 0


def test_rows_where_cells_do_not_pay(rows, as_cells):
    wide = rows.withColumn("d", F.col("y") * 17 % 1)
    assert CE.binning(wide.select("a", "b", "c", "d", "k"), ["a", "b", "c", "d"], "k", "classification") is None
    TR.train(rows.select("a", "c", "y"), "y", "XGBoost", params={"n_estimators": 2, "lossType": "absolute"}, use_cv=False, exact=False)
    assert not as_cells  # means per cell are enough for squared error only


def test_prefix_of_a_regression_forest_predicts_the_mean_of_its_trees(spark):
    from pyspark.ml.feature import VectorAssembler
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(
        spark.range(200).selectExpr("cast(id as double) as x", "100.0 + id as label"))
    part = MD.prefix(MD.make_estimator("Random Forest", "regression", 0, {"n_estimators": 4, "max_depth": 2}).fit(df), 2)
    first = df.first()["features"]
    assert abs(part.transform(df).first()["prediction"] - sum(t.predict(first) for t in part.trees) / 2) < 1e-9


def _scans(spark, df):
    """``df`` and a counter of the rows that scans of it read."""
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row
    return spark.createDataFrame(df.rdd.map(seen), df.schema), read


def test_a_forest_over_cells_scans_its_table_six_times(spark, rows, as_cells):
    df, read = _scans(spark, rows.select("a", "b", "c", "k"))
    r = TR.train(df, "k", "Random Forest", params={"n_estimators": 3, "max_depth": 3}, use_cv=False)
    # facts, edges, two for the split, labels, cells
    assert as_cells and read.value <= 6 * 12_000, read.value / 12_000
    # the folds that nobody asked for change nothing
    two = TR.train(rows.select("a", "b", "c", "k"), "k", "Random Forest", params={"n_estimators": 3, "max_depth": 3}, use_cv=True)
    assert len(two.cv_scores) == 5 and not r.cv_scores
    assert [*r.importance(spark).collect()] == [*two.importance(spark).collect()] and r.metrics == two.metrics


def test_facts_are_those_of_the_rows(spark):
    df = spark.createDataFrame([(1.0, 1, "x"), (float("nan"), 2, "y"), (None, 2, None), (3.0, None, None)], "a double, b int, k string")
    known = CE.facts(df, ["a", "b"], "k")
    assert (known.rows, known.unlabelled, known.incomplete) == (4, 2, 3)
    empty = CE.facts(df.where("b > 5"), ["a", "b"], "k")
    assert (empty.rows, empty.unlabelled, empty.incomplete) == (0, 0, 0)
    with pytest.raises(ValueError, match="2 rows have no k"):
        TR.train(df, "k")


def test_labels_of_signed_zeros_stay_apart(spark):
    df = spark.range(60).selectExpr("cast(id as double) as a", "case id % 3 when 0 then 0.0D when 1 then -0.0D else 1.0D end as k")
    r = TR.train(df, "k", params={"n_estimators": 2, "max_depth": 2}, use_cv=False, task="classification")
    assert r.labels == ["-0.0", "0.0", "1.0"]
