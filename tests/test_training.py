import pytest

from tabforge.operators import encode as EN
from tabforge.plans import models as MD
from tabforge.plans import training as TR
from tabforge.sources.tables import load_table

SF = "/root/testdata/sf0.001"


def _table(spark):
    df = load_table(spark, SF, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_linestatus", "l_returnflag")
    return EN.label_encode(df, ["l_linestatus"])


def test_grids_and_mapping():
    assert len(MD.grid_points(MD.HYPERPARAMETER_GRIDS["Random Forest"])) == 36
    assert len(MD.grid_points(MD.HYPERPARAMETER_GRIDS["XGBoost"])) == 27
    pts = MD.random_points(MD.HYPERPARAMETER_GRIDS["LightGBM"], 20, 42)
    assert len(pts) == 20 and len({tuple(sorted(p.items())) for p in pts}) == 20
    assert MD.to_mllib("rf", {"n_estimators": 50, "max_depth": None, "min_samples_split": 5}) == \
        {"numTrees": 50, "maxDepth": 30, "minInstancesPerNode": 3}
    with pytest.raises(ValueError):
        MD.family("SVM")


def test_train_rf_classifier(spark):
    r = TR.train(_table(spark), "l_returnflag", "Random Forest", params={"n_estimators": 5, "max_depth": 3})
    assert r.task_type == "classification" and len(r.cv_scores) == 5
    rec = r.record(spark).first()
    assert rec["model_name"] == "Random Forest" and set(rec["metrics"]) == {"accuracy", "f1_score", "roc_auc"}
    imp = r.importance(spark).collect()
    assert len(imp) == 4 and abs(sum(x["importance"] for x in imp) - 1) < 1e-9


def test_train_gbt_regression_random_search(spark):
    df = load_table(spark, SF, "lineitem").selectExpr("l_quantity", "l_discount", "l_extendedprice as y")
    r = TR.train(df, "y", "XGBoost", tuning="Random Search", n_iter=2, use_cv=False,
                 grid={"n_estimators": [3, 5], "max_depth": [2], "learning_rate": [0.1]})
    assert r.task_type == "regression" and len(r.search) == 2
    assert set(r.metrics) == {"mse", "rmse", "r2"}


def test_string_features_rejected(spark):
    df = load_table(spark, SF, "lineitem").select("l_quantity", "l_linestatus", "l_returnflag")
    with pytest.raises(ValueError, match="l_linestatus"):
        TR.train(df, "l_returnflag")


def test_exact_stratified_cv_folds(spark):
    r = TR.train(_table(spark), "l_returnflag", "Random Forest", params={"n_estimators": 3, "max_depth": 2},
                 exact=True)
    assert len(r.cv_scores) == 5 and all(0.0 <= s <= 1.0 for s in r.cv_scores)


def test_staged_fits_cover_all_points():
    points = MD.grid_points(MD.HYPERPARAMETER_GRIDS["Random Forest"]) + [{"max_depth": 3}, {"max_depth": 3}]
    fits = MD.staged(points)
    assert len(fits) == 12 + 2 and sorted(i for _, own in fits for i in own) == list(range(38))
    assert all(p["n_estimators"] == 200 for p, _ in fits[:12])
    assert len(MD.staged(MD.grid_points(MD.HYPERPARAMETER_GRIDS["XGBoost"]))) == 9


@pytest.fixture(scope="module")
def vectors(spark):
    from pyspark.ml.feature import VectorAssembler
    df = _table(spark).selectExpr("l_quantity", "l_discount", "l_tax", "case when l_returnflag = 'R' then 1d else 0d end as label",
                                  "case l_returnflag when 'R' then 2d when 'A' then 1d else 0d end as three")
    return VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="features").transform(df).cache()


@pytest.mark.parametrize("task, label", [("classification", "label"), ("classification", "three"), ("regression", "label")])
def test_boosted_prefix_is_the_shorter_fit(spark, vectors, task, label):
    n = 3 if label == "three" else 2
    long, short = (MD.make_estimator("XGBoost", task, n, {"n_estimators": k, "max_depth": 2}, label=label).fit(vectors) for k in (4, 2))
    a, b = ([r[0] for r in m.transform(vectors).select("prediction").collect()] for m in (MD.prefix(long, 2), short))
    assert a == b
    assert a != [r[0] for r in long.transform(vectors).select("prediction").collect()] or task == "classification"


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_forest_prefix_holds_its_first_trees(spark, vectors, task):
    forest = MD.make_estimator("Random Forest", task, 2, {"n_estimators": 5, "max_depth": 3}).fit(vectors)
    part = MD.prefix(forest, 2)
    assert part.getNumTrees == 2
    assert [t.toDebugString.split("\n", 1)[1] for t in part.trees] == [t.toDebugString.split("\n", 1)[1] for t in forest.trees[:2]]
    whole = MD.prefix(forest, 5).transform(vectors).select("prediction").collect()
    assert whole == forest.transform(vectors).select("prediction").collect()
    with pytest.raises(ValueError, match="5 trees"):
        MD.prefix(forest, 6)


def test_search_scores_every_point(spark):
    r = TR.train(_table(spark), "l_returnflag", "Random Forest", tuning="Grid Search", use_cv=False,
                 grid={"n_estimators": [2, 4], "max_depth": [2, 3]})
    assert [s["params"] for s in r.search] == MD.grid_points({"n_estimators": [2, 4], "max_depth": [2, 3]})
    assert all(0 < s["score"] <= 1 for s in r.search)
