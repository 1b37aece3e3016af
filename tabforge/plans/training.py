"""Training plan: detect task -> split -> assemble -> fit / search -> CV -> evaluate.

Every fit is an MLlib job over the cluster; the driver only loops over
parameter points and folds (the reference's ``n_jobs=-1`` becomes
``parallelism`` concurrent fits). The train part is persisted while the
search and cross-validation re-read it, and released afterwards.

Reference defects not reproduced: tuning is read from one parameter
(``tuning``), errors raise instead of reporting a score of 0, string
features fail with the list of columns to encode, and metrics are kept in
the result record.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import OneVsRestModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.functions import cols as C
from tabforge.functions import metrics as ME
from tabforge.operators import split as SP
from tabforge.plans import cells as CE
from tabforge.plans import models as MD

TUNING = ("None", "Grid Search", "Random Search")


@dataclass
class TrainResult:
    model_name: str
    task_type: str
    train_score: float
    test_score: float
    cv_scores: list[float]
    best_params: dict[str, Any]
    feature_names: list[str]
    metrics: dict[str, float | None]
    model: PipelineModel
    labels: list[str] | None = None
    search: list[dict[str, Any]] = field(default_factory=list)

    @property
    def cv_mean(self) -> float | None:
        return round(sum(self.cv_scores) / len(self.cv_scores), 4) if self.cv_scores else None

    def record(self, spark) -> DataFrame:
        """V9: the result as a one-row DataFrame."""
        schema = T.StructType([
            T.StructField("model_name", T.StringType()), T.StructField("task_type", T.StringType()),
            T.StructField("train_score", T.DoubleType()), T.StructField("test_score", T.DoubleType()),
            T.StructField("cv_scores", T.ArrayType(T.DoubleType())), T.StructField("cv_mean", T.DoubleType()),
            T.StructField("best_params", T.MapType(T.StringType(), T.StringType())),
            T.StructField("feature_names", T.ArrayType(T.StringType())),
            T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        ])
        row = (self.model_name, self.task_type, round(self.train_score, 4), round(self.test_score, 4),
               [round(s, 4) for s in self.cv_scores], self.cv_mean,
               {k: str(v) for k, v in self.best_params.items()}, self.feature_names,
               {k: (None if v is None else float(v)) for k, v in self.metrics.items()})
        return spark.createDataFrame([row], schema)

    def importance(self, spark) -> DataFrame:
        """V5: ``(feature, importance, rank)``, highest first (empty if the model has none)."""
        imp = feature_importances(self.model.stages[-1], len(self.feature_names))
        rows = [] if imp is None else sorted(zip(self.feature_names, imp), key=lambda r: (-r[1], r[0]))
        return spark.createDataFrame([(f, v, i + 1) for i, (f, v) in enumerate(rows)],
                                     "feature string, importance double, rank int")

    def search_table(self, spark) -> DataFrame:
        """Mean CV score of every searched point: ``(params, mean_score)``."""
        rows = [({k: str(v) for k, v in s["params"].items()}, float(s["score"])) for s in self.search]
        return spark.createDataFrame(rows, "params map<string,string>, mean_score double")


def feature_importances(model, n: int) -> list[float] | None:
    if isinstance(model, OneVsRestModel):
        subs = [feature_importances(m, n) for m in model.models]
        subs = [s for s in subs if s is not None]
        return [sum(v) / len(subs) for v in zip(*subs)] if subs else None
    imp = getattr(model, "featureImportances", None)
    return None if imp is None else [float(x) for x in imp.toArray()]


# ---------------------------------------------------------------- preparation

def check_features(df: DataFrame, features: Sequence[str]) -> None:
    """String or other non-numeric features must be encoded first."""
    bad = [n for n in features
           if not (C.is_numeric(C.field(df, n).dataType) or isinstance(C.field(df, n).dataType, T.BooleanType))]
    if bad:
        raise ValueError(f"encode these columns before training (non-numeric features): {bad}")


def _prep_pipeline(target: str, features: list[str], task: str, bins: CE.Binning | None = None) -> Pipeline:
    """Label index (classification, alphabetical like the reference's encoder)
    and the feature vector; booleans and numbers are cast to double, or to their bins."""
    stages = []
    if task == "classification":
        stages.append(StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc",
                                    handleInvalid="error"))
    stages += bins.stages if bins else [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")]
    return Pipeline(stages=stages)


def _weights(pred: DataFrame) -> dict[str, str]:
    return {n: n for n in ("weight", "within") if n in pred.columns}


def _score(pred: DataFrame, task: str, metric: str | None = None) -> float:
    if task == "classification":
        hit = F.when(F.col("label") == F.col("prediction"), 1.0).otherwise(0.0)
        share = F.try_divide(F.sum(hit * F.col("weight")), F.sum("weight")) if "weight" in pred.columns else F.avg(hit)
        r = pred.agg(share).first()[0]
    else:
        m = ME.regression_metrics(pred, "label", "prediction", **_weights(pred)).first()
        r = m["mse"] if metric == "mse" else m["r2"]
    if r is None:
        raise ValueError("no rows to score: the split or fold is empty (too few rows for this test_size / folds)")
    return float(r)


def _fold_fits(table: CE.Rows | CE.Cells, model_name: str, n_classes: int, points: list[dict], folds: int,
               metric: str | None, parallelism: int) -> list[list[float]]:
    """Score every (point, fold): fit on the other folds, score on the fold. Points that
    differ in the number of trees only are prefixes of one fit (``models.prefix``)."""
    jobs = [(fit, own, k) for fit, own in MD.staged(points) for k in range(folds)]

    def run(job):
        fit, own, k = job
        model = table.fit(model_name, n_classes, fit, k)
        held, out = table.rows_of(k), []
        for i in own:
            fewer = points[i].get("n_estimators") != fit.get("n_estimators")
            part = MD.prefix(model, points[i]["n_estimators"]) if fewer else model
            out.append((i, k, _score(part.transform(held), table.task, metric)))
        return out

    scores = [[0.0] * folds for _ in points]
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        for i, k, s in (one for out in ex.map(run, jobs) for one in out):
            scores[i][k] = s
    return scores


def evaluate_predictions(pred: DataFrame, task: str, n_classes: int) -> dict[str, float | None]:
    """Test-set metrics (V1-V4) on ``label``/``prediction`` (+ probability, + weight)."""
    own = _weights(pred)
    if task == "regression":
        m = ME.regression_metrics(pred, "label", "prediction", **own).first()
        return {"mse": m["mse"], "rmse": m["rmse"], "r2": m["r2"]}
    cm = ME.classification_metrics(pred, "label", "prediction", **own).first()
    out = {"accuracy": cm["accuracy"], "f1_score": cm["weighted_f1"], "roc_auc": None}
    score_col = "probability" if "probability" in pred.columns else "rawPrediction"
    if score_col in pred.columns:
        arr = pred.select("label", *own, vector_to_array(F.col(score_col)).alias("__s"))
        present = [r[0] for r in arr.select("label").distinct().collect()]  # at most n_classes rows
        if n_classes == 2 and len(present) == 2:
            s = arr.select("label", *own, F.col("__s")[1].alias("score"))
            out["roc_auc"] = ME.roc_auc_binary(s, "label", "score", 1.0, **own).first()["auc"]
        elif n_classes > 2:
            s = arr.select("label", *own, *[F.col("__s")[i].alias(f"s{i}") for i in range(n_classes)])
            per = ME.roc_auc_ovr(s, "label", {float(i): f"s{i}" for i in range(n_classes)}, **own)
            out["roc_auc"] = per.where(F.col("cls") == "macro").first()["auc"]
    return out


# ---------------------------------------------------------------- train

def train(df: DataFrame, target: str, model: str = "Random Forest", test_size: float = SP.DEFAULT_TEST_SIZE,
          tuning: str = "None", use_cv: bool = True, params: dict[str, Any] | None = None,
          grid: dict[str, list] | None = None, n_iter: int = MD.RANDOM_SEARCH_POINTS,
          folds: int = MD.CV_FOLDS, seed: int = MD.SEED, parallelism: int = 4,
          task: str | None = None, exact: bool = True) -> TrainResult:
    """Train one model the way the reference's train request does.

    The test part has exactly its share of the rows, and the folds of a
    classifier are stratified (sizes differ by one at most per class), also
    where rows repeat; the rows are shuffled for it. ``exact=False`` places
    rows by seeded hash instead: no shuffle, sizes in expectation only.

    A table far larger than the number of its cells is trained as weighted cells
    (``plans/cells.py``), each row in its cell.
    """
    if tuning not in TUNING:
        raise ValueError(f"unknown tuning method {tuning!r}")
    features, _ = SP.features_and_label(df, target)
    check_features(df, features)
    task = task or SP.detect_task(df, target)
    data = df
    known = CE.facts(df, features, target)
    if known.unlabelled:  # a learner can't use them, and dropping them silently would change the table
        raise ValueError(f"{known.unlabelled} rows have no {target}; drop or fill them before training")

    if tuning == "None":
        points = [dict(params or {})]
    else:
        g = grid or MD.HYPERPARAMETER_GRIDS[model if model in MD.HYPERPARAMETER_GRIDS else "XGBoost"]
        points = MD.grid_points(g) if tuning == "Grid Search" else MD.random_points(g, n_iter, seed)
    bins = CE.binning(data, features, target, task, known) if all(set(p) <= CE.KNOWN for p in points) else None
    if exact:
        marked = SP.exact_split(data, test_size, seed, name="__split", rows=known.rows)
    else:
        marked = SP.mark_split(data, test_size, seed, name="__split")
    if bins and not use_cv and tuning == "None":
        folds, marked = 1, marked.withColumn("fold", F.lit(0))  # no one asks for a fold, and finding them takes scans
    elif exact:
        marked = SP.exact_folds(marked, folds, seed, ["__split", target] if task == "classification" else ["__split"])
    else:
        marked = SP.assign_folds(marked, folds, seed)
    # the labels of all rows; doubles as they are, for 0.0 and -0.0 are two labels
    kinds = data if C.kind(C.field(df, target).dataType) == "numeric" else data.select(C.c(target)).distinct()
    prep = _prep_pipeline(target, features, task, bins).fit(kinds)
    labels = list(prep.stages[0].labels) if task == "classification" else None
    n_classes = len(labels) if labels else 0

    if bins:
        table = CE.Cells(prep.transform(marked), bins, task, folds, "label" if labels else target)
    else:
        # one assembled table for both parts, spread over the cores (tree learners
        # re-scan it once per level; no-op when there are enough partitions) and
        # persisted once: search, CV and evaluation never re-run the upstream plan
        base = prep.transform(marked)
        if task == "regression":
            base = base.withColumn("label", C.c(target).cast("double"))
        base = base.select("features", "label", "fold", "__split")
        cores = df.sparkSession.sparkContext.defaultParallelism
        if base.rdd.getNumPartitions() < cores:
            base = base.repartition(cores)
        base = base.persist(StorageLevel.MEMORY_AND_DISK)
        base.count()  # materialise once before concurrent fits read it
        table = CE.Rows(base, task)
    test_pred = None
    try:
        best, search = points[0], []
        if tuning != "None":
            metric = None if task == "classification" else "mse"
            fold_scores = _fold_fits(table, model, n_classes, points, folds, metric, parallelism)
            means = [sum(s) / len(s) for s in fold_scores]
            pick = (max if task == "classification" else min)(range(len(points)), key=lambda i: means[i])
            best = points[pick]
            search = [{"params": p, "score": m} for p, m in zip(points, means)]
        fitted = table.fit(model, n_classes, best)
        train_score = _score(fitted.transform(table.train()), task)
        test_pred = fitted.transform(table.test()).persist(StorageLevel.MEMORY_AND_DISK)
        test_score = _score(test_pred, task)
        cv = []
        if use_cv:
            cv = _fold_fits(table, model, n_classes, [best], folds, None, parallelism)[0]
        metrics = evaluate_predictions(test_pred, task, n_classes)
    finally:
        if test_pred is not None:
            test_pred.unpersist()
        table.unpersist()
    full = PipelineModel(stages=[*prep.stages, fitted])
    return TrainResult(model, task, train_score, test_score, cv, best, features, metrics, full,
                       labels, search)
