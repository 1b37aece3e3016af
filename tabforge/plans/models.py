"""Model catalog (L1-L7) and hyper-parameter grids (H1-H3) on MLlib.

The reference's three model names map to two MLlib families: random forests
and gradient-boosted trees. Both boosted names ("XGBoost", "LightGBM") share
one grid in the reference, so one ``gbt`` family serves both; it is
first-order boosting, not either library. Multiclass boosting uses
``OneVsRest`` around a binary ``GBTClassifier``.
"""

from __future__ import annotations

import itertools
import math
import random
from typing import Any

from pyspark import SparkContext
from pyspark.ml.classification import GBTClassifier, OneVsRest, OneVsRestModel, RandomForestClassifier
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

# Fixed values from the reference.
MODEL_NAMES = ("Random Forest", "XGBoost", "LightGBM")
SEED = 42
HYPERPARAMETER_GRIDS = {
    "Random Forest": {
        "n_estimators": [50, 100, 200],
        "max_depth": [None, 5, 10, 20],
        "min_samples_split": [2, 5, 10],
    },
    "XGBoost": {
        "n_estimators": [50, 100, 200],
        "max_depth": [3, 6, 10],
        "learning_rate": [0.01, 0.1, 0.2],
    },
    "LightGBM": {
        "n_estimators": [50, 100, 200],
        "max_depth": [3, 6, 10],
        "learning_rate": [0.01, 0.1, 0.2],
    },
}
RANDOM_SEARCH_POINTS = 20
CV_FOLDS = 5

# Untuned defaults per model name: the named libraries' public defaults,
# except where MLlib needs a bound: a forest's "no depth limit" is MLlib's
# ceiling of 30 (MAX_DEPTH_UNLIMITED).
# LightGBM grows 31 leaves per tree, about depth 5 for a depth-wise learner.
MAX_DEPTH_UNLIMITED = 30
DEFAULTS = {
    "Random Forest": {"n_estimators": 100, "max_depth": None, "min_samples_split": 2},
    "XGBoost": {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.3},
    "LightGBM": {"n_estimators": 100, "max_depth": 5, "learning_rate": 0.1},
}

OVR_PARALLELISM = 4          # one-vs-rest class models fitted at the same time

_FAMILY = {"Random Forest": "rf", "rf": "rf", "random_forest": "rf",
           "XGBoost": "gbt", "LightGBM": "gbt", "gbt": "gbt"}


def family(model_name: str) -> str:
    try:
        return _FAMILY[model_name]
    except KeyError:
        raise ValueError(f"Unsupported model: {model_name}") from None


def _depth(v) -> int:
    if v is not None and int(v) > MAX_DEPTH_UNLIMITED:
        raise ValueError(f"max_depth {v} is beyond the {MAX_DEPTH_UNLIMITED} levels that MLlib trees can have")
    return MAX_DEPTH_UNLIMITED if v is None else int(v)


def to_mllib(fam: str, params: dict[str, Any]) -> dict[str, Any]:
    """H3: reference parameter names -> MLlib parameter values."""
    out: dict[str, Any] = {}
    for k, v in params.items():
        if k == "n_estimators":
            out["numTrees" if fam == "rf" else "maxIter"] = int(v)
        elif k == "max_depth":
            out["maxDepth"] = _depth(v)
        elif k == "min_samples_split":
            # a node splits only if both children can keep >= ceil(k/2) rows
            out["minInstancesPerNode"] = max(1, math.ceil(int(v) / 2))
        elif k == "learning_rate":
            out["stepSize"] = float(v)
        else:
            out[k] = v  # already an MLlib name
    return out


def make_estimator(model_name: str, task: str, n_classes: int = 2,
                   params: dict[str, Any] | None = None,
                   features: str = "features", label: str = "label", weight: str | None = None):
    """An MLlib estimator with seed 42 and the reference's defaults."""
    fam = family(model_name)
    base = dict(DEFAULTS.get(model_name, DEFAULTS["Random Forest" if fam == "rf" else "XGBoost"]))
    base.update(params or {})
    kw = to_mllib(fam, base)
    common = {"featuresCol": features, "labelCol": label, "seed": SEED}
    if weight:
        common["weightCol"] = weight
    if task == "classification":
        if fam == "rf":
            return RandomForestClassifier(featureSubsetStrategy="sqrt", **common, **kw)
        if n_classes <= 2:
            return GBTClassifier(**common, **kw)
        inner = GBTClassifier(**common, **kw)
        # one binary booster per class, fitted concurrently (each is a cluster job)
        return OneVsRest(classifier=inner, featuresCol=features, labelCol=label,
                         parallelism=min(n_classes, OVR_PARALLELISM), **({"weightCol": weight} if weight else {}))
    if task == "regression":
        if fam == "rf":
            return RandomForestRegressor(featureSubsetStrategy="all", **common, **kw)
        return GBTRegressor(**common, **kw)
    raise ValueError(f"Unsupported model: {model_name} for task: {task}")


def prefix(model, n: int):
    """The fitted forest or boosted model with its first ``n`` trees only.

    A boosted prefix is what ``n`` rounds would have fitted. A forest's prefix is a
    forest of ``n`` trees from the same distribution; fitted alone it would draw
    other samples.
    """
    if isinstance(model, OneVsRestModel):
        return model._copyValues(OneVsRestModel(models=[prefix(m, n) for m in model.models]))
    old = model._java_obj
    trees = old.trees()
    if n > len(trees):
        raise ValueError(f"the model has {len(trees)} trees, not {n}")
    return _of_trees(model, [trees[i] for i in range(n)])


def joined(forests: list):
    """One forest of the trees of several, in their order."""
    return _of_trees(forests[0], [tree for f in forests for tree in f._java_obj.trees()])


def _of_trees(model, trees: list):
    """A model like ``model`` of these trees; a boosted one keeps the weights of its first trees."""
    old, context, n = model._java_obj, SparkContext._active_spark_context, len(trees)
    name, ml, gateway = type(model).__name__, context._jvm.org.apache.spark.ml, context._gateway

    def first(values, kind):
        out = gateway.new_array(kind, n)
        for i in range(n):
            out[i] = values[i]
        return out

    classes = hasattr(model, "numClasses")
    by_class = classes and name.startswith("RandomForest")  # boosting always adds regression trees
    tree = ml.classification.DecisionTreeClassificationModel if by_class else ml.regression.DecisionTreeRegressionModel
    args = [first(trees, tree)]
    if name.startswith("GBT"):
        args.append(first(old.treeWeights(), context._jvm.double))
    args += [old.numFeatures(), *([old.numClasses()] if classes else [])]
    make = getattr(ml.classification if classes else ml.regression, name)
    new = make(f"{model.uid}_{n}", *args)
    out = model._copyValues(type(model)(new))
    if name.startswith("RandomForest"):  # a regression forest divides the sum of its trees by this
        new.set(new.getParam("numTrees").w(n))
        out._set(numTrees=n)
    return out


def staged(points: list[dict[str, Any]]) -> list[tuple[dict[str, Any], list[int]]]:
    """Fits that serve all ``points``: the parameters, and the places of the points that
    are prefixes of the fit. Points that differ in ``n_estimators`` only share the largest."""
    groups: dict[tuple, list[int]] = {}
    for i, p in enumerate(points):
        alone = () if "n_estimators" in p else (i,)
        groups.setdefault((*sorted((k, repr(v)) for k, v in p.items() if k != "n_estimators"), *alone), []).append(i)
    return [(max((points[i] for i in own), key=lambda p: p.get("n_estimators", 0)), own) for own in groups.values()]


def grid_points(grid: dict[str, list]) -> list[dict[str, Any]]:
    """All points of a grid, in the reference's (sorted-key) order."""
    keys = sorted(grid)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])]


def random_points(grid: dict[str, list], n: int = RANDOM_SEARCH_POINTS, seed: int = SEED) -> list[dict]:
    """H2: ``n`` distinct grid points drawn with a seeded generator."""
    pts = grid_points(grid)
    if n >= len(pts):
        return pts
    return random.Random(seed).sample(pts, n)
