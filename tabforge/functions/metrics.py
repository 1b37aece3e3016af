"""Evaluation metrics (H6, V1-V8, V10) over prediction DataFrames.

Everything is an aggregate: confusion counts, per-class tallies and sums of
squares collapse map-side, so a metric over a billion predictions ships a
few rows per task. ROC AUC is exact (Mann-Whitney with ties counted half,
the trapezoid rule), computed from per-score counts with a distributed
running sum instead of a binned approximation.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.functions.cols import c
from tabforge.functions.ordered import prefix_sums


# ---------------------------------------------------------------- classification

def _common(df: DataFrame, label: str, prediction: str) -> tuple[Column, Column]:
    """Label and prediction in one type (an int label and a double prediction
    are compared as doubles), so each class has one key."""
    from tabforge.functions.cols import field, is_numeric
    lt, pt = field(df, label).dataType, field(df, prediction).dataType
    if lt != pt and is_numeric(lt) and is_numeric(pt):
        return c(label).cast("double"), c(prediction).cast("double")
    return c(label), c(prediction)


def confusion(df: DataFrame, label: str, prediction: str, weight: str | None = None) -> DataFrame:
    """``(label, prediction, count)`` (long form, one row per cell). A row of ``df`` counts as ``weight`` rows."""
    y, p = _common(df, label, prediction)
    number = F.sum(c(weight)).cast("long") if weight else F.count(F.lit(1))
    return df.groupBy(y.alias("label"), p.alias("prediction")).agg(number.alias("count"))


def confusion_wide(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """V10 as a matrix: one row per true label, one column per predicted label."""
    cm = confusion(df, label, prediction)
    # the pivot values are the predicted classes: one small distinct job, bounded by the classes
    wide = cm.groupBy("label").pivot("prediction").agg(F.sum("count"))
    return wide.na.fill(0, [x for x in wide.columns if x != "label"])


def per_class(df: DataFrame, label: str, prediction: str, weight: str | None = None) -> DataFrame:
    """``(cls, tp, support, predicted, precision, recall, f1)`` per class seen
    in labels or predictions (zero where undefined, as the reference's library)."""
    cm = confusion(df, label, prediction, weight)
    t = cm.select(F.col("label").cast("string").alias("cls"), F.col("count").alias("support"),
                  F.lit(0).cast("long").alias("predicted"),
                  F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0).alias("tp"))
    p = cm.select(F.col("prediction").cast("string").alias("cls"), F.lit(0).cast("long").alias("support"),
                  F.col("count").alias("predicted"), F.lit(0).cast("long").alias("tp"))
    s = t.unionByName(p).groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"),
                                            F.sum("predicted").alias("predicted"))
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    s = s.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(
        2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return s.withColumn("f1", f1)


def classification_metrics(df: DataFrame, label: str, prediction: str, weight: str | None = None) -> DataFrame:
    """V1: ``(n, accuracy, weighted_f1, macro_f1)`` in one row."""
    pc = per_class(df, label, prediction, weight)
    return pc.agg(
        F.sum("support").cast("long").alias("n"),
        F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        F.avg("f1").alias("macro_f1"))


def accuracy(df: DataFrame, label: str, prediction: str) -> Column:
    """Aggregate expression (usable per group): share of exact matches."""
    return F.avg(F.when(c(label) == c(prediction), 1.0).otherwise(0.0))


# ---------------------------------------------------------------- ROC

def _score_counts(df: DataFrame, positive: Column, score: Column, group: Column | None = None,
                  weight: str | None = None) -> DataFrame:
    keys = ([group.alias("grp")] if group is not None else [F.lit(0).alias("grp")]) + [score.alias("score")]
    one = c(weight) if weight else F.lit(1)
    # rows without a score or without a label take no part (neither class)
    return df.where(score.isNotNull() & positive.isNotNull()).groupBy(*keys).agg(
        F.sum(F.when(positive, one).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(positive, 0).otherwise(one)).cast("long").alias("neg"))


def _auc_from_counts(counts: DataFrame) -> DataFrame:
    """``(grp, auc, n_pos, n_neg)``; NULL when a group lacks one of the classes."""
    cum = prefix_sums(counts, "grp", ["score"], ["neg"])
    part = cum.select("grp", "pos", "neg",
                      (F.col("pos") * ((F.col("cum_neg") - F.col("neg")) + 0.5 * F.col("neg"))).alias("w"))
    agg = part.groupBy("grp").agg(F.sum("w").alias("w"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return agg.select("grp", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                                    F.col("w") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"),
                      "n_pos", "n_neg")


def roc_auc_binary(df: DataFrame, label: str, score: str, pos_label=1, weight: str | None = None) -> DataFrame:
    """V2: exact binary ROC AUC of ``score`` for ``label == pos_label``: ``(auc, n_pos, n_neg)``."""
    counts = _score_counts(df, c(label) == F.lit(pos_label), c(score).cast("double"), weight=weight)
    return _auc_from_counts(counts).drop("grp")


def roc_auc_ovr(df: DataFrame, label: str, scores: Mapping[object, str], weight: str | None = None) -> DataFrame:
    """V3: one-vs-rest AUC per class (class value -> its score column) and
    their macro average: ``(cls, auc)`` rows plus the ``macro`` row."""
    rows = [c(weight).alias("__w")] if weight else []
    long = df.select(c(label).alias("__y"), *rows, F.inline(F.array(*[
        F.struct(F.lit(str(k)).alias("cls"), F.lit(k).alias("__k"), c(col).cast("double").alias("score"))
        for k, col in scores.items()])))
    counts = _score_counts(long, F.col("__y") == F.col("__k"), F.col("score"), F.col("cls"), "__w" if weight else None)
    per = _auc_from_counts(counts).select(F.col("grp").alias("cls"), "auc")
    # classes absent from the labels have no AUC and are left out of the average
    macro = per.agg(F.avg("auc").alias("auc")).select(F.lit("macro").alias("cls"), "auc")
    return per.unionByName(macro)


def roc_curve(df: DataFrame, label: str, score: str, pos_label=1) -> DataFrame:
    """``(threshold, tp, fp, tpr, fpr)`` for every distinct score, highest first."""
    counts = _score_counts(df, c(label) == F.lit(pos_label), c(score).cast("double"))
    cum = prefix_sums(counts, "grp", [F.col("score").desc()], ["pos", "neg"])
    tot = counts.groupBy("grp").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return cum.join(F.broadcast(tot), "grp").select(
        F.col("score").alias("threshold"), F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
        F.try_divide(F.col("cum_pos"), F.col("P")).alias("tpr"),
        F.try_divide(F.col("cum_neg"), F.col("N")).alias("fpr"))


# ---------------------------------------------------------------- regression

def regression_metrics(df: DataFrame, label: str, prediction: str, weight: str | None = None,
                       within: str | None = None) -> DataFrame:
    """V4: ``(n, mse, rmse, r2)`` in one pass (r2 = 1 - SSE / SST). With ``weight`` and ``within`` a row stands for
    ``weight`` rows of one prediction whose labels have this mean and these squared deviations from it (a pass more)."""
    y, p = c(label).cast("double"), c(prediction).cast("double")
    known = df.where(y.isNotNull() & p.isNotNull())
    if weight:
        w = c(weight)
        mean = known.agg(F.try_divide(F.sum(w * y), F.sum(w))).first()[0]
        a = known.agg(F.sum(w).cast("long").alias("n"), F.sum(c(within) + w * (y - p) * (y - p)).alias("sse"),
                      F.sum(c(within) + w * (y - F.lit(mean)) * (y - F.lit(mean))).alias("sst"))
        sst = F.col("sst")
    else:
        a = known.agg(F.count(F.lit(1)).alias("n"), F.sum((y - p) * (y - p)).alias("sse"), F.var_pop(y).alias("vp"))
        sst = F.col("vp") * F.col("n")
    r2 = F.when(sst == 0, F.when(F.col("sse") == 0, 1.0).otherwise(0.0)).otherwise(1 - F.col("sse") / sst)
    mse = F.try_divide(F.col("sse"), F.col("n"))
    return a.select("n", mse.alias("mse"), F.sqrt(mse).alias("rmse"), r2.alias("r2"))


def r2_expr(label: str, prediction: str) -> tuple[Column, ...]:
    y, p = c(label).cast("double"), c(prediction).cast("double")
    return F.sum((y - p) * (y - p)).alias("__sse"), F.var_pop(y).alias("__vp"), F.count(y).alias("__n")


# ---------------------------------------------------------------- folds (H4, V6-V8)

def fold_scores(df: DataFrame, fold: str, label: str, prediction: str,
                metric: str = "accuracy") -> DataFrame:
    """``(fold, score)``: accuracy or r2 per fold, one aggregate."""
    g = df.groupBy(c(fold).alias("fold"))
    if metric == "accuracy":
        return g.agg(accuracy(df, label, prediction).alias("score"))
    if metric == "r2":
        t = g.agg(*r2_expr(label, prediction))
        sst = F.col("__vp") * F.col("__n")
        return t.select("fold", F.when(sst == 0, F.when(F.col("__sse") == 0, 1.0).otherwise(0.0))
                        .otherwise(1 - F.col("__sse") / sst).alias("score"))
    raise ValueError(f"unknown metric {metric!r}")


def cv_summary(scores: DataFrame, score: str = "score") -> DataFrame:
    """V6/V7: ``(n_folds, cv_mean, cv_std, cv_min, cv_max)``; mean rounded to
    4 dp as reported by the reference, std is the population std."""
    return scores.agg(F.count(c(score)).alias("n_folds"), F.round(F.avg(c(score)), 4).alias("cv_mean"),
                      F.stddev_pop(c(score)).alias("cv_std"), F.min(c(score)).alias("cv_min"),
                      F.max(c(score)).alias("cv_max"))


def fold_deviation(scores: DataFrame, score: str = "score") -> DataFrame:
    """V8: score minus the mean over folds (a handful of rows: a global window is fine)."""
    return scores.withColumn("deviation", c(score) - F.avg(c(score)).over(Window.partitionBy()))


def run_scores(df: DataFrame, run: str, fold: str, label: str, prediction: str,
               test_fold=0) -> DataFrame:
    """Scores of many runs at once: ``(run, train_score, test_score, cv_mean, cv_std)``.

    Rows of ``test_fold`` are the test part; the other folds are the train
    part, and the per-fold accuracies over them give the CV spread. One
    aggregate by (run, fold), then a tiny one by run.
    """
    hit = F.when(c(label) == c(prediction), 1.0).otherwise(0.0)
    per = df.groupBy(c(run).alias("run"), c(fold).alias("fold")).agg(
        F.sum(hit).alias("hits"), F.count(F.lit(1)).alias("n"))
    is_test = F.col("fold") == F.lit(test_fold)
    return per.groupBy("run").agg(
        F.try_divide(F.sum(F.when(~is_test, F.col("hits"))), F.sum(F.when(~is_test, F.col("n")))).alias("train_score"),
        F.try_divide(F.sum(F.when(is_test, F.col("hits"))), F.sum(F.when(is_test, F.col("n")))).alias("test_score"),
        F.avg(F.when(~is_test, F.col("hits") / F.col("n"))).alias("cv_mean"),
        F.stddev_pop(F.when(~is_test, F.col("hits") / F.col("n"))).alias("cv_std"))
