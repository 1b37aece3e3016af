"""Rule-based insights (I1-I4) over a table of runs.

Input columns: ``train_score``, ``test_score`` and optionally ``cv_std``;
one row per trained model, so many runs are judged in one projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values from the reference's rules.
# I1 performance bands on the test score.
BAND_EXCELLENT, BAND_GOOD, BAND_FAIR = 0.9, 0.8, 0.7
# I2 train - test gap.
OVERFIT_GAP, BALANCED_GAP = 0.1, 0.05
# I3 cross-validation spread (population std).
CV_CONSISTENT, CV_VARIABLE = 0.05, 0.1
# I4 score grades.
GRADE_EXCELLENT, GRADE_GOOD, GRADE_FAIR, GRADE_WARNING = 0.9, 0.8, 0.7, 0.6


def insights(runs: DataFrame, train: str = "train_score", test: str = "test_score",
             cv_std: str | None = "cv_std") -> DataFrame:
    t, r = F.col(test), F.col(train)
    perf = (F.when(t >= BAND_EXCELLENT, "Excellent Performance").when(t >= BAND_GOOD, "Good Performance")
            .when(t >= BAND_FAIR, "Fair Performance").otherwise("Needs Improvement"))
    gap = r - t
    fit = F.when(gap > OVERFIT_GAP, "Possible Overfitting").when(gap < BALANCED_GAP, "Well-Balanced Model")
    out = runs.withColumn("performance", perf).withColumn("fit", fit)
    if cv_std and cv_std in runs.columns:
        s = F.col(cv_std)
        out = out.withColumn("cv_stability", F.when(s < CV_CONSISTENT, "Consistent Cross-Validation")
                             .when(s > CV_VARIABLE, "Variable Performance"))
    return out.withColumn("grade", score_grade(test))


def score_grade(col: str):
    s = F.col(col)
    return (F.when(s >= GRADE_EXCELLENT, "Excellent").when(s >= GRADE_GOOD, "Good")
            .when(s >= GRADE_FAIR, "Fair").when(s >= GRADE_WARNING, "Warning").otherwise("Poor"))
