"""Cleaning: column/row removal (R1-R5) and missing-value imputation (M1-M5)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.functions import cols as C
from tabforge.functions.ordered import exact_quantiles
from tabforge.operators.fitted import Fitted
from tabforge.operators.profile import modes, value_counts_long

STRATEGIES = ("mean", "median", "mode", "drop")


# ---------------------------------------------------------------- R1-R5

def remove_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop the named columns that exist; nothing named or nothing found is an error."""
    if not columns:
        raise ValueError("no columns selected")
    valid = C.existing(df, columns)
    if not valid:
        raise ValueError("selected columns not found")
    return df.drop(*valid)


def drop_missing_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """R2 (``columns=None``: any column) and R3 (only the given columns)."""
    if columns is None:
        return df.na.drop(how="any")
    valid = C.existing(df, columns)
    return df.na.drop(how="any", subset=valid) if valid else df


def drop_missing_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop the named columns (the reference does not check them for
    missing values). ``columns=None`` drops the columns that have any."""
    if columns is not None:
        return df.drop(*C.existing(df, columns))
    row = df.agg(*[F.count_if(C.is_missing(f.name, f.dataType)).alias(f"m{i}") for i, f in enumerate(df.schema.fields)]).first()
    return df.drop(*[n for i, n in enumerate(df.columns) if row[f"m{i}"] > 0])


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Whole-row de-duplication (NULL = NULL, NaN = NaN, 0.0 = -0.0).

    One shuffle on the row values; repeated rows are collapsed map-side first.
    """
    return df.dropDuplicates(list(subset)) if subset else df.dropDuplicates()


def duplicates_removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(removed, n_rows)`` for the step report."""
    a = before.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(None).cast("long").alias("m"))
    b = after.agg(F.count(F.lit(1)).alias("m")).select(F.lit(None).cast("long").alias("n"), "m")
    j = a.unionByName(b).agg(F.max("n").alias("n"), F.max("m").alias("m"))
    return j.select((F.col("n") - F.col("m")).alias("removed"), F.col("m").alias("n_rows"))


# ---------------------------------------------------------------- M1-M5

@dataclass
class Imputer(Fitted):
    """Per-column fill values; ``params[col] = {'strategy': s, 'value': v}``."""

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for f in df.schema.fields:
            p = self.params.get(f.name)
            x = C.c(f.name) if p is None else C.value_or_null(f.name, f.dataType)  # NaN is missing, as NULL is
            if p is None or p["value"] is None or p.get("missing") == 0 and C.is_integral(f.dataType):
                # nothing to fill, or an integral column with no gaps: pandas keeps it integral
                out.append(x.alias(f.name))
            elif p["strategy"] in ("mean", "median"):
                # numeric fill widens to double, as pandas does for int + NaN
                out.append(F.coalesce(x.cast("double"), F.lit(float(p["value"]))).alias(f.name))
            else:
                out.append(F.coalesce(x, F.lit(p["value"]).cast(f.dataType)).alias(f.name))
        return df.select(*out)


def _strategy_map(df: DataFrame, strategy: str | Mapping[str, str],
                  columns: Sequence[str] | None) -> dict[str, str]:
    if isinstance(strategy, Mapping):
        plan = {k: v for k, v in strategy.items() if k in df.columns}
    else:
        cols = df.columns if columns is None else C.existing(df, columns)
        plan = {k: strategy for k in cols}
    for s in plan.values():
        if s not in STRATEGIES:
            raise ValueError(f"unknown strategy {s!r}")
    # mean / median apply to numeric columns only; others are skipped
    return {k: s for k, s in plan.items()
            if s in ("mode", "drop") or C.is_numeric(C.field(df, k).dataType)}


def fit_imputer(df: DataFrame, strategy: str | Mapping[str, str] = "mean",
                columns: Sequence[str] | None = None) -> Imputer:
    """M1-M4: one statistic per column. ``columns=None`` means every eligible
    column. Means in one aggregate; medians exact and distributed; modes from
    the long-form value counts with the smallest value on ties."""
    plan = _strategy_map(df, strategy, columns)
    params: dict[str, dict] = {}
    mean_cols = [k for k, s in plan.items() if s == "mean"]
    med_cols = [k for k, s in plan.items() if s == "median"]
    mode_cols = [k for k, s in plan.items() if s == "mode"]
    num_cols = mean_cols + med_cols
    if num_cols:
        df = C.normalize_missing(df)
        row = df.agg(*[F.avg(C.c(k).cast("double")).alias(f"a{i}") for i, k in enumerate(mean_cols)],
                     *[F.count_if(C.c(k).isNull()).alias(f"m{i}") for i, k in enumerate(num_cols)]).first()
        missing = {k: row[f"m{i}"] for i, k in enumerate(num_cols)}
        for i, k in enumerate(mean_cols):
            params[k] = {"strategy": "mean", "value": row[f"a{i}"], "missing": missing[k]}
    if med_cols:
        got = {r["column"]: r["quantile"] for r in exact_quantiles(df, med_cols, [0.5]).collect()}
        for k in med_cols:
            params[k] = {"strategy": "median", "value": got.get(k), "missing": missing[k]}
    if mode_cols:
        m = modes(df, mode_cols, counts=value_counts_long(df, mode_cols)).collect()
        got = {r["column"]: C.from_key(next((v for v in (r["i"], r["d"], r["s"]) if v is not None), None),
                                       C.field(df, r["column"]).dataType) for r in m}
        for k in mode_cols:
            params[k] = {"strategy": "mode", "value": got.get(k)}
    for k, s in plan.items():
        if s == "drop":
            params[k] = {"strategy": "drop", "value": None}
    return Imputer("impute", params)


def impute(df: DataFrame, strategy: str | Mapping[str, str] = "mean",
           columns: Sequence[str] | None = None) -> DataFrame:
    """Fit and apply; the ``drop`` strategy removes rows missing in its columns."""
    model = fit_imputer(df, strategy, columns)
    drop_cols = [k for k, p in model.params.items() if p["strategy"] == "drop"]
    out = model.transform(df)
    return out.na.drop(subset=drop_cols) if drop_cols else out


def changed_columns(model: Imputer) -> list[str]:
    """Columns whose values the imputer can change (for an honest step log)."""
    return [k for k, p in model.params.items() if p["strategy"] == "drop" or p["value"] is not None]
