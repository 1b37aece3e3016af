"""Feature scaling (X1-X6): standard, min-max and robust, as expressions.

MLlib's scalers differ from the reference (sample vs population std, 0.5 on
constant columns, approximate quantiles, vector columns), so the fit is an
aggregate and the transform a projection: ``(x - center) / scale``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.functions import cols as C
from tabforge.functions.ordered import exact_quantiles
from tabforge.operators.fitted import Fitted

METHODS = {"standard": "StandardScaler", "minmax": "MinMaxScaler", "robust": "RobustScaler"}
_ALIASES = {v: k for k, v in METHODS.items()}


def _method(name: str) -> str:
    key = _ALIASES.get(name, name)
    if key not in METHODS:
        raise ValueError(f"Unknown scaling method: {name}")
    return key


@dataclass
class Scaler(Fitted):
    """``params[col] = {'center': c, 'scale': s}``; missing stays missing."""

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for f in df.schema.fields:
            p = self.params.get(f.name)
            if p is None:
                out.append(C.c(f.name))
                continue
            x = C.value_or_null(f.name, f.dataType).cast("double")
            center = F.lit(p["center"] if p["center"] is not None else 0.0)
            out.append(((x - center) / F.lit(p["scale"])).alias(f.name))
        return df.select(*out)

    def params_df(self, spark):
        """``(column, center, scale)``."""
        rows = [(k, p["center"], p["scale"]) for k, p in self.params.items()]
        return spark.createDataFrame(rows, "column string, center double, scale double")


def _nonzero(v):
    # zero (or undefined) spread divides by 1, as the reference's library does
    return 1.0 if v is None or v == 0.0 else float(v)


def fit_scaler(df: DataFrame, method: str = "standard",
               columns: Sequence[str] | None = None) -> Scaler:
    """X1-X5. ``columns=None`` scales every numeric column."""
    m = _method(method)
    cols = C.numeric_columns(df) if columns is None else list(columns)
    bad = [n for n in cols if n not in df.columns or not C.is_numeric(C.field(df, n).dataType)]
    if bad:
        raise ValueError(f"columns are missing or not numeric: {bad}")
    params = {}
    if not cols:
        return Scaler(m, params)
    df = C.normalize_missing(df)  # NaN is missing, as NULL is
    if m == "standard":
        row = df.agg(*[F.avg(C.c(n).cast("double")).alias(f"a{i}") for i, n in enumerate(cols)],
                     *[F.stddev_pop(C.c(n).cast("double")).alias(f"s{i}") for i, n in enumerate(cols)]).first()
        for i, n in enumerate(cols):
            params[n] = {"center": row[f"a{i}"], "scale": _nonzero(row[f"s{i}"])}
    elif m == "minmax":
        row = df.agg(*[F.min(C.c(n).cast("double")).alias(f"a{i}") for i, n in enumerate(cols)],
                     *[F.max(C.c(n).cast("double")).alias(f"b{i}") for i, n in enumerate(cols)]).first()
        for i, n in enumerate(cols):
            lo, hi = row[f"a{i}"], row[f"b{i}"]
            params[n] = {"center": lo, "scale": _nonzero(None if lo is None else hi - lo)}
    else:
        qs = {}
        for r in exact_quantiles(df, cols, [0.25, 0.5, 0.75]).collect():
            qs.setdefault(r["column"], {})[r["p"]] = r["quantile"]
        for n in cols:
            q = qs.get(n, {})
            iqr = None if 0.75 not in q else q[0.75] - q[0.25]
            params[n] = {"center": q.get(0.5), "scale": _nonzero(iqr)}
    return Scaler(m, params)


def scale(df: DataFrame, method: str = "standard", columns: Sequence[str] | None = None,
          fit_on: DataFrame | None = None) -> DataFrame:
    """Fit on ``fit_on`` (default: ``df`` itself, the reference behaviour) and apply to ``df``."""
    return fit_scaler(fit_on if fit_on is not None else df, method, columns).transform(df)
