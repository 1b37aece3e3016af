"""Step workflow with a log (G1-G2): the reference's sequence of requests as
one object. Each step returns a new lazy DataFrame; the log records what
really changed, and ``checkpoint_every`` cuts the lineage of long pipelines
(reliable checkpoint in ``spark.checkpoint.dir``)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tabforge.operators import clean as CL
from tabforge.operators import encode as EN
from tabforge.operators import scale as SC
from tabforge.plans import training as TR
from tabforge.session import ensure_checkpoint_dir

_MISSING = {"mean": "mean", "median": "median", "mode": "mode", "drop": "drop",
            "Mean imputation": "mean", "Median imputation": "median", "Mode imputation": "mode",
            "Drop rows": "drop_rows", "Drop columns": "drop_columns", "drop_rows": "drop_rows", "drop_columns": "drop_columns"}


@dataclass
class Workflow:
    df: DataFrame
    checkpoint_every: int | None = None
    log: list[tuple[str, str]] = field(default_factory=list)
    scalers: dict[str, SC.Scaler] = field(default_factory=dict)

    def _step(self, name: str, details: str, df: DataFrame) -> "Workflow":
        self.log.append((name, details))
        if self.checkpoint_every and len(self.log) % self.checkpoint_every == 0:
            ensure_checkpoint_dir(df.sparkSession)
            df = df.checkpoint(eager=True)
        self.df = df
        return self

    def remove_columns(self, columns: Sequence[str]) -> "Workflow":
        valid = CL.C.existing(self.df, columns)
        return self._step("Remove Columns", f"Removed {len(valid)} columns: {', '.join(valid)}",
                          CL.remove_columns(self.df, columns))

    def handle_missing(self, strategy: str, columns: Sequence[str] | None = None) -> "Workflow":
        strategy = _MISSING.get(strategy, strategy)
        if strategy == "drop_rows":
            return self._step("Drop Rows", "Dropped rows with missing values", CL.drop_missing_rows(self.df))
        if strategy == "drop_columns":
            before = set(self.df.columns)
            out = CL.drop_missing_columns(self.df, columns)
            return self._step("Drop Columns", f"Dropped {len(before - set(out.columns))} columns", out)
        s = _MISSING.get(strategy)
        if s is None:
            raise ValueError(f"unknown strategy {strategy!r}")
        model = CL.fit_imputer(self.df, s, columns)
        changed = CL.changed_columns(model)
        out = model.transform(self.df)
        if s == "drop":
            out = out.na.drop(subset=changed)
        return self._step("Missing Values", f"Applied {s} to {len(changed)} columns", out)

    def impute(self, plan: Mapping[str, str]) -> "Workflow":
        model = CL.fit_imputer(self.df, dict(plan))
        dropped = [k for k, p in model.params.items() if p["strategy"] == "drop"]
        out = model.transform(self.df)
        if dropped:
            out = CL.drop_missing_rows(out, dropped)
        return self._step("Missing Values", f"Applied strategy to {len(CL.changed_columns(model))} columns", out)

    def encode(self, method: str, columns: Sequence[str]) -> "Workflow":
        cols = EN.validate_columns(self.df, columns)
        if method in ("Label Encoding", "label"):
            return self._step("Label Encoding", f"Encoded {len(cols)} columns", EN.label_encode(self.df, cols))
        if method in ("One-Hot Encoding", "onehot"):
            return self._step("One-Hot Encoding", f"Encoded {len(cols)} columns", EN.onehot_encode(self.df, cols))
        raise ValueError(f"unknown encoding method {method!r}")

    def scale(self, method: str = "StandardScaler", columns: Sequence[str] | None = None) -> "Workflow":
        model = SC.fit_scaler(self.df, method, columns)
        self.scalers[model.kind] = model
        return self._step("Feature Scaling", f"Scaled {len(model.params)} columns using {method}",
                          model.transform(self.df))

    def remove_duplicates(self) -> "Workflow":
        out = CL.drop_duplicates(self.df)
        removed = CL.duplicates_removed(self.df, out).first()["removed"]
        return self._step("Remove Duplicates", f"Removed {removed} duplicate rows", out)

    def info(self) -> dict[str, DataFrame]:
        """The current table's profile (P1-P15) as lazy DataFrames."""
        from tabforge.operators.profile import profile
        return profile(self.df)

    def train(self, target: str, **kw) -> TR.TrainResult:
        return TR.train(self.df, target, **kw)

    def log_df(self, spark: SparkSession) -> DataFrame:
        """G1: ``(step_no, step, details)``."""
        rows = [(i + 1, n, d) for i, (n, d) in enumerate(self.log)]
        return spark.createDataFrame(rows, "step_no int, step string, details string")

    def summary(self) -> list[str]:
        return [f"✅ {n}: {d}" for n, d in self.log]
