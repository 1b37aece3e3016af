"""tabforge: a Spark-native engine for tabular machine-learning workflows.

Every operator maps a DataFrame to a DataFrame (or fits a small parameter
table first and then applies a pure projection), so plans stay lazy and
Catalyst can fuse consecutive steps.

Subpackages
-----------
sources    table catalog, CSV ingestion, versioned save/load, export
operators  profiling, cleaning, imputation, encoding, scaling, split, balance
functions  column helpers, distributed ordered statistics, metrics, insights
plans      model training, tuning, cross-validation, step workflow
streaming  applying fitted transforms to streaming DataFrames
"""

from tabforge.session import get_spark

__all__ = ["get_spark"]
