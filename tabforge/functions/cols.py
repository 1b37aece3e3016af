"""Column naming, type classes and missing-value normalisation.

Column names may contain spaces, dots or brackets (``sepal width (cm)``), so
every reference goes through :func:`c`, which back-quotes the name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
NUMERIC = INTEGRAL + FRACTIONAL


def q(name: str) -> str:
    """Back-quoted identifier usable in ``F.col`` and SQL text."""
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    return F.col(q(name))


def is_numeric(dt: T.DataType) -> bool:
    """Numeric class used for summaries, scaling and imputation (no booleans)."""
    return isinstance(dt, NUMERIC)


def is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, INTEGRAL)


def kind(dt: T.DataType) -> str:
    """Coarse class of a column: numeric, categorical, boolean, datetime, other."""
    if is_numeric(dt):
        return "numeric"
    if isinstance(dt, (T.StringType, T.VarcharType, T.CharType)):
        return "categorical"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "other"


def dtype_name(dt: T.DataType) -> str:
    return dt.simpleString()


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if kind(f.dataType) == "categorical"]


def field(df: DataFrame, name: str) -> T.StructField:
    for f in df.schema.fields:
        if f.name == name:
            return f
    raise KeyError(f"column not found: {name!r}")


def existing(df: DataFrame, names) -> list[str]:
    """Keep the names that exist in ``df``, in the order given."""
    have = set(df.columns)
    return [n for n in (names or []) if n in have]


def is_missing(name: str, dt: T.DataType) -> Column:
    """NULL, or NaN in a float column: what the reference counts as missing."""
    x = c(name)
    return (x.isNull() | F.isnan(x)) if isinstance(dt, (T.FloatType, T.DoubleType)) else x.isNull()


def value_or_null(name: str, dt: T.DataType) -> Column:
    """The column with NaN turned into NULL (other types unchanged)."""
    x = c(name)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(x), F.lit(None)).otherwise(x)
    return x


def from_key(v, dt: T.DataType):
    """Python value of a long-form key: booleans, dates and (time-zone
    aware) timestamps are keyed by integers there (0/1, epoch days, epoch
    microseconds); other values are returned as they are."""
    import datetime as _dt
    if v is None:
        return None
    if isinstance(dt, T.BooleanType):
        return bool(v)
    if isinstance(dt, T.DateType):
        return _dt.date(1970, 1, 1) + _dt.timedelta(days=int(v))
    if isinstance(dt, T.TimestampType):
        return _dt.datetime(1970, 1, 1, tzinfo=_dt.timezone.utc) + _dt.timedelta(microseconds=int(v))
    return v


def normalize_missing(df: DataFrame, inf_as_missing: bool = False) -> DataFrame:
    """Turn NaN (and optionally +-inf) in float columns into NULL, in one projection.

    After this NULL is the only missing marker, so ``avg`` and
    ``count(distinct)`` behave like their pandas counterparts.
    """
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            x = c(f.name)
            bad = F.isnan(x)
            if inf_as_missing:
                bad = bad | (F.abs(x) == F.lit(float("inf")))
            out.append(F.when(bad, F.lit(None)).otherwise(x).cast(f.dataType).alias(f.name))
        else:
            out.append(c(f.name))
    return df.select(*out)
