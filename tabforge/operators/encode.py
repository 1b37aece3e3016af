"""Categorical encoding: label codes (E1), one-hot with the first level
dropped (E2), the one-hot cardinality guard (E3) and column validation (E4)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.functions import cols as C
from tabforge.functions.ordered import BROADCAST_MAX_BYTES, BROADCAST_MAX_ROWS, dense_index

# Fixed values from the reference.
# One-hot refuses a column with more distinct values than this.
ONEHOT_MAX_DISTINCT = 50
# label_encode(plain=True): text columns of at most so many codes need no join.
PLAIN_CODES = 32
# Text used for a missing value by label encoding (str() of a float NaN).
MISSING_LABEL = "nan"


def validate_columns(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    """No columns is an error; unknown names are dropped; none left is an error."""
    if not columns:
        raise ValueError("no columns selected")
    valid = C.existing(df, columns)
    if not valid:
        raise ValueError("selected columns not found in dataset")
    return valid


def double_text(x):
    """A double as the reference writes it: shortest digits, positional from 1e-4 up to 1e16 (``10000000.0``,
    ``0.0001``), else with an exponent of two digits at least (``1e-05``, ``1e+16``)."""
    text = x.cast("string")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), "^-", "")
    exp = F.substring_index(text, "E", -1).try_cast("int")
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "(?<=.)0+$", "")
    n = F.length(digits)
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)
    large = F.concat(F.rpad(digits, F.greatest(n, exp + 1), "0").substr(F.lit(1), exp + 1), F.lit("."),
                     F.when(n > exp + 1, digits.substr(exp + 2, n)).otherwise("0"))
    short = F.when(n > 1, F.concat(digits.substr(F.lit(1), F.lit(1)), F.lit("."), digits.substr(F.lit(2), n))).otherwise(digits)
    power = F.concat(short, F.when(exp < 0, "e-").otherwise("e+"), F.lpad(F.abs(exp).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exp).cast("string"))), "0"))
    plain = F.when(exp.between(-4, -1), small).when(exp.between(0, 15), large).otherwise(power)
    return F.when(F.abs(x) == F.lit(float("inf")), F.concat(sign, F.lit("inf"))).when(
        text.contains("E"), F.concat(sign, plain)).otherwise(text)


def _as_label(df: DataFrame, name: str):
    """Text of the value; missing (NULL or NaN) becomes the class ``nan``."""
    dt = C.field(df, name).dataType
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
        raise ValueError(f"{name} holds {dt.simpleString()} values, which have no label codes")
    x = C.value_or_null(name, dt)
    return F.coalesce(double_text(x) if isinstance(dt, T.DoubleType) else x.cast("string"), F.lit(MISSING_LABEL))


# ---------------------------------------------------------------- E1

def label_maps(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, code)``: the sorted distinct text values of each
    column numbered from 0 (missing becomes the class ``nan``). Distributed:
    distinct values, then a range-partitioned running count."""
    cols = validate_columns(df, columns)
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("column"), _as_label(df, n).alias("value")) for n in cols])))
    distinct = long.distinct()
    return dense_index(distinct, "column", ["value"], name="code")


def label_encode(df: DataFrame, columns: Sequence[str],
                 maps: DataFrame | None = None, plain: bool = False) -> DataFrame:
    """Replace each column by its code (bigint), in place.

    The codes (``maps``, or :func:`label_maps` of this table) are a distributed
    table that is joined per column, broadcast where its rows and bytes are few: Spark
    can't tell its size from the plan and would shuffle the rows by value.
    ``plain`` compares a text column of at most ``PLAIN_CODES`` codes with their values instead,
    for results that are scanned often: each scan would join again.
    A value that ``maps`` does not know becomes NULL.
    """
    cols = validate_columns(df, columns)
    if maps is None:
        maps = label_maps(df, cols)
    rows, size = maps.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("value") + 16), F.lit(0))).first()
    small = rows <= BROADCAST_MAX_ROWS and size <= BROADCAST_MAX_BYTES
    few = _few_codes(df, maps, cols) if plain and rows <= PLAIN_CODES * len(cols) else {}
    out = df
    for i, n in enumerate(cols):
        if n in few:
            label, code = _as_label(df, n), F.lit(None).cast("long")
            for value, number in few[n].items():
                code = F.when(label == value, F.lit(number)).otherwise(code)
            out = out.withColumn(f"__c{i}", code)
            continue
        m = maps.where(F.col("column") == n).select(
            F.col("value").alias(f"__v{i}"), F.col("code").alias(f"__c{i}"))
        out = out.join(F.broadcast(m) if small else m, _as_label(out, n) == F.col(f"__v{i}"), "left")
    return out.select(*[F.col(f"__c{cols.index(f.name)}").cast("long").alias(f.name) if f.name in cols else C.c(f.name)
                        for f in df.schema.fields])


def _few_codes(df: DataFrame, maps: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, int]]:
    """Codes by value of the text columns that have few; a value with several codes stays a row for each, by join."""
    found = maps.select("column", "value", "code").where(F.col("value").isNotNull()).collect()
    out = {}
    for n in columns:
        own = [r for r in found if r["column"] == n]
        codes = {r["value"]: r["code"] for r in own}
        if len(codes) == len(own) <= PLAIN_CODES and isinstance(C.field(df, n).dataType, T.StringType):
            out[n] = codes
    return out


class LabelEncoder:
    """Label codes as a fit/apply step: the code table is a DataFrame, so that it can be saved, loaded and
    joined to new data and to streams; nothing is collected."""

    def __init__(self, columns: Sequence[str], maps: DataFrame):
        self.columns, self.maps = list(columns), maps

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> LabelEncoder:
        cols = validate_columns(df, columns)
        return cls(cols, label_maps(df, cols))

    def transform(self, df: DataFrame) -> DataFrame:
        return label_encode(df, self.columns, self.maps)

    def save(self, path: str) -> None:
        self.maps.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> LabelEncoder:
        maps = spark.read.parquet(path)
        names = [r[0] for r in maps.select("column").distinct().collect()]  # one row per column
        return cls(sorted(names), maps)


# ---------------------------------------------------------------- E2, E3

def cardinality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, unique, allowed)``: distinct non-missing values per column
    and whether one-hot accepts it (E3)."""
    cols = validate_columns(df, columns)
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("column"), C.c(n).cast("string").alias("value")) for n in cols])))
    u = long.where(F.col("value").isNotNull()).distinct() \
        .groupBy("column").agg(F.count(F.lit(1)).alias("unique"))
    meta = df.sparkSession.createDataFrame([(n,) for n in cols], "column string")
    return meta.join(F.broadcast(u), "column", "left").select(
        "column", F.coalesce("unique", F.lit(0)).cast("long").alias("unique"),
        (F.coalesce("unique", F.lit(0)) <= ONEHOT_MAX_DISTINCT).alias("allowed"))


def _dummy_suffix(v) -> str:
    if isinstance(v, float) and v.is_integer():
        return repr(v)
    return str(v)


@dataclass
class OneHot:
    """Sorted categories per column; the first is dropped (reference layout)."""
    categories: dict[str, list]
    drop_first: bool = True

    def output_names(self) -> dict[str, list[str]]:
        return {n: [f"{n}_{_dummy_suffix(v)}" for v in (vs[1:] if self.drop_first else vs)]
                for n, vs in self.categories.items()}

    def transform(self, df: DataFrame) -> DataFrame:
        keep = [C.c(f.name) for f in df.schema.fields if f.name not in self.categories]
        dummies = []
        for n, vs in self.categories.items():
            dt = C.field(df, n).dataType
            for v in (vs[1:] if self.drop_first else vs):
                dummies.append(F.coalesce(C.c(n) == F.lit(v).cast(dt), F.lit(False))
                               .cast("int").alias(f"{n}_{_dummy_suffix(v)}"))
        return df.select(*keep, *dummies)


def fit_onehot(df: DataFrame, columns: Sequence[str], drop_first: bool = True,
               max_distinct: int = ONEHOT_MAX_DISTINCT) -> OneHot:
    """Distinct typed values of all columns in one distributed pass.
    Columns over ``max_distinct`` values are rejected with their counts, so at
    most ``max_distinct`` values per column ever reach the driver."""
    from tabforge.operators.profile import value_counts_long
    cols = validate_columns(df, columns)
    vc = value_counts_long(df, cols).select("column", "i", "d", "s").persist()
    try:
        card = {r["column"]: r["n"] for r in
                vc.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
        bad = [f"{n} ({card.get(n, 0)} unique values)" for n in cols if card.get(n, 0) > max_distinct]
        if bad:
            raise ValueError("Cannot One-Hot encode high cardinality columns: " + ", ".join(bad)
                             + f". One-Hot encoding accepts at most {max_distinct} unique values;"
                             " use Label Encoding or drop these columns.")
        cats: dict[str, list] = {n: [] for n in cols}
        for r in vc.collect():  # bounded: at most max_distinct rows per column
            dt = C.field(df, r["column"]).dataType
            cats[r["column"]].append(C.from_key(next(v for v in (r["i"], r["d"], r["s"]) if v is not None), dt))
    finally:
        vc.unpersist()
    return OneHot({n: sorted(v) for n, v in cats.items()}, drop_first)


def onehot_encode(df: DataFrame, columns: Sequence[str], drop_first: bool = True) -> DataFrame:
    return fit_onehot(df, columns, drop_first).transform(df)

