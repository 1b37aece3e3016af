"""CSV ingestion with the reference's parsing rules.

* S1  the file name must end in ``.csv``; first line is the header.
* S2  UTF-8, else latin-1: Spark's CSV reader does not fail on bad UTF-8
      (it yields U+FFFD), so validity is checked first with one aggregate.
* S3  missing-value tokens become NULL, then each column gets the first type
      in bigint, double, boolean that parses every non-missing value, else
      string. One aggregate decides all columns.
      A number that does not fit the type counts as not parsing.
* S4  a blank header is named ``Unnamed: <position>`` and duplicate header names are renamed ``a, a.1, a.2`` (the reference's
      library convention) instead of Spark's ``a0, a1``.
* S5  a table without rows or columns is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.functions.cols import q

# The reference's library treats these cell texts as missing.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# Texts read as booleans (case variants the reference's library accepts).
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")
ENCODINGS = ("UTF-8", "ISO-8859-1")


def scan_text(spark: SparkSession, path: str) -> tuple[str, bool]:
    """S2 encoding ('UTF-8' if every line is valid UTF-8, else 'ISO-8859-1'), and
    whether a quoted cell may hold a line end (a line with an odd number of
    quotes). Only then the reader has to parse each file as a whole, one task
    per file; folders of part files stay parallel."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    row = spark.read.text(path).agg(F.bool_and(F.is_valid_utf8("value")).alias("ok"),
                                    F.count_if(F.pmod(quotes, F.lit(2)) == 1).alias("odd")).first()
    return ("UTF-8" if row["ok"] in (True, None) else "ISO-8859-1"), row["odd"] > 0


def detect_encoding(spark: SparkSession, path: str) -> str:
    return scan_text(spark, path)[0]


def _reader(spark: SparkSession, encoding: str, multi_line: bool):
    """Quotes inside quoted cells are doubled, a backslash is an ordinary sign, blanks stay."""
    return (spark.read.option("encoding", encoding).option("quote", '"').option("escape", '"').option("inferSchema", False)
            .option("multiLine", multi_line).option("mode", "PERMISSIVE"))


def _header(spark: SparkSession, path: str, encoding: str, multi_line: bool) -> list[str]:
    """Header cells as written (the CSV reader decodes with the right charset)."""
    first = _reader(spark, encoding, multi_line).option("header", False).csv(path).first()
    return [] if first is None else [f"Unnamed: {i}" if v is None or v == "" else v for i, v in enumerate(first)]


def dedupe_names(names: list[str]) -> list[str]:
    """``a, a`` -> ``a, a.1`` (numbering per repeated name)."""
    seen: dict[str, int] = {}
    out = []
    used = set()
    for n in names:
        if n not in seen and n not in used:
            seen[n] = 0
            out.append(n)
            used.add(n)
            continue
        k = seen.get(n, 0)
        while True:
            k += 1
            cand = f"{n}.{k}"
            if cand not in used:
                break
        seen[n] = k
        out.append(cand)
        used.add(cand)
    return out


# decimal numbers as the reference's library reads them; Java suffixes (12d, 7f) are text
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$|^\s*[+-]?(?i:inf|infinity)\s*$"


def _cell_counts(df: DataFrame, names: list[str], more: list = ()) -> dict[int, dict]:
    """Per column number, how many of its cells are present (n) and fail as bigint (i), double (d), boolean (b).

    One pass over the cells as rows: the checks are compiled once, not once per column, whatever the table's width.
    A cell that is a bigint needs no further look. ``more`` are structs (-1 - k, text) whose texts are only counted.
    """
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(q(n)).alias("x")) for i, n in enumerate(names)], *more)))
    present, digits = F.col("x").isNotNull(), F.length(F.trim("x"))
    whole = F.coalesce(F.col("x").rlike(r"^\s*[+-]?[0-9]+\s*$"), F.lit(False))
    # casts that fail are costly, so only numbers that may not fit are tried
    cells = cells.select("i", "x", whole.alias("whole"), (whole & ((digits <= 18) | F.expr("try_cast(trim(x) as bigint)").isNotNull())).alias("fits"))
    other = present & ~F.col("fits")
    # a whole number beyond 64 bits stays text, as the reference keeps its digits
    rows = cells.groupBy("i").agg(F.count("x").alias("n"), F.count(F.lit(1)).alias("rows"), F.count_if(other).alias("i_"),
                                  F.count_if(other & (F.col("whole") | ~F.col("x").rlike(_NUMBER))).alias("d"),
                                  F.count_if(present & (F.col("fits") | ~F.col("x").isin(*TRUE_TOKENS, *FALSE_TOKENS))).alias("b"))
    return {r["i"]: {"n": r["n"], "rows": r["rows"], "i": r["i_"], "d": r["d"], "b": r["b"]} for r in rows.collect()}


def _typed(df: DataFrame, names: list[str], counts: dict[int, dict]) -> DataFrame:
    out = []
    for i, n in enumerate(names):
        x, row = F.col(q(n)), counts.get(i, {"n": 0})
        if row["n"] == 0:
            out.append(x.cast("double").alias(n))  # all missing: a float column of NaN upstream
        elif row["i"] == 0:
            out.append(F.trim(x).cast("long").alias(n))
        elif row["d"] == 0:
            out.append(F.expr(f"try_cast(trim({q(n)}) as double)").alias(n))
        elif row["b"] == 0:
            out.append(x.isin(*TRUE_TOKENS).alias(n))
        else:
            out.append(x.alias(n))
    return df.select(*out)


def infer_types(df: DataFrame) -> DataFrame:
    """S3: cast string columns to bigint / double / boolean where every
    non-missing value parses; one aggregate over the table decides."""
    return _typed(df, df.columns, _cell_counts(df, df.columns))


def read_csv(spark: SparkSession, path: str, encoding: str | None = None,
             na_tokens: tuple[str, ...] = NA_TOKENS, infer: bool = True) -> DataFrame:
    """Read one CSV file (or a folder of CSV parts) the way the reference does.

    Two passes before the data: the text (encoding, quoted line ends), then one
    aggregate for emptiness, surplus fields and types. A row with more fields
    than the header is an error; missing ones are NULL.
    """
    if not path.lower().rstrip("/").endswith(".csv"):
        raise ValueError("Please upload a CSV file")
    found, multi_line = scan_text(spark, path)
    enc = encoding or found
    names = dedupe_names(_header(spark, path, enc, multi_line))
    if not names:
        raise ValueError("The file has no columns")
    record = "record"
    while record in names:
        record += "_"
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, record]])
    raw = _reader(spark, enc, multi_line).option("header", True).option("enforceSchema", True).option(
        "columnNameOfCorruptRecord", record).schema(schema).csv(path)
    # the text of a row with more or fewer fields than the header; separators are counted outside of quotes
    fields = F.regexp_count(F.regexp_replace(q(record), '"[^"]*"', ""), F.lit(",")) + 1
    nulls = raw.select(*[F.when(F.col(q(n)).isin(*na_tokens), F.lit(None)).otherwise(F.col(q(n))).alias(n)
                         for n in names], F.when(fields > len(names), F.col(q(record))).alias(record))
    counts = _cell_counts(nulls, names if infer else [], [F.struct(F.lit(-1).alias("i"), F.col(q(record)).alias("x"))])
    if not counts:
        raise ValueError("The file has no data rows")
    if counts[-1]["n"]:
        raise ValueError(f"{counts[-1]['n']} rows have more than the header's {len(names)} fields")
    nulls = nulls.drop(record)
    return _typed(nulls, names, counts) if infer else nulls
