"""A training corpus from raw documents: language ID, line dedup, near-dedup, decontamination, packing.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir)
and returns a DataFrame. All but the last keep the columns of documents (other
columns too). ``run`` writes each stage's result as Parquet under the folder in
``spark.checkpoint.dir`` and reads it again as the next stage's documents, so a
lost executor costs the tasks of one stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm.common import documents
from tabforge.llm.op01_winnowing import decontaminate
from tabforge.llm.op03_bagminhash import drop_near_duplicates
from tabforge.llm.op05_language import UNKNOWN, predict, train
from tabforge.llm.op06_lines import drop_lines
from tabforge.llm.op10_packing import default_tokenizer, pack
from tabforge.session import ensure_checkpoint_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all labelled documents; those without a letter (``und``) go. A NULL ``lang`` becomes the predicted
    one, others stay. Without any label there is nothing to predict: documents without a letter go, no more."""
    model = train(docs)
    if model is None:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    rows = docs.select(F.struct("*").alias("row"), "text", "lang")
    known = predict(rows, model, "row").where(F.col("lang_pred") != UNKNOWN)
    return known.select(*((F.coalesce(F.col("row.lang"), F.col("lang_pred")) if c == "lang" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; n_chars follows the text. No document goes."""
    out = drop_lines(docs)
    new = {"text": F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates (similarity 0.8 or more) stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words or more in benchmark passages go."""
    return decontaminate(docs, documents(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in sequences of 2048 tokens."""
    return pack(docs, default_tokenizer())


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("packing", packing)]
#: language ID and near-dedup are learned and hashed: SQL can't express them
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = documents(spark, sf_dir), f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
