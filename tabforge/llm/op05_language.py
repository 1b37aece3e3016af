"""Language identification: multinomial naive Bayes over hashed character n-grams.

``train`` counts the hashed 1- to 3-grams of all labelled texts, per language,
as Spark sums; the smoothed log-probability matrix (languages x 2**15 float32)
is the only thing that reaches the driver and is broadcast: 128 KB a language,
with at most ``MAX_LANGUAGES`` of them, else an error. ``predict`` scores
batches by gathering matrix rows and summing them per document.

Defined results: a NULL text or one without a letter is ``und`` with score 0,
as is every text when no labelled text was seen; repeated rows are scored
alike; NULL labels are not learned; an empty table gives no rows; other columns
are ignored. ``score`` is the posterior of the predicted language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.llm.common import U64, crc_mod, documents, mapped, mix, slices

BITS, ORDERS, MAX_LANGUAGES = 15, (1, 2, 3), 4096
UNKNOWN = "und"


def buckets(texts: pa.Array, bits: int, orders: tuple[int, ...]):
    """For each n-gram order, the bucket of every n-gram and the gram offsets of the documents."""
    low = pc.utf8_lower(texts)
    offs = np.concatenate([[0], np.cumsum(pc.utf8_length(low).to_numpy(zero_copy_only=False))]).astype(np.int64)
    cps = np.frombuffer("".join(low.to_pylist()).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    for n in orders:
        if len(cps) < n:
            yield np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
            continue
        h = cps[:len(cps) - n + 1] + U64(n << 56)
        for j in range(1, n):
            h = h * U64(0x9E3779B97F4A7C15) + cps[j:len(cps) - n + 1 + j]
        slot = (mix(h) >> U64(64 - bits)).astype(np.int64)
        inside = np.maximum(np.diff(offs) - (n - 1), 0)  # grams of each document; the others cross an edge
        if n > 1:
            ok = np.ones(len(slot), dtype=bool)
            for j in range(1, n):
                edge = offs[1:-1] - j
                ok[edge[(edge >= 0) & (edge < len(ok))]] = False
            slot = slot[ok]
        yield slot, np.concatenate([[0], np.cumsum(inside)])


def train(docs: DataFrame, bits: int = BITS, orders: tuple[int, ...] = ORDERS):
    """(languages, log-probability matrix, log prior) from the text and lang of ``docs``; None if nothing is labelled."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for rows, _, _ in slices(batches):
            lang = rows.column("lang").dictionary_encode()
            names, code = lang.dictionary.to_pylist(), lang.indices.to_numpy()
            sums = np.zeros((len(names), (1 << bits) + 1), np.int64)
            sums[:, -1] = np.bincount(code, minlength=len(names))
            for slot, offs in buckets(pc.fill_null(rows.column("text"), ""), bits, orders):
                at = np.repeat(code.astype(np.int64), np.diff(offs)) * sums.shape[1] + slot
                sums += np.bincount(at, minlength=sums.size).reshape(sums.shape)
            for name, s in zip(names, sums):
                total[name] = total.get(name, 0) + s
        for name, s in total.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(s[at])], names=["lang", "slot", "n"])

    sums = mapped(docs.where("lang is not null").select(F.col("text").cast("string").alias("text"), "lang"),
                  run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    rows = sums.toArrow()  # at most 2**bits + 1 rows a language
    names = sorted(pc.unique(rows.column("lang")).to_pylist())
    if not names:
        return None
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"{len(names)} languages; the broadcast matrix is meant for {MAX_LANGUAGES} at most")
    counts = np.zeros((len(names), (1 << bits) + 1))
    at = {x: i for i, x in enumerate(names)}
    counts[[at[x] for x in rows.column("lang").to_pylist()], rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    grams, n_docs = counts[:, :-1] + 0.5, counts[:, -1]
    matrix = np.log(grams) - np.log(grams.sum(axis=1, keepdims=True))
    return names, matrix.astype(np.float32), np.log(n_docs / n_docs.sum())


def predict(docs: DataFrame, model, *carry: str, bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """``carry`` columns, lang_pred and score of each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import regex
        letter = regex.compile(r"\p{L}").search
        for rows, _, _ in slices(batches):
            text = pc.fill_null(rows.column("text"), "")
            names, score = [UNKNOWN] * len(text), np.zeros(len(text))
            if shared.value is not None:
                langs, matrix, prior = shared.value
                total = np.tile(prior, (len(text), 1))
                for slot, offs in buckets(text, bits, orders):
                    some = np.flatnonzero(np.diff(offs))
                    if len(some):
                        for k in range(len(langs)):
                            total[some, k] += np.add.reduceat(matrix[k][slot], offs[some], dtype=np.float64)
                best = total.argmax(axis=1)
                score = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                known = np.array([letter(t) is not None for t in text.to_pylist()], dtype=bool)
                score[~known] = 0.0
                names = [langs[b] if ok else UNKNOWN for b, ok in zip(best, known)]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in carry), pa.array(names, pa.string()), pa.array(score)],
                                             names=[*carry, "lang_pred", "score"])

    rows = docs.select(F.col("text").cast("string").alias("text"), *carry)
    schema = T.StructType([rows.schema[c] for c in carry]).add("lang_pred", "string").add("score", "double")
    return mapped(rows, run, schema)


def op5_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Learns from the documents whose crc32 remainder is not 2, predicts all."""
    docs = documents(spark, sf).withColumn("held_out", crc_mod(4) == 2)
    return predict(docs, train(docs.where("not held_out")), "doc_id", "held_out")


QUERIES = {"op5_language_id": op5_language_id}
SQL: dict[str, str] = {}
