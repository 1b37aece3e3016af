"""Packing documents into fixed-length token sequences by cutting-stock column generation.

``pieces`` tokenizes documents (ids, then the end id) and cuts each into runs
of the capacity and one remainder. ``plan`` sees only the histogram of piece
lengths in units of 16 tokens (at most 128 bins, whatever the corpus): a linear
program over cutting patterns, whose columns a knapsack dynamic program prices,
is rounded down and the rest is packed best-fit. ``pack`` ranks the pieces of
each bin, so that a piece finds its pattern, its copy of the pattern and its
place there by arithmetic; no list of documents leaves the executors.

Defined results: a NULL or empty text is the end id alone; repeated rows are
packed once each; an empty table gives no rows; other columns are ignored. A
sequence is padded to the capacity, except where its length is a power of two.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabforge.llm.common import cut, documents, mapped, slices
from tabforge.llm.tokens import encoder

CAPACITY, END_ID, UNIT = 2048, 1, 16

_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, {ids}"
           "block int, bin int, rank long")


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
           unit: int = UNIT, with_ids: bool = False) -> DataFrame:
    """One row per piece, with its length bin and its rank in the bin within its block (task); ``with_ids``
    adds the ids themselves, ``ids_crc32`` is their checksum."""
    schema = _SCHEMA.format(ids="ids array<long>, " if with_ids else "")

    def run(batches):
        enc, block, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity // unit + 1, np.int64)
        end = np.array([end_id], np.uint32)
        for rows, _, _ in slices(batches):
            out = {c: [] for c in ("at", "start", "length", "crc", "total", "ids")}
            for i, ids in enumerate(enc.encode([t or "" for t in rows.column("text").to_pylist()])):
                ids = np.concatenate([ids, end]).astype("<u4")
                for s in range(0, len(ids), capacity):
                    part = ids[s:s + capacity]
                    for k, v in (("at", i), ("start", s), ("length", len(part)), ("crc", zlib.crc32(part.tobytes())),
                                 ("total", len(ids)), ("ids", part)):
                        out[k].append(v)
            bins = -(-np.asarray(out["length"], np.int64) // unit)
            rank = seen[bins] + pd.Series(bins).groupby(bins).cumcount().to_numpy()
            seen += np.bincount(bins, minlength=len(seen))
            n = len(bins)
            cols = [rows.column("doc_id").take(pa.array(out["at"], pa.int64())).cast(pa.int64())]
            cols += [pa.array(out[k], pa.int64()) for k in ("start", "length", "crc", "total")]
            if with_ids:
                cols.append(pa.array([p.astype(np.int64) for p in out["ids"]], pa.list_(pa.int64())))
            cols += [pa.array(np.full(n, block, np.int32)), pa.array(bins.astype(np.int32)), pa.array(rank)]
            yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in schema.split(", ")])

    return mapped(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, schema)


# ------------------------------------------------------------------ the plan, over a histogram of bounded size

def knapsack(sizes: np.ndarray, worth: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Most worth of pieces that fit in ``room``, and how many of each."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        n = int(np.searchsorted(sizes, c, side="right"))
        if n:
            v = best[c - sizes[:n]] + worth[:n]
            j = int(v.argmax())
            if v[j] > best[c - 1]:
                best[c], took[c] = v[j], j
                continue
        best[c] = best[c - 1]
    count, c = np.zeros(len(sizes)), room
    while c > 0:
        j = took[c]
        if j < 0:
            c -= 1
        else:
            count[j] += 1
            c -= sizes[j]
    return best[room], count


def relax(sizes: np.ndarray, need: np.ndarray, room: int, gap: float = 1e-3,
          rounds: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """Basis of patterns (columns) and their amounts that solve the linear program of fewest sequences.

    Ends when no pattern prices above one, or when the amount is within ``gap`` of the lower bound that the
    prices give; ``rounds`` guards against cycling. Any basis it ends with holds all pieces.
    """
    basis = np.diag((room // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    x, bound = inverse @ need, 0.0
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        worth, column = knapsack(sizes, prices, room)
        bound = max(bound, float(prices @ need) / max(worth, 1.0))
        if worth <= 1 + 1e-9 or x.sum() <= bound * (1 + gap):
            break
        d = inverse @ column
        rises = d > 1e-9
        ratio = np.where(rises, x / np.where(rises, d, 1.0), np.inf)
        r = int(ratio.argmin())
        x = np.maximum(x - ratio[r] * d, 0)
        x[r] = ratio[r]
        pivot = inverse[r] / d[r]
        inverse -= np.outer(d, pivot)
        inverse[r] = pivot
        basis[:, r] = column
    return basis, x


def plan(sizes: np.ndarray, need: np.ndarray, room: int) -> list[tuple[int, dict[int, int]]]:
    """(copies, {size: pieces}) patterns that hold all ``need`` pieces of each of the ascending ``sizes``."""
    if not len(sizes):
        return []
    basis, x = relax(sizes, need.astype(float), room)
    left, out = need.astype(np.int64).copy(), []
    for j in np.argsort(-x, kind="stable"):
        used = basis[:, j].astype(np.int64)
        copies = min(int(x[j] + 1e-6), *(int(left[i] // used[i]) for i in np.flatnonzero(used)))
        if copies > 0:
            out.append((copies, {int(sizes[i]): int(used[i]) for i in np.flatnonzero(used)}))
            left -= copies * used
    # what rounding leaves is at most a pattern's worth for each bin: largest first into the fullest that takes it
    open_: list[list] = []
    for i in np.flatnonzero(left)[::-1]:
        for _ in range(int(left[i])):
            fits = [o for o in open_ if o[0] >= sizes[i]]
            o = min(fits, key=lambda o: o[0], default=None)
            if o is None:
                open_.append(o := [room, {}])
            o[0] -= int(sizes[i])
            o[1][int(sizes[i])] = o[1].get(int(sizes[i]), 0) + 1
    return out + [(1, o[1]) for o in open_]


def seats(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each size: first rank, first sequence and pieces a sequence of each pattern that uses it."""
    table: dict[int, list] = {}
    done: dict[int, int] = {}
    sequence = 0
    for copies, used in patterns:
        for size, n in used.items():
            table.setdefault(size, []).append((done.get(size, 0), sequence, n))
            done[size] = done.get(size, 0) + copies * n
        sequence += copies
    return {size: tuple(np.array(c, np.int64) for c in zip(*rows)) for size, rows in table.items()}


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
         unit: int = UNIT, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and gapless ``offset``."""
    parts = cut(pieces(docs, tokenizer, capacity, end_id, unit, with_ids))
    counts = parts.groupBy("block", "bin").agg(F.count("*").alias("n"))
    histogram = counts.groupBy("bin").agg(F.sum("n").alias("n")).toPandas().sort_values("bin")  # 128 rows at most
    table = seats(plan(histogram["bin"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64), capacity // unit))
    before = counts.withColumn("before", F.sum("n").over(
        Window.partitionBy("bin").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = parts.join(before.select("block", "bin", F.coalesce("before", F.lit(0)).alias("before")), ["block", "bin"])

    def seat(batches):
        for b in batches:
            if not b.num_rows:
                continue
            bins, rank = b.column("bin").to_numpy(), b.column("rank").to_numpy() + b.column("before").to_numpy()
            sequence = np.empty(len(bins), np.int64)
            for size in np.unique(bins):
                first, base, n = table[int(size)]
                at = np.flatnonzero(bins == size)
                j = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at] = base[j] + (rank[at] - first[j]) // n[j]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(sequence), pa.array(rank)],
                                             names=[*keep, "sequence_id", "r"])

    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin"] + ["ids"] * with_ids
    kinds = dict(parts.dtypes)
    seated = mapped(
        ranked.select(*keep, "rank", "before"), seat, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", sequence_id long, r long")
    order = Window.partitionBy("sequence_id").orderBy(F.desc("bin"), "r").rowsBetween(Window.unboundedPreceding, -1)
    return seated.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0))).drop("bin", "r")


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(documents(spark, sf), default_tokenizer())


QUERIES = {"op10_packing": op10_packing}
SQL: dict[str, str] = {}
