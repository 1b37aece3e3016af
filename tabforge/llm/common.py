"""Helpers shared by the operators of this package.

Identity of a document: ``(doc_id, th)`` with ``th`` the 64-bit hash of its
text. Rows that repeat both are the same document; rows that share only the
doc_id are different documents, ordered by ``th``. A NULL doc_id sorts first.

Texts reach Python as Arrow batches. ``slices`` cuts them into pieces of a few
MB so that numpy temporaries stay small however many rows a batch has; a
piece always holds whole documents.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.session import ensure_checkpoint_dir

PIECE = 1 << 20  # bytes of text that a numpy step handles at once

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
FEW = 1 << 17  # rows of a few numbers that are broadcast at most: some MB
U64 = np.uint64
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
SPACES = [32, 9, 10, 11, 12, 13]  # fixed values: [\x20\x09-\x0D]


def documents(spark: SparkSession, sf: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ready(df: DataFrame) -> DataFrame:
    """Let Python workers find this package where it is on the driver too (clusters that ship or install it lose
    nothing), and bound the bytes of an Arrow batch where the session doesn't."""
    paths = df.sparkSession.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root not in paths.get("PYTHONPATH", "").split(os.pathsep):
        paths["PYTHONPATH"] = os.pathsep.join(filter(None, [root, paths.get("PYTHONPATH")]))
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES, None) is None:  # else 10,000 texts of any length come at once
        conf.set(BATCH_BYTES, str(PIECE))
    return df


def mapped(df: DataFrame, run, schema) -> DataFrame:
    return ready(df).mapInArrow(run, schema)


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, th, text (and ``more``) of ``docs``; whatever else it has stays out."""
    return docs.select("doc_id", text_hash().alias("th"), F.col("text").cast("string").alias("text"), *more)


def text_hash():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("text").isNull())


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint (``spark.checkpoint.dir``). Shuffle files that only served to make it
    go at once, not when the driver happens to collect its garbage."""
    ensure_checkpoint_dir(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own: ``df`` keeps its files if it has run
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)


def few(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` (checkpointed, narrow), to be broadcast where it has at most ``FEW`` rows."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= FEW else df


def crc_mod(n: int):
    """crc32 of the doc_id as text (NULL: empty text) modulo n."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


# ------------------------------------------------------------------ texts in numpy

def slices(batches, limit: int = PIECE):
    """Yield record batches of about ``limit`` bytes of ``text`` (NULL as empty) with its bytes and offsets."""
    for batch in batches:
        i = batch.schema.get_field_index("text")
        text = batch.column(i)
        text = (pc.fill_null(text, "") if text.null_count else text).cast(pa.large_string())
        if not len(text):
            continue
        offs = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset:text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2], dtype=np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
        start, n = 0, len(text)
        while start < n:
            end = int(np.searchsorted(offs, offs[start] + limit, side="right")) - 1
            end = min(n, max(end, start + 1))
            yield batch.slice(start, end - start), data[offs[start]:offs[end]], offs[start:end + 1] - offs[start]
            start = end


def is_word(not_in: list[int]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[not_in] = False
    return table


SPACED = is_word(SPACES)
#: fixed values: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing
ALNUM = is_word([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def spans(data: np.ndarray, offs: np.ndarray, table: np.ndarray):
    """Starts and ends of the words of lower-cased ``data``, and words before each document."""
    inside = table[data]
    if not inside.any():
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offs[(offs > 0) & (offs < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n pseudo-random uint64 of a seed."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + U64(seed) * U64(0x1000003)) * U64(0x9E3779B97F4A7C15))


_BYTES = stream(256, 11)
_PLACES: dict[int, np.ndarray] = {}


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span (the same bytes always give the same hash)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    top = 1 << max(6, int(size.max() - 1).bit_length())
    if top not in _PLACES:
        _PLACES[top] = stream(top, 12) | U64(1)
    before = np.cumsum(size) - size
    place = np.arange(int(size.sum()), dtype=np.int64)
    at = place + np.repeat(starts - before, size)
    place -= np.repeat(before, size)
    return mix(np.add.reduceat(_BYTES[data[at]] * _PLACES[top][place], before) + size.astype(np.uint64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (across documents too; mask those)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    odd = stream(k, 13) | U64(1)
    out = words[:n] * odd[0]
    for j in range(1, k):
        out = out + words[j:n + j] * odd[j]
    return mix(out)


def within(n_grams: int, before: np.ndarray, k: int) -> np.ndarray:
    """Which gram starts leave k words inside one document."""
    ok = np.ones(n_grams, dtype=bool)
    for j in range(1, k):
        edge = before[1:-1] - j
        ok[edge[(edge >= 0) & (edge < n_grams)]] = False
    return ok


# ------------------------------------------------------------------ a filter of fixed size

def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bitmap over the top ``bits`` bits of the long column ``h``; 2**bits / 8 bytes whatever the input.

    It only saves shuffling rows that cannot join: a false positive costs a row, never a result.
    """
    slot = F.shiftrightunsigned("h", 64 - bits)
    words = hashes.select(slot.alias("s")).groupBy(F.shiftright("s", 5).cast("int").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(s & 31 as int))")).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 5), dtype=np.uint32)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().astype(np.uint32)
    return out


def in_bitmap(bitmap_: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    slot = hashes >> U64(64 - bits)
    return (bitmap_[(slot >> U64(5)).astype(np.int64)] >> (slot & U64(31)).astype(np.uint32)) & np.uint32(1) != 0
