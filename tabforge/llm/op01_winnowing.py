"""Benchmark decontamination by winnowing.

Of every six consecutive 8-word hashes the smallest is a fingerprint, so any 13
words that a document shares with a benchmark item share a fingerprint too.
Fingerprints of items fill a bitmap of fixed size that documents test before
anything is shuffled; those that pass are joined by hash and every hit is
extended word by word to both sides. A hit counts where at least 13 words
agree; items of fewer words are one window, found by all word runs of their
length. Words are compared as text, so hashes never decide.

Defined results: NULL and empty texts have no words and no hits; items without
words never occur; repeated item rows count once; an item with a NULL id is
listed as an empty id; repeated document rows get a row each; empty tables give
no hits or no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm.common import (
    ALNUM, ASCII_LOWER, U64, bitmap, cut, documents, gram_hashes, in_bitmap, keyed, mapped, mix, slices, spans, within,
    word_hashes,
)

WINDOW, GRAM, BITS = 13, 8, 22
BROADCAST_BYTES = 32 << 20  # a larger benchmark is joined by shuffles
_FOUND = "array<struct<size:int,h:long,at:long,left:int,words:string>>"


def fingerprints(rows: DataFrame, carry: list[str], window: int, short: list[int], filter_=None,
                 every: bool = False) -> DataFrame:
    """``carry``, n_words and the fingerprints of each row's text: hash, first word, and the words around it.

    Texts of fewer than ``window`` words yield one fingerprint, their whole, if ``every`` (items); of documents,
    all word runs of the lengths in ``short`` are tested.
    """
    k = min(GRAM, window)

    def run(batches):
        for part, data, offs in slices(batches):
            data = ASCII_LOWER[data]
            starts, ends, before = spans(data, offs, ALNUM)
            words, n_words = word_hashes(data, starts, ends), np.diff(before)
            found = []
            grams = gram_hashes(words, k)
            if len(words) >= window:
                n = len(words) - window + 1
                best, at = grams[:n].copy(), np.arange(n)
                for j in range(1, window - k + 1):
                    less = grams[j:n + j] < best
                    best[less], at[less] = grams[j:n + j][less], (np.arange(n) + j)[less]
                at = np.unique(at[within(n, before, window)])
                found.append((window, at, mix(grams[at] + U64(window))))
            for size in short:
                h = gram_hashes(words, size)
                at = np.flatnonzero(within(len(h), before, size))
                if every:
                    at = at[np.isin(at, before[:-1][n_words == size])]
                found.append((size, at, mix(h[at] + U64(size))))
            out: list[list] = [[] for _ in range(len(offs) - 1)]
            for size, at, h in found:
                if filter_ is not None and len(h):
                    ok = in_bitmap(filter_.value, h, BITS)
                    at, h = at[ok], h[ok]
                for p, d, x in zip(at.tolist(), (np.searchsorted(before, at, side="right") - 1).tolist(), h.view(np.int64).tolist()):
                    lo, hi = (max(p - window + k, before[d]), min(p + window, before[d + 1])) if size == window else (p, p + size)
                    text = b" ".join(data[a:b].tobytes() for a, b in zip(starts[lo:hi], ends[lo:hi])).decode()
                    out[d].append((size, x, p - before[d], p - lo, text))
            kind = pa.list_(pa.struct([("size", pa.int32()), ("h", pa.int64()), ("at", pa.int64()), ("left", pa.int32()), ("words", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in carry), pa.array(n_words, pa.int64()),
                 pa.array([[dict(zip(("size", "h", "at", "left", "words"), x)) for x in xs] for xs in out], kind)],
                names=[*carry, "n_words", "found"])

    kinds = dict(rows.dtypes)
    return mapped(rows.select("text", *carry), run, "".join(f"{c} {kinds[c]}, " for c in carry) + f"n_words long, found {_FOUND}")


def extend(pairs: DataFrame, window: int) -> DataFrame:
    """rid, item and the document words [lo, hi) that a joined pair of fingerprints really shares, if a window."""

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                mine, its = r["words"].split(" "), r["i_words"].split(" ")
                if r["size"] < window:
                    if mine == its:
                        out.append((r["rid"], r["item"], r["at"], r["at"] + r["size"]))
                    continue
                i, j = r["left"], r["i_left"]
                lo = 0
                while lo < min(i, j) and mine[i - lo - 1] == its[j - lo - 1]:
                    lo += 1
                hi = 0
                while i + hi < len(mine) and j + hi < len(its) and mine[i + hi] == its[j + hi]:
                    hi += 1
                if hi >= min(GRAM, window) and lo + hi >= window:
                    out.append((r["rid"], r["item"], r["at"] - lo, r["at"] + hi))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                                             names=["rid", "item", "lo", "hi"])

    return mapped(pairs, run, "rid long, item string, lo long, hi long")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, th, n_words, n_hit (words inside an occurring window), the items that occur and the hit spans."""
    wanted = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                          F.col("text").cast("string").alias("text"))
    sized = cut(fingerprints(wanted, ["item"], window, list(range(1, window)), every=True))
    short = [r[0] for r in sized.where(f"n_words between 1 and {window - 1}").select("n_words").distinct().collect()]
    keys = sized.select("item", F.inline("found")).select("item", "size", "h", F.col("left").alias("i_left"),
                                                         F.col("words").alias("i_words")).distinct()
    keys = cut(keys)
    filter_ = docs.sparkSession.sparkContext.broadcast(bitmap(keys, BITS))
    base = cut(fingerprints(keyed(docs), ["doc_id", "th"], window, sorted(short), filter_))
    base = base.withColumn("rid", F.monotonically_increasing_id())  # stable: the rows are checkpointed
    size = keys.agg(F.sum(F.octet_length("item") + F.octet_length("i_words") + 64)).first()[0] or 0
    near = F.broadcast(keys) if size <= BROADCAST_BYTES else keys
    hits = extend(base.select("rid", F.inline("found")).join(near, ["size", "h"]), window)
    union = F.expr("aggregate(spans, struct(0L as n, 0L as e), (a, x) -> struct(a.n + greatest(0L, x.hi - greatest(a.e, x.lo)) as n, "
                   "greatest(a.e, x.hi) as e), a -> a.n)")
    per = hits.groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"),
                                  F.sort_array(F.collect_set("item")).alias("items")).select("rid", "spans", "items", union.alias("n_hit"))
    return base.select("doc_id", "th", "n_words", "rid").join(per, "rid", "left").select(
        "doc_id", "th", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<lo:bigint,hi:bigint>>")).alias("spans")).withColumn(
        "contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs``, all columns, without the contaminated ones."""
    from tabforge.llm.common import text_hash
    bad = contamination(docs, items, window).where("contaminated").select(F.col("doc_id").alias("i"), F.col("th").alias("t")).distinct()
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("d"), text_hash().alias("h"))
    return whole.join(bad, F.col("d").eqNullSafe(F.col("i")) & (F.col("h") == F.col("t")), "left_anti").select("row.*")


def op1_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    out = contamination(documents(spark, sf), documents(spark, sf, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op1_decontamination": op1_decontamination}
SQL = {"op1_decontamination": r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bw as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bi as (select item, w, least(13, len(w)) as n from bw where len(w) > 0),
win as (select distinct item, n, array_to_string(w[p:p + n - 1], ' ') as g
        from (select item, w, n, unnest(range(1, len(w) - n + 2)) as p from bi)),
sizes as (select distinct n from win),
dg as (select doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') as g
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from dw, sizes where len(w) >= n)),
hit as (select doc_id, item, p, dg.n from dg join win on dg.n = win.n and dg.g = win.g),
pos as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from hit) group by 1),
its as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as s from hit group by 1)
select dw.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join pos using (doc_id) left join its using (doc_id)"""}
