"""Line dedup with a sharded minimal perfect hash over the distinct line hashes.

``line_keys`` hashes every line to 128 bits once, in blocks (tasks) of
documents. ``build_index`` sums them up per distinct hash and lays each shard
out as a minimal perfect hash with arrays for a fingerprint, the number of
documents and the first document. ``probe`` sends each block's distinct hashes,
not its lines, to the shards; a line held by a third of all documents costs a
shard one probe per block. What comes back, the positions of repeated lines in
the block, is resolved to dropped lines per document there.

Defined results: NULL and empty texts are one empty line; lines whose key has
fewer than ``min_chars`` code points stay; repeated lines in one document alone
stay; rows that repeat doc_id and text are one document; of documents that share
a doc_id the one with the smaller text hash is first; a NULL doc_id precedes all;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.llm.common import U64, cut, documents, keyed, mapped, mix, ready, slices, text_hash

MIN_CHARS, SHARD_KEYS, MIN_SHARDS, BLOCK = 10, 1 << 14, 64, 16 << 20
STRIP = " \t\n\x0b\x0c\r"  # fixed value: [\x20\x09-\x0D]
NO_ID = -(1 << 63)  # stands for a NULL doc_id, before all others


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Blocks of documents: their ids, and of each distinct eligible key in a document the hash and document."""

    def run(batches):
        task, n_blocks = TaskContext.get().partitionId(), 0

        def pack():
            h = np.frombuffer(b"".join(hashes), dtype=">u8").reshape(-1, 2)
            return pa.RecordBatch.from_arrays([
                pa.array([task << 32 | n_blocks]), pa.array([ids], pa.list_(pa.int64())), pa.array([ths], pa.list_(pa.int64())),
                pa.array([h[:, 0].astype("<u8").tobytes()]), pa.array([h[:, 1].astype("<u8").tobytes()]),
                pa.array([np.asarray(owner, np.int32).tobytes()])], names=names)

        ids, ths, hashes, owner, size = [], [], [], [], 0
        for rows, data, _ in slices(batches):
            for i, th, text in zip(rows.column("doc_id").to_pylist(), rows.column("th").to_pylist(), rows.column("text").to_pylist()):
                keys = {k for k in (x.strip(STRIP) for x in (text or "").split("\n")) if len(k) >= min_chars}
                new = {xxhash.xxh3_128_digest(k.encode().lower()) for k in keys}
                hashes += new
                owner += [len(ids)] * len(new)
                ids.append(NO_ID if i is None else i)
                ths.append(th)
            size += len(data)
            if size >= BLOCK:
                yield pack()
                n_blocks += 1
                ids, ths, hashes, owner, size = [], [], [], [], 0
        if ids:
            yield pack()

    names = ["block", "ids", "ths", "h", "g", "owner"]
    return mapped(keyed(docs), run, "block long, ids array<long>, ths array<long>, h binary, g binary, owner binary")


def _block(rows, i):
    h, g = (np.frombuffer(rows.column(c)[i].as_py(), "<u8") for c in ("h", "g"))
    ids, ths = (rows.column(c)[i].values.to_numpy() for c in ("ids", "ths"))
    return h, g, np.frombuffer(rows.column("owner")[i].as_py(), np.int32), ids, ths


def _distinct(h, g, rank):
    """Order that groups equal hashes with the smallest rank first, and the start of each group."""
    order = np.lexsort((rank, g, h))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
    return order, np.flatnonzero(new)


class PerfectHash:
    """Minimal perfect hash of uint64 pairs: levels of bit arrays, each key at the first level where it is alone."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = [np.concatenate([[0], np.cumsum(x)]) for x in levels]
        self.size = sum(int(r[-1]) for r in self.ranks)

    @staticmethod
    def slots(h, g, level: int, size: int) -> np.ndarray:
        return (mix(h + mix(g + U64(level))) % U64(size)).astype(np.int64)

    @classmethod
    def of(cls, h: np.ndarray, g: np.ndarray) -> PerfectHash:
        levels = []
        while len(h):
            at = cls.slots(h, g, len(levels), 2 * len(h) + 1)
            alone = np.bincount(at, minlength=2 * len(h) + 1) == 1
            levels.append(alone)
            h, g = h[~alone[at]], g[~alone[at]]
        return cls(levels)

    def __call__(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Index of each key that it was built from; any index or -1 for others."""
        out, rest, base = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
        for i, (level, rank) in enumerate(zip(self.levels, self.ranks)):
            at = self.slots(h[rest], g[rest], i, len(level))
            hit = level[at]
            out[rest[hit]] = base + rank[at[hit]]
            rest, base = rest[~hit], base + int(rank[-1])
        return out

    def dump(self) -> tuple[bytes, list[int]]:
        return np.packbits(np.concatenate([*self.levels, np.zeros(0, bool)])).tobytes(), [len(x) for x in self.levels]

    @classmethod
    def load(cls, bits: bytes, sizes) -> PerfectHash:
        sizes = np.asarray(sizes, np.int64)
        flat = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(sizes.sum())).astype(bool)
        return cls(np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else [])


def build_index(blocks: DataFrame, shards: int) -> DataFrame:
    """One row per shard: the minimal perfect hash of its distinct line hashes and the arrays that it indexes."""

    def sums(batches):
        for rows in batches:
            for i in range(rows.num_rows):
                h, g, owner, ids, ths = _block(rows, i)
                rank = np.lexsort((ths, ids)).argsort()[owner] if len(ids) else owner
                order, new = _distinct(h, g, rank)
                first = owner[order[new]]
                yield pa.RecordBatch.from_arrays([
                    pa.array((h[order[new]] % U64(shards)).astype(np.int32)), pa.array(h[order[new]].view(np.int64)),
                    pa.array(g[order[new]].view(np.int64)), pa.array(np.diff(new, append=len(order))),
                    pa.array(ids[first]), pa.array(ths[first])], names=["shard", "h", "g", "n", "id", "th"])

    def build(key, part):
        h, g = (part[c].to_numpy().view(np.uint64) for c in ("h", "g"))
        index = PerfectHash.of(h, g)
        at = index(h, g)
        bits, sizes = index.dump()
        arrays = {c: np.empty(len(part), np.int64) for c in ("g", "n", "id", "th")}
        for c in arrays:
            arrays[c][at] = part[c].to_numpy()
        return pd.DataFrame({"shard": [key[0]], "bits": [bits], "sizes": [sizes], "fingerprint": [arrays["g"].tobytes()],
                             "n_docs": [np.minimum(arrays["n"], 2**32 - 1).astype("<u4").tobytes()],
                             "first_id": [arrays["id"].tobytes()], "first_th": [arrays["th"].tobytes()]})

    each = mapped(blocks, sums, "shard int, h long, g long, n long, id long, th long").groupBy("shard", "h", "g").agg(
        F.sum("n").alias("n"), F.min(F.struct("id", "th")).alias("first"))
    return each.select("shard", "h", "g", "n", "first.id", "first.th").groupBy("shard").applyInPandas(
        build, "shard int, bits binary, sizes array<long>, fingerprint binary, n_docs binary, first_id binary, first_th binary")


def probe(blocks: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(doc_id, th, h, g) of the lines that the documents of ``blocks`` lose by an index of the corpus: lines in
    two documents or more whose first holder is another document."""

    def ask(batches):
        for rows in batches:
            for i in range(rows.num_rows):
                h, g, owner, ids, ths = _block(rows, i)
                order, new = _distinct(h, g, owner)
                h, g = h[order[new]], g[order[new]]
                shard = (h % U64(shards)).astype(np.int32)
                by = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(np.diff(shard[by], prepend=-1))
                part = np.split(by, cuts[1:]) if len(by) else []
                yield pa.RecordBatch.from_arrays([
                    pa.array(shard[by[cuts]], pa.int32()), pa.array([rows.column("block")[i].as_py()] * len(part), pa.int64()),
                    pa.array([h[p].tobytes() for p in part], pa.binary()), pa.array([g[p].tobytes() for p in part], pa.binary())],
                    names=["shard", "block", "h", "g"])

    def answer(key, shard, asked):
        out = []
        if len(shard):
            x = shard.iloc[0]
            find = PerfectHash.load(x.bits, x.sizes)
            print_, n, first, th = (np.frombuffer(x[c], k) for c, k in
                                    (("fingerprint", "<u8"), ("n_docs", "<u4"), ("first_id", "<i8"), ("first_th", "<i8")))
            for block, hs, gs in zip(asked.block, asked.h, asked.g):
                h, g = np.frombuffer(hs, "<u8"), np.frombuffer(gs, "<u8")
                at = find(h, g)
                ok = at >= 0
                ok[ok] = (print_[at[ok]] == g[ok]) & (n[at[ok]] >= 2)
                if ok.any():
                    out.append((block, h[ok].tobytes(), g[ok].tobytes(), first[at[ok]].tobytes(), th[at[ok]].tobytes()))
        return pd.DataFrame(out, columns=["block", "h", "g", "id", "th"])

    def settle(key, answers, own):
        out = {c: [] for c in ("doc_id", "th", "h", "g")}
        if len(answers):
            told = {c: np.concatenate([np.frombuffer(x, k) for x in answers[c]])
                    for c, k in (("h", "<u8"), ("g", "<u8"), ("id", "<i8"), ("th", "<i8"))}
            for x in own.itertuples(index=False):
                h, g = np.frombuffer(x.h, "<u8"), np.frombuffer(x.g, "<u8")
                owner = np.frombuffer(x.owner, np.int32)
                ids, ths = np.asarray(x.ids, np.int64), np.asarray(x.ths, np.int64)
                line = pd.DataFrame({"h": h, "g": g, "doc_id": ids[owner], "th": ths[owner]}).merge(
                    pd.DataFrame({"h": told["h"], "g": told["g"], "i": told["id"], "t": told["th"]}), on=["h", "g"])
                line = line[(line.doc_id != line.i) | (line.th != line.t)]
                out["doc_id"].append(line.doc_id.to_numpy()), out["th"].append(line.th.to_numpy())
                out["h"].append(line.h.to_numpy().view(np.int64)), out["g"].append(line.g.to_numpy().view(np.int64))
        return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()})

    asked = mapped(blocks, ask, "shard int, block long, h binary, g binary")
    answers = index.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(
        answer, "block long, h binary, g binary, id binary, th binary")
    return answers.groupBy("block").cogroup(blocks.groupBy("block")).applyInPandas(
        settle, "doc_id long, th long, h long, g long")


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """All columns of ``docs`` as struct ``row``, with kept text, n_lines (before) and n_dropped."""
    blocks = cut(line_keys(docs, min_chars))
    keys = blocks.agg(F.sum(F.expr("octet_length(h) div 8"))).first()[0] or 0
    shards = max(MIN_SHARDS, -(-keys // shard_keys))
    lost = probe(blocks, ready(build_index(blocks, shards)), shards)
    lost = lost.groupBy(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("_id"), F.col("th").alias("_th")).agg(
        F.collect_list(F.struct("h", "g")).alias("lost"))  # at most the lines of a document
    base = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), text_hash().alias("th"),
                       F.col("text").cast("string").alias("text"))
    both = base.join(lost, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")

    def rebuild(batches):
        for rows, _, _ in slices(batches):
            kept, before, gone = [], [], []
            for text, away in zip(rows.column("text").to_pylist(), rows.column("lost").to_pylist()):
                lines = (text or "").split("\n")
                before.append(len(lines))
                if away:
                    away = {((x["h"] % (1 << 64)) << 64 | x["g"] % (1 << 64)).to_bytes(16, "big") for x in away}
                    lines = [x for x in lines if len(k := x.strip(STRIP)) < min_chars
                             or xxhash.xxh3_128_digest(k.encode().lower()) not in away]
                gone.append(before[-1] - len(lines))
                kept.append("\n".join(lines))
            yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array(kept, pa.string()), pa.array(before, pa.int64()),
                                              pa.array(gone, pa.int64())], names=["row", "kept", "n_lines", "n_dropped"])

    schema = T.StructType([base.schema["row"]]).add("kept", "string").add("n_lines", "long").add("n_dropped", "long")
    return mapped(both.select("row", "text", "lost"), rebuild, schema)


def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = drop_lines(documents(spark, sf).select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op6_line_dedup": op6_line_dedup}
SQL = {"op6_line_dedup": r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                  unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos from documents),
k as (select *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as s from l),
c as (select *, translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from k),
f as (select key, min(doc_id) as first from c where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
m as (select c.doc_id, c.line, c.pos, f.first is not null and f.first <> c.doc_id as gone from c left join f using (key))
select doc_id, count(*) as n_lines, cast(count(*) filter (where gone) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id"""}
