"""Removal of long repeated byte strings by a distributed merge sort of suffixes.

Every suffix of a corpus cannot be sorted within a few times its size, so the
sort takes those that can matter. Of all 32-byte hashes in a 100-byte window
the smallest is its anchor; equal windows have equal anchors. Windows in a row
share theirs, so a document is a list of anchors with a stretch of windows each.
Stretches whose anchor hash occurs once in the corpus hold no repeat (a bitmap
of at most 128 MB keeps the hashes that occur again; a false positive costs time).

Sort 1 orders the remaining anchors' suffixes: the text from the anchor to the
end of its stretch, then the text before it backwards. Each block of documents
sorts its suffixes, keeps the first of equal ones, and exchanges front-coded
runs (common prefix length and rest), cut at sampled splitters. A range's runs
meet in a loser tree that carries the common prefix with the last output, so a
known prefix is never compared again. Equal suffixes come out in a row: all but
the first repeat it whole. An anchor with several different suffixes, which come
out in a row too, is where a match ends: its suffixes' single windows are
compared, and all but the first of equal ones are repeats. That happens in the
range where the anchor lies whole, so within the range's bounded size. An anchor
that splitters cut (one that a large part of all documents holds) goes through
Sort 2, the same sort over the 100-byte windows themselves.

Order of strings: (doc_id, text hash, position). A doc_id alone decides unless
rows share it; a NULL doc_id precedes all; rows that repeat doc_id and text are
one document. NULL and empty texts have no bytes and no spans; texts under
``length`` bytes stay whole; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm.common import U64, cut, documents, keyed, mapped, mix, slices, stream, text_hash

LENGTH, ANCHOR, MAX_BITS = 100, 32, 30  # a bitmap of 128 MB at most
RUN = 16 << 20  # bytes of text whose suffixes are sorted as one run
SAMPLE = 1 << 15  # strings that splitters are chosen from
NO_ID = -(1 << 63)
_BYTE = stream(256, 31)


# ------------------------------------------------------------------ front-coded runs and the loser tree

def common(a: bytes, b: bytes, n: int) -> int:
    """Length of the common prefix of a and b, of which n bytes are known."""
    end = min(len(a), len(b))
    while n < end and a[n:n + 16] == b[n:n + 16]:
        n += 16
    if n >= end:
        return end
    while n < end and a[n] == b[n]:
        n += 1
    return n


def front_code(keys: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Common prefix lengths, rest lengths and rests of ascending keys."""
    shared = [0, *(common(a, b, 0) for a, b in zip(keys, keys[1:]))][:len(keys)]
    rest = [k[n:] for k, n in zip(keys, shared)]
    return (np.asarray(shared, "<u2").tobytes(), np.asarray([len(r) for r in rest], "<u2").tobytes(), b"".join(rest))


def decode(shared: bytes, sizes: bytes, rests: bytes) -> Iterator[tuple[bytes, int]]:
    """The keys of a run, each with its common prefix with the one before."""
    key, at = b"", 0
    for n, size in zip(np.frombuffer(shared, "<u2").tolist(), np.frombuffer(sizes, "<u2").tolist()):
        key = key[:n] + rests[at:at + size]
        at += size
        yield key, n


def merge(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[bytes, int, int]]:
    """(key, common prefix with the last output, run) in order; of equal keys the earlier run comes first.

    A tree of losers: each inner node keeps the loser of its match and the common prefix that it has with that
    match's winner. Of two contenders that both follow the last output, the one that shares more with it is
    smaller; only on a tie are bytes compared, from that prefix on.
    """
    n = 1 << max(0, len(runs) - 1).bit_length()
    heads: list[tuple[bytes, int] | None] = [next(r, None) for r in runs] + [None] * (n - len(runs))
    key = [h[0] if h else None for h in heads]
    pre = [0] * n
    loser = [0] * n

    def match(a: int, b: int) -> tuple[int, int]:
        if key[a] is None:
            return b, a
        if key[b] is None:
            return a, b
        if pre[a] != pre[b]:
            return (a, b) if pre[a] > pre[b] else (b, a)
        p = common(key[a], key[b], pre[a])
        if (key[a][p:], a) <= (key[b][p:], b):
            pre[b] = p
            return a, b
        pre[a] = p
        return b, a

    def play(node: int) -> int:
        if node >= n:
            return node - n
        won, lost = match(play(2 * node), play(2 * node + 1))
        loser[node] = lost
        return won

    top = play(1) if n > 1 else 0
    while key[top] is not None:
        yield key[top], pre[top], top
        head = next(runs[top], None)
        key[top], pre[top] = head if head else (None, 0)
        node = (top + n) >> 1
        while node:
            won, lost = match(top, loser[node])
            loser[node], top = lost, won
            node >>= 1


# ------------------------------------------------------------------ anchors

def anchors(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, k: int = ANCHOR):
    """Anchor position, first and last window start, and 64-bit hash, of every stretch of windows."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    h = _BYTE[data]
    step = 1
    while step < k:  # hashes of runs of 2, 4, 8, ... bytes
        h = h[:-step] * U64(0x9E3779B97F4A7C15 + 2 * step) + h[step:]
        step *= 2
    h = mix(h)
    low, at = h.copy(), np.arange(len(h), dtype=np.int32)
    room, step = length - k + 1, 1
    while step < room:  # the smallest of 2, 4, 8, ... and at last of all hashes in a window, leftmost on ties
        by = min(step, room - step)
        less = low[by:] < low[:-by]
        low = np.where(less, low[by:], low[:-by])
        at = np.where(less, at[by:], at[:-by])
        step += by
    at = at[:n].astype(np.int64)
    start = np.arange(n)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:n]
    ok = start + length <= offs[1:][doc]
    start, at, doc = start[ok], at[ok], doc[ok]
    if not len(start):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (np.diff(start) != 1)]))
    last = np.append(first[1:], len(start)) - 1
    return at[first], start[first], start[last], h[at[first]]


def suffix(text: bytes, a: int, lo: int, hi: int, length: int) -> bytes:
    """Sort 1's key: from the anchor to the end of the stretch, the bytes before it backwards, and where they meet."""
    return text[a:hi + length] + text[lo:a][::-1] + bytes([hi + length - a])


def stretch(key: bytes) -> tuple[bytes, int]:
    """The text of a stretch and the anchor's place in it."""
    n = key[-1]
    return key[n:-1][::-1] + key[:n], len(key) - 1 - n


def repeated(docs: DataFrame, size: int, length: int, anchor: int, bits: int) -> tuple[np.ndarray, list[bytes]]:
    """Bitmap of the anchor hashes that occur again, and a bounded sample of such anchors' suffixes for splitters."""
    cut_bits = int(min(14, max(6, (size >> 24).bit_length())))  # a part has the hashes of some 16 MB of text
    parts = 1 << cut_bits
    rate = min(1.0, 2 * SAMPLE / max(1, size / 32))  # an anchor every 35 bytes or so

    def hashes(batches):
        for _, data, offs in slices(batches):
            a, lo, hi, h = anchors(data, offs, length, anchor)
            text = data.tobytes()
            some = np.flatnonzero((mix(h + mix(a.astype(np.uint64))) >> U64(11)) * 2.0**-53 < rate)
            sample = [h[i].tobytes() + suffix(text, a[i], lo[i], hi[i], length) for i in some]
            h, n = np.unique(h >> U64(32 - cut_bits), return_counts=True)
            h = np.repeat(h, np.minimum(n, 2))  # twice here stays twice in the sum over slices
            at = np.searchsorted(h >> U64(32), np.arange(parts + 1, dtype=np.uint64))
            low = h.astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(parts), pa.int32()), pa.array([low[x:y].tobytes() for x, y in zip(at, at[1:])], pa.binary()),
                 pa.array([sample] + [[]] * (parts - 1), pa.list_(pa.binary()))], names=["part", "low", "sample"])

    def again(key, rows):
        low, n = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in rows.low]), return_counts=True)
        bit = np.zeros(1 << bits - cut_bits, dtype=bool)
        bit[low[n > 1] >> np.uint32(32 - (bits - cut_bits))] = True
        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(bit, bitorder="little").tobytes()]})

    rows = cut(mapped(docs.select("text"), hashes, "part int, low binary, sample array<binary>"))
    table = np.zeros((parts, 1 << bits - cut_bits - 3), np.uint8)
    for r in rows.groupBy("part").applyInPandas(again, "part int, bits binary").toLocalIterator():
        table[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    table = table.reshape(-1)
    sample = [bytes(r[0]) for r in rows.select(F.explode("sample").alias("s")).orderBy(F.xxhash64("s"), "s").limit(SAMPLE).collect()]
    return table, [x[8:] for x in sample if marked(table, np.frombuffer(x[:8], np.uint64), bits)[0]]


def marked(table: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    slot = h >> U64(64 - bits)
    return (table[(slot >> U64(3)).astype(np.int64)] >> (slot & U64(7)).astype(np.uint8)) & 1 != 0


# ------------------------------------------------------------------ the two sorts

_RUNS = "range int, n int, keys binary, docs binary, owners binary, spans binary"
_SPANS = "id long, th long, lo long, hi long"


def _runs(entries: list[tuple[bytes, tuple]], splitters: list[bytes]):
    """Sorted entries without their repeats, cut at the splitters into front-coded runs; and the repeats."""
    entries.sort()
    keep, again = [], []
    for e in entries:
        if keep and keep[-1][0] == e[0]:
            again.append(e)
        else:
            keep.append(e)
    keys = [k for k, _ in keep]
    cuts, at = [0], 0
    for s in splitters:
        at = bisect_left(keys, s, at)
        cuts.append(at)
    cuts.append(len(keys))
    out, pack = [], zstandard.ZstdCompressor(level=3).compress
    for r, (i, j) in enumerate(zip(cuts, cuts[1:])):
        if j > i:
            owner = np.array([o for _, o in keep[i:j]], np.int64)
            docs, doc = np.unique(owner[:, :2], axis=0, return_inverse=True)
            place = np.concatenate([doc.reshape(-1), owner[:, 2]]).astype("<u4")
            out.append((r, j - i, pack(b"".join(front_code(keys[i:j]))), docs.tobytes(), pack(place.tobytes())))
    return out, again


def _run_batch(runs: list[tuple], spans: list[tuple]) -> pa.RecordBatch:
    """Rows of runs; the first one also takes along the repeats that the block knows by itself."""
    own = np.array(joined(spans), np.int64).tobytes()
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
    cols = list(zip(*[(*r, b"" if i else own) for i, r in enumerate(runs)])) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[f.split()[0] for f in _RUNS.split(", ")])


def _merged(rows: pd.DataFrame) -> Iterator[tuple[bytes, int, tuple]]:
    """(key, common prefix with the one before, owner) of a range's runs."""
    open_ = zstandard.ZstdDecompressor().decompress
    runs, owners = [], []
    for n, keys, docs, places in zip(rows.n, rows["keys"], rows.docs, rows.owners):
        keys, places = open_(keys), np.frombuffer(open_(places), "<u4")
        runs.append(decode(keys[:2 * n], keys[2 * n:4 * n], keys[4 * n:]))
        docs = np.frombuffer(docs, np.int64).reshape(-1, 2)[places[:n]]
        owners.append(zip(docs[:, 0].tolist(), docs[:, 1].tolist(), places[n:].tolist()))
    for key, pre, run in merge(runs):
        yield key, pre, next(owners[run])


def joined(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans of the same document that touch as one."""
    out: list[tuple[int, int, int, int]] = []
    for i, th, lo, hi in sorted(spans):
        if out and out[-1][:2] == (i, th) and lo <= out[-1][3]:
            out[-1] = (i, th, out[-1][2], max(hi, out[-1][3]))
        else:
            out.append((i, th, lo, hi))
    return out


def _spans(again: list[tuple[int, int, int, int]], rows: pd.DataFrame) -> pd.DataFrame:
    known = [np.frombuffer(x, np.int64) for x in rows.spans]
    flat = np.concatenate([np.array(again, np.int64).reshape(-1), *known])
    return pd.DataFrame(flat.reshape(-1, 4), columns=["id", "th", "lo", "hi"])


def window_repeats(group: list, length: int) -> list[tuple[int, int, int, int]]:
    """Spans of the windows of different suffixes of one anchor that an earlier one of them has too."""
    first: dict[bytes, tuple] = {}
    out = []
    for key, (i, th, a) in group:
        body, place = stretch(key)
        for j in range(len(body) - length + 1):
            w, own = body[j:j + length], (i, th, a - place + j)
            old = first.setdefault(w, own)
            if old != own:
                first[w], new = sorted((old, own))
                out.append((*new, new[2] + length))
    return joined(out)


def find_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, th, lo, hi): byte ranges of documents that earlier strings of ``length`` bytes cover; they may overlap.

    ``length`` is at most 255 and ``anchor`` a power of two.
    """
    base = keyed(docs)
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = int(min(4096, max(64, size // (4 << 20))))
    # eight bits an anchor, so that few pass by chance, up to the bound
    bits = int(min(max_bits, max(20, (8 * size // 32).bit_length())))
    table, sample = repeated(base, size, length, anchor, bits)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def splitters(strings: list[bytes]) -> list[bytes]:
        strings = sorted(strings)
        return sorted({strings[i * len(strings) // ranges] for i in range(1, ranges)}) if strings else []

    def first_runs(cuts):
        def run(batches):
            entries, text_size, spans = [], 0, []

            def flush():
                runs, again = _runs(entries, cuts)
                for key, (i, th, a) in again:
                    body, place = stretch(key)
                    spans.append((i, th, a - place, a - place + len(body)))
                return _run_batch(runs, spans)

            for rows, data, offs in slices(batches):
                a, lo, hi, h = anchors(data, offs, length, anchor)
                ok = marked(shared.value, h, bits)
                a, lo, hi = a[ok], lo[ok], hi[ok]
                doc = np.searchsorted(offs, a, side="right") - 1
                text = data.tobytes()
                ids = [NO_ID if i is None else i for i in rows.column("doc_id").to_pylist()]
                ths = rows.column("th").to_pylist()
                entries += [(suffix(text, x, y, z, length), (ids[d], ths[d], x - o)) for x, y, z, d, o in
                            zip(a.tolist(), lo.tolist(), hi.tolist(), doc.tolist(), offs[doc].tolist())]
                text_size += len(data)
                if text_size >= RUN:
                    yield flush()
                    entries, text_size, spans = [], 0, []
            yield flush()
        return run

    def first_merge(cuts):
        edges = {c[:anchor] for c in cuts}  # an anchor that splitters cut through may go on in the next range

        def run(key, rows):
            repeats, ends, group, last = [], [], [], None

            def close(group):
                if group and group[0][0][:anchor] in edges:
                    ends.extend(group)
                elif len(group) > 1:
                    repeats.extend(window_repeats(group, length))

            for k, pre, owner in _merged(rows):
                if last is not None and pre == len(k) == len(last[0]):
                    old, new = sorted((last[1], owner))  # equal: the smaller owner stays
                    body, place = stretch(k)
                    repeats.append((*new[:2], new[2] - place, new[2] - place + len(body)))
                    last[1] = old
                    continue
                if last is None or pre < anchor:
                    close(group)
                    group = []
                last = [k, owner]
                group.append(last)
            close(group)
            out = _spans([(*o[:2], o[2] - stretch(k)[1], 0) for k, o in ends] + joined(repeats), rows)
            out["body"] = [stretch(k)[0] for k, _ in ends] + [b""] * (len(out) - len(ends))
            return out
        return run

    cuts = splitters(sample)
    sorted_ = cut(mapped(base, first_runs(cuts), _RUNS).groupBy("range").applyInPandas(first_merge(cuts), _SPANS + ", body binary"))
    ends = sorted_.where("octet_length(body) > 0")
    sample2 = ends.select("body", F.pmod(F.xxhash64("id", "th", "lo"), F.octet_length("body") - F.lit(length - 1)).alias("p")).select(
        F.expr(f"substring(body, cast(p as int) + 1, {length})").alias("s"), F.xxhash64("body", "p").alias("o"))
    cuts2 = splitters([bytes(r[0]) for r in sample2.orderBy("o", "s").limit(SAMPLE).select("s").collect()])

    def window_runs(batches):
        entries = []

        def flush():
            runs, twice = _runs(entries, cuts2)
            return _run_batch(runs, [(i, th, lo, lo + length) for _, (i, th, lo) in twice])

        for b in batches:
            for i, th, lo, body in zip(*(b.column(c).to_pylist() for c in ("id", "th", "lo", "body"))):
                entries += [(body[j:j + length], (i, th, lo + j)) for j in range(len(body) - length + 1)]
                if len(entries) >= 200_000:
                    yield flush()
                    entries = []
        yield flush()

    def window_merge(key, rows):
        repeats, last, first = [], None, None
        for k, pre, owner in _merged(rows):
            if last is not None and pre == len(k) == len(last):
                first, new = sorted((first, owner))
                repeats.append((*new, new[2] + length))
            else:
                last, first = k, owner
        return _spans(joined(repeats), rows)

    windows = mapped(ends.select("id", "th", "lo", "body").repartition(max(16, ranges // 4), "id", "th", "lo"), window_runs, _RUNS)
    found = windows.groupBy("range").applyInPandas(window_merge, _SPANS)
    return sorted_.where("octet_length(body) = 0").select("id", "th", "lo", "hi").union(found)


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """All columns of ``docs`` as struct ``row``, the removed byte spans and the kept bytes."""
    docs_ = docs.withColumn("text", F.col("text").cast("string"))
    lost = find_repeats(docs_, length, anchor).groupBy(F.when(F.col("id") != NO_ID, F.col("id")).alias("i"), F.col("th").alias("t")).agg(
        F.collect_set(F.struct("lo", "hi")).alias("lost"))  # at most the bytes of a document
    base = docs_.select(F.struct("*").alias("row"), F.col("doc_id").alias("d"), text_hash().alias("h"))
    both = base.join(lost, F.col("d").eqNullSafe(F.col("i")) & (F.col("h") == F.col("t")), "left")

    def run(batches):
        for rows, data, offs in slices(batches):
            spans, kept = [], []
            for i, away in enumerate(rows.column("lost").to_pylist()):
                text = data[offs[i]:offs[i + 1]]
                joined: list[list[int]] = []
                for lo, hi in sorted((x["lo"], x["hi"]) for x in away or []):
                    if joined and lo <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], hi)
                    else:
                        joined.append([lo, hi])
                keep = np.ones(len(text), dtype=bool)
                for lo, hi in joined:
                    keep[lo:hi] = False
                spans.append([{"lo": lo, "hi": hi} for lo, hi in joined])
                kept.append(text[keep].tobytes())
            yield pa.RecordBatch.from_arrays(
                [rows.column("row"), pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["row", "spans", "kept"])

    # a text is shuffled and sorted once, in its row; only the Python task is given it beside the row
    return mapped(both.select("row", F.col("row.text").alias("text"), "lost"), run,
                  f"row {both.schema['row'].dataType.simpleString()}, spans array<struct<lo:long,hi:long>>, kept binary")


def op4_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf).select("doc_id", "text"))
    n = F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long")
    return out.select("row.doc_id", n.alias("n_bytes"), (n - F.octet_length("kept")).cast("long").alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
SQL: dict[str, str] = {}
