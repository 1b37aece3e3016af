"""Near-duplicate documents by BagMinHash: weighted MinHash of shingle multisets.

A shingle (five whitespace-separated words, A-Z lower-cased) has its count in
the document as weight. Weights are discretised at the integers and the axis is
cut into the dyadic blocks [0,1), [1,2), [2,4), ...; each block of each shingle
has a Poisson process of its own, seeded by both, whose points carry a register
and a place in the block. The place, halved bit by bit, is the hierarchy of the
method: a point counts where it lies below the weight. A register keeps its
first point, and points are drawn in order only until none can come before the
last register's. Two registers agree with the probability of the weighted
Jaccard similarity.

Documents with equal multisets are one class from the start and go on as one
representative. Representatives that share one of 32 bands of four registers
(a pair at similarity 0.8 shares none with probability 5e-8) are compared: first
all of a bucket with its head, then, in buckets that still span several
components, the members outside of the largest component with all of other
components, in blocks of ``BLOCK`` by ``BLOCK`` members whose signatures one task
holds: the best pair of each two components first, and once that has merged what
it can, all that are left. A
pair is named by the first band that it shares, so once, and only where its
signatures agree to within five standard deviations of 0.8: with a head, in
``ROUGH`` of the 512 registers (the bands use 128 of them); across components, by
``FINE`` more registers of one bit each, which only members of such buckets get
and which leave few pairs that are not near copies. Then its multisets are read
again from the texts. In a bucket of n members with t outside of its largest
component, n * t signatures are compared in numpy; no pair of them becomes a row
before it agrees. Classes are the connected components of the pairs at
``threshold`` or more.

Defined results: texts of one to four words have one shingle, all their words;
texts without words (NULL, empty, blank) are equal to each other; repeated rows
are in the same class; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm.common import (
    ASCII_LOWER, SPACED, U64, bitmap, cut, documents, few, gram_hashes, in_bitmap, keyed, mapped, mix, slices, spans, stream,
    text_hash, within, word_hashes,
)
from tabforge.llm.components import components
from tabforge.session import default_partitions

WORDS, THRESHOLD, REGISTERS, BANDS, ROWS, ROUGH, BLOCK, BITS, FINE = 5, 0.8, 512, 32, 4, 0.71, 1024, 24, 4096


def shingles(data: np.ndarray, offs: np.ndarray, k: int = WORDS):
    """Distinct (document, shingle hash) with its count, ordered by both."""
    data = ASCII_LOWER[data]
    starts, ends, before = spans(data, offs, SPACED)
    words, n_words = word_hashes(data, starts, ends), np.diff(before)
    grams = gram_hashes(words, k)
    at = np.flatnonzero(within(len(grams), before, k))
    doc, h = [np.searchsorted(before, at, side="right") - 1], [grams[at]]
    for n in range(1, k):
        few = np.flatnonzero(n_words == n)
        if len(few):
            doc.append(few)
            h.append(mix(gram_hashes(words, n)[before[few]] + U64(n)))
    doc, h = np.concatenate(doc), np.concatenate(h)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if not len(h):
        return doc, h, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]))
    return doc[first], h[first], np.diff(first, append=len(h))


def signatures(doc: np.ndarray, h: np.ndarray, count: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """n_docs x m first points (float64); documents without shingles keep infinity."""
    regs = np.full(n_docs * m, np.inf)
    d, seed, lo, size, weight = [], [], [], [], []
    block, low, some = 0, 0, np.arange(len(doc))
    while len(some):  # the blocks that each weight reaches into
        high = max(1, 2 * low)
        d.append(doc[some]), weight.append(count[some])
        seed.append(mix(h[some] + stream(block + 1, 23)[block]))
        lo.append(np.full(len(some), low)), size.append(np.full(len(some), high - low))
        some = some[count[some] > high]
        block, low = block + 1, high
    if not d:
        return regs.reshape(n_docs, m)
    d, seed, lo, size, weight = (np.concatenate(a) for a in (d, seed, lo, size, weight))
    x, t = np.zeros(len(d)), 0
    while len(d):
        n = max(1, min(64, 50_000 // len(d)))  # points drawn at once
        seeds = mix(seed[:, None] + (np.arange(t, t + n, dtype=np.uint64) + U64(1)) * U64(0xD1B54A32D192ED03))
        gap = -np.log(((seeds >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / size[:, None]
        gap[:, 0] += x  # one sum from the first point on: the same bits however many points are drawn at once
        points = np.cumsum(gap, axis=1)
        bits = mix(seeds + U64(0x632BE59BD9B4E019))
        register = (bits & U64(m - 1)).astype(np.int64)
        place = ((bits >> U64(16)).astype(np.float64) * 2.0**-48) * size[:, None]
        hit = (lo[:, None] + place).astype(np.int64) < weight[:, None]
        np.minimum.at(regs, (d[:, None] * m + register)[hit], points[hit])
        x, t = points[:, -1], t + n
        live = x < regs.reshape(n_docs, m).max(axis=1)[d]
        d, seed, lo, size, weight, x = (a[live] for a in (d, seed, lo, size, weight, x))
    return regs.reshape(n_docs, m)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, th, a 128-bit digest of the shingle multiset, its bands and its registers (8 bits of each)."""
    odd = stream(ROWS, 15) | U64(1)
    kind = "doc_id long, th long, d1 long, d2 long, bands array<long>, regs binary"

    def run(batches):
        for rows, data, offs in slices(batches):
            n = len(offs) - 1
            doc, h, count = shingles(data, offs)
            regs = signatures(doc, h, count, n)
            blank = np.isinf(regs[:, 0])
            raw = mix(regs.view(np.uint64))
            bands = mix((raw[:, :BANDS * ROWS].reshape(n, BANDS, ROWS) * odd).sum(axis=2) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            small = (raw >> U64(56)).astype(np.uint8)
            digests = []
            for salt in (21, 22):  # sums over the multiset do not depend on its order
                total = np.zeros(n, np.uint64)
                if len(h):
                    first = np.flatnonzero(np.diff(doc, prepend=-1))
                    total[doc[first]] = np.add.reduceat(mix(h + U64(salt)) * count.astype(np.uint64), first)
                digests.append(pa.array(mix(total + U64(salt)).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").cast(pa.int64()), rows.column("th"), *digests,
                 pa.array([[] if b else x for b, x in zip(blank, bands)], pa.list_(pa.int64())),
                 pa.array([b"" if b else x.tobytes() for b, x in zip(blank, small)], pa.binary())],
                names=["doc_id", "th", "d1", "d2", "bands", "regs"])

    return mapped(keyed(docs), run, kind)


def alike(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree in ``ROUGH`` of the registers."""

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, REGISTERS) for c in ("ra", "rb"))
            yield b.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= ROUGH, pa.bool_()))

    one = reps.select(F.col("v").alias("a"), F.col("regs").alias("ra"))
    two = reps.select(F.col("v").alias("b"), F.col("regs").alias("rb"))
    return mapped(pairs.join(one, "a").join(two, "b").select("a", "b", "ra", "rb"), run, "a long, b long")


def fine_signatures(wanted: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """v, bands and one bit of each of ``FINE`` registers for the vertices ``wanted``, from their texts."""

    def run(batches):
        for rows, data, offs in slices(batches):
            for i in range(0, len(offs) - 1, 64):  # registers of 64 documents at once
                some = offs[i:i + 65]
                regs = signatures(*shingles(data[some[0]:some[-1]], some - some[0]), len(some) - 1, FINE)
                bits = np.packbits(mix(regs.view(np.uint64)).astype(np.uint8) & 1, axis=1)
                yield pa.RecordBatch.from_arrays([rows.column("v").slice(i, len(bits)), pa.array([x.tobytes() for x in bits], pa.binary())],
                                                 names=["v", "fine"])

    named = cut(wanted.join(reps.select("v", "doc_id", "th"), "v"))
    # few bytes, much work: not to be coalesced
    parts = max(default_partitions(docs.sparkSession), named.count() // 512)
    texts = texts_of(named, docs).repartition(parts, "v")
    return cut(mapped(texts, run, "v long, fine binary").join(reps.select("v", "bands"), "v"))


def across(known: DataFrame, fine: DataFrame, every: bool, threshold: float) -> DataFrame:
    """Pairs (a < b) of different components that share a bucket and whose fine signatures let ``threshold`` be true;
    of each two components in a group only the best pair unless ``every``. ``known``: key, v, c, n (size of the bucket),
    major (its largest component) and t (members outside of that); ``fine``: v, bands, fine.

    One of a pair is outside of the largest component: groups hold a block of those members (slot i) and a block of
    all members (slot j), so the work is n * t, not n * n.
    """
    lefts, rights = (F.ceil(F.col(x) / BLOCK).cast("int") for x in ("t", "n"))
    minor = F.col("c") != F.col("major")
    s, r = F.pmod(F.xxhash64("v"), lefts).cast("int"), F.pmod(F.xxhash64("v", F.lit(1)), rights).cast("int")
    known = known.select("key", "v", "c", minor.alias("minor"), s.alias("s"), r.alias("r"), lefts.alias("lefts"), rights.alias("rights"))
    as_right = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda o: F.struct(o.alias("i"), F.col("r").alias("j")))
    as_left = F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda o: F.struct(F.col("s").alias("i"), o.alias("j")))
    groups = F.when(F.col("minor"), F.array_union(as_right, as_left)).otherwise(as_right)
    dealt = known.select("key", "v", "c", "minor", "s", "r", F.inline(groups))
    before = F.slice("bands", F.lit(1), F.array_position("bands", F.col("key")).cast("int") - 1)  # the bands before this bucket's
    dealt = dealt.join(fine, "v").withColumn("bands", before).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    # one bit agrees with probability (1 + similarity) / 2
    least = threshold - 5 * np.sqrt((1 - threshold ** 2) / FINE)
    most = FINE * (1 - least) / 2  # bits that may differ

    def compare(i, j, v, c, minor, s, r, bands, regs):
        left, right = np.flatnonzero(minor & (s == i)), np.flatnonzero(r == j)
        xs, ys, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for k in range(0, len(left), 64):
            some = left[k:k + 64]
            ok = c[some][:, None] != c[right][None, :]
            # two members outside of the largest component meet twice
            ok &= ~minor[right][None, :] | (v[some][:, None] < v[right][None, :])
            for other in range(bands.shape[1]):  # a pair is named by the first band that it shares
                ok &= bands[some, other][:, None] != bands[right, other][None, :]
            x, y = np.nonzero(ok)
            x, y = some[x], right[y]
            differ = np.concatenate([np.bitwise_count(regs[x[m:m + 10_000]] ^ regs[y[m:m + 10_000]]).sum(axis=1, dtype=np.int64)
                                     for m in range(0, len(x), 10_000)] or [np.zeros(0)])
            keep = differ <= most
            xs.append(x[keep])
            ys.append(y[keep])
            others.append(differ[keep])
        x, y, differ = np.concatenate(xs), np.concatenate(ys), np.concatenate(others)
        if not every and len(x):
            order = np.argsort(differ, kind="stable")
            two = np.sort(np.stack([c[x[order]], c[y[order]]], axis=1), axis=1)
            first = order[np.sort(np.unique(two, axis=0, return_index=True)[1])]
            x, y = x[first], y[first]
        return np.minimum(v[x], v[y]), np.maximum(v[x], v[y])

    def run(batches):
        """Groups come in a row; one that a batch cuts is carried over."""
        rest = None
        for b in batches:
            if rest is not None:
                b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
            out, rest = finished(b, False)
            yield from out
        if rest is not None:
            yield from finished(rest, True)[0]

    def finished(b, last):
        if not b.num_rows:
            return [], None
        ids = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")], axis=1)
        cuts = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]).any(axis=1)]))
        ends, rest = np.append(cuts[1:], len(ids)), None
        if not last:
            rest, cuts, ends = b.slice(int(cuts[-1])), cuts[:-1], ends[:-1]
        v, c, s, r = (b.column(x).to_numpy().astype(np.int64) for x in ("v", "c", "s", "r"))
        minor = b.column("minor").to_numpy(zero_copy_only=False)
        out = []
        for lo, hi in zip(cuts.tolist(), ends.tolist()):
            part = b.slice(lo, hi - lo)
            bands = part.column("bands").flatten().to_numpy().reshape(hi - lo, -1)
            regs = np.frombuffer(b"".join(part.column("fine").to_pylist()), np.uint64).reshape(hi - lo, FINE // 64)
            out.append(compare(*ids[lo, 1:].tolist(), v[lo:hi], c[lo:hi], minor[lo:hi], s[lo:hi], r[lo:hi], bands, regs))
        return [pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["a", "b"])] if out else [], rest

    return mapped(dealt.select("key", "i", "j", "v", "c", "minor", "s", "r", "bands", "fine"), run, "a long, b long").distinct()


def overlap(texts: list[str], others: list[str]) -> np.ndarray:
    """Weighted Jaccard similarity of each two texts' shingle multisets."""
    distinct = list(dict.fromkeys([*texts, *others]))
    at = {t: i for i, t in enumerate(distinct)}
    flat = [t.encode() for t in distinct]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in flat])])
    doc, h, count = shingles(np.frombuffer(b"".join(flat), np.uint8), offs)
    cuts = np.searchsorted(doc, np.arange(len(distinct) + 1))
    out = np.zeros(len(texts))
    for i, (a, b) in enumerate(zip(texts, others)):
        a, b = (slice(cuts[at[t]], cuts[at[t] + 1]) for t in (a, b))
        _, i1, i2 = np.intersect1d(h[a], h[b], assume_unique=True, return_indices=True)
        both = int(np.minimum(count[a][i1], count[b][i2]).sum())
        out[i] = both / max(1, int(count[a].sum() + count[b].sum()) - both)
    return out


def texts_of(named: DataFrame, docs: DataFrame) -> DataFrame:
    """v and text of ``named`` (v, doc_id, th; checkpointed). Only documents that it names (by a bitmap of fixed size,
    then exactly) leave their files."""
    filter_ = docs.sparkSession.sparkContext.broadcast(bitmap(named.select(F.col("th").alias("h")), BITS))

    def some(batches):
        for b in batches:
            yield b.filter(pa.array(in_bitmap(filter_.value, b.column("th").to_numpy().view(np.uint64), BITS)))

    base = keyed(docs)
    texts = mapped(base, some, ", ".join(f"{c} {t}" for c, t in base.dtypes)).where("text is not null")
    same = texts["doc_id"].eqNullSafe(named["doc_id"]) & (texts["th"] == named["th"])
    return texts.join(few(named), same).select("v", "text").dropDuplicates(["v"])


def verify(pairs: DataFrame, reps: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` (checkpointed) whose texts reach ``threshold``."""

    def run(batches):
        for b in batches:
            size = np.cumsum(pc.add(pc.binary_length(b.column("ta")), pc.binary_length(b.column("tb"))).to_numpy())
            for part in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(size // (4 << 20))) + 1):
                rows = b.slice(int(part[0]), len(part)) if len(part) else b.slice(0, 0)
                near = overlap(rows.column("ta").to_pylist(), rows.column("tb").to_pylist())
                yield rows.select(["a", "b"]).filter(pa.array(near >= threshold, pa.bool_()))

    texts = texts_of(cut(pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct().join(reps.select("v", "doc_id", "th"), "v")), docs)
    with_a = pairs.join(texts.select(F.col("v").alias("a"), F.col("text").alias("ta")), "a")
    with_b = with_a.join(texts.select(F.col("v").alias("b"), F.col("text").alias("tb")), "b")
    return mapped(with_b.select("a", "b", "ta", "tb"), run, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, th and ``first``: the smallest (doc_id, th) of the document's class."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = cut(sketch(docs))
    reps = cut(sketches.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "th")).alias("own"), F.first("bands").alias("bands"),
                                                F.first("regs").alias("regs")))
    reps = reps.select("d1", "d2", "own.*", "bands", "regs", F.monotonically_increasing_id().alias("v"))  # stable: checkpointed
    members = reps.select("v", F.explode("bands").alias("key"))
    heads = members.groupBy("key").agg(F.min("v").alias("to"), F.count("*").alias("n")).where("n > 1")
    shared = cut(members.join(heads, "key"))  # from here on only buckets with several members

    tested = cut(shared.where("v <> to").select(F.col("to").alias("a"), F.col("v").alias("b")).distinct())
    edges = cut(verify(cut(alike(tested, reps)), reps, docs, threshold))
    labels, fine = components(edges), None
    for every in (False, True):
        known = shared.join(few(labels), "v", "left").select("key", "v", F.coalesce("c", "v").alias("c"), "n")
        sizes = known.groupBy("key", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(
            F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("all"))
        mixed = sizes.where("top.k < all").select("key", F.col("top.c").alias("major"), (F.col("all") - F.col("top.k")).alias("t"))
        known = cut(known.where("n > 2").join(mixed, "key"))  # the two of a pair have been compared
        if fine is None:  # later rounds mix fewer buckets
            fine = fine_signatures(known.select("v").distinct(), reps, docs)
        new = cut(across(known, fine, every, threshold).join(tested, ["a", "b"], "left_anti"))
        if new.isEmpty():
            continue
        tested = tested.union(new)
        edges = cut(edges.union(verify(new, reps, docs, threshold)))
        labels = components(edges)
    classes = reps.select("d1", "d2", "v", F.struct("doc_id", "th").alias("own")).join(few(labels), "v", "left").withColumn("c", F.coalesce("c", "v"))
    first = classes.groupBy("c").agg(F.min("own").alias("first"))
    classes = classes.join(first, "c").select(F.col("d1").alias("k1"), F.col("d2").alias("k2"), "first")
    return sketches.select("doc_id", "th", "d1", "d2").join(
        classes, (F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2"))).select("doc_id", "th", "first")


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, with the first document of each class only."""
    keep = near_duplicates(docs, threshold).where(F.struct("doc_id", "th") == F.col("first"))
    keys = [F.coalesce("doc_id", F.lit(0)).cast("long").alias("k0"), F.col("doc_id").isNull().alias("k1"), F.col("th").alias("k2")]
    whole = docs.select(F.struct("*").alias("row"), "doc_id", text_hash().alias("th")).select("row", *keys)
    # repeated rows are dropped where the join has put them: plain keys, so that one shuffle serves both
    names = ["k0", "k1", "k2"]
    return whole.join(keep.select(*keys).distinct(), names).dropDuplicates(names).select("row.*")


def op3_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """One row per document: its class (the class's first doc_id) and whether it is that first document."""
    out = near_duplicates(documents(spark, sf))
    return out.select("doc_id", F.col("first.doc_id").alias("class_id"), (F.struct("doc_id", "th") == F.col("first")).alias("is_first"))


QUERIES = {"op3_near_duplicates": op3_near_duplicates}
SQL: dict[str, str] = {}
