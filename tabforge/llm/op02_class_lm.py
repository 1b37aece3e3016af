"""Brown class-based bigram language model by exchange clustering.

p(w | w') = p(class(w) | class(w')) * p(w | class(w)). Class transitions are
counted in training texts and smoothed with the class frequencies
(Witten-Bell); a word's emission is (count + 1) / (class tokens + class words
+ 1), the last 1 for all unseen words of the class together.

What takes part in the exchange: each word with at least 1/2**15 of all
training tokens (at most 2**15 words, whatever the corpus) by itself, the rarer ones together
with those of the same ending (512 groups by hash of the last three bytes), the
end token in a class of its own. Every round, Spark sums for every item how
often it stands before and after each class; these sums (items x classes, so of
bounded size) decide the class that raises the log-likelihood of the class
bigrams most, and half of the items move at a time, since two that move
together do not see each other.

Counts of all words stay distributed, in parts by word hash. Words with at least
1/2**18 of all tokens (2**18 at most) and those items are broadcast; documents send the hashes
of their rarer words to the parts and get sums of log-counts back.

Defined results: NULL and empty texts are the end token alone; rows that repeat
doc_id and text are scored once; a corpus without training texts scores by the
smoothing alone; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm.common import ASCII_LOWER, SPACED, U64, crc_mod, cut, documents, keyed, mapped, mix, slices, spans, word_hashes

LOOKUP, CLUSTER, ENDINGS, CLASSES, ROUNDS = 1 << 18, 1 << 15, 512, 64, 6
BLOCK = 24 << 20  # bytes of text whose counts are summed before they are sent


def words_of(data: np.ndarray, offs: np.ndarray):
    """Word hashes, their ending groups, and words before each document."""
    data = ASCII_LOWER[data]
    starts, ends, before = spans(data, offs, SPACED)
    tail = np.zeros(len(starts), np.uint64)
    for j in (3, 2, 1):
        at = ends - j
        tail = tail * U64(256) + np.where(at >= starts, data[np.maximum(at, 0)] if len(data) else 0, 0).astype(np.uint64)
    return word_hashes(data, starts, ends), (mix(tail) % U64(ENDINGS)).astype(np.int64), before


def summed(keys: np.ndarray, *counts: np.ndarray):
    """Distinct keys in order, with the sums of their counts (below 2**53)."""
    code, keys = pd.factorize(keys)
    order = np.argsort(keys)
    return (keys[order], *(np.bincount(code, c, len(keys)).astype(np.int64)[order] for c in counts))


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)  # ascending with h


class Sums:
    """Keys with counts, summed up when many have come together."""

    def __init__(self, n: int):
        self.n, self.waiting, self.size = n, [], 0

    def add(self, *arrays: np.ndarray) -> None:
        self.waiting.append(summed(*arrays))
        self.size += len(self.waiting[-1][0])

    def take(self):
        out = summed(*(np.concatenate(c) for c in zip(*self.waiting))) if self.waiting else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * self.n)
        self.waiting, self.size = [], 0
        return out


def count_words(docs: DataFrame, parts: int) -> DataFrame:
    """One row per part: hashes, training counts, all counts and ending groups of its words, and their totals.
    ``docs`` has text and ``train``."""

    def run(batches):
        sums, size = Sums(3), 0

        def flush():
            h, *rest = sums.take()
            at = np.searchsorted(part_of(h, parts), np.arange(parts + 1))
            return pa.RecordBatch.from_arrays(
                [pa.array(range(parts), pa.int32()),
                 *(pa.array([a[x:y].tobytes() for x, y in zip(at, at[1:])], pa.binary()) for a in (h, *rest))], names=names)

        for rows, data, offs in slices(batches):
            h, ending, before = words_of(data, offs)
            train = np.repeat(rows.column("train").to_numpy(zero_copy_only=False).astype(np.int64), np.diff(before))
            sums.add(h, train, np.ones(len(h), np.int64), ending)  # a word's endings are all the same: the mean is its ending
            size += len(data)
            if size >= BLOCK:
                yield flush()
                size = 0
        yield flush()

    def add(key, rows):
        h, train, every, ending = (np.concatenate([np.frombuffer(x, t) for x in rows[c]])
                                   for c, t in (("h", np.uint64), ("train", np.int64), ("every", np.int64), ("ending", np.int64)))
        h, train, every, ending = summed(h, train, every, ending)
        return pd.DataFrame({"part": [key[0]], "h": [h.tobytes()], "train": [train.tobytes()], "every": [every.tobytes()],
                             "ending": [(ending // np.maximum(every, 1)).tobytes()], "n_train": [int(train.sum())],
                             "n_every": [int(every.sum())], "n_known": [int((train > 0).sum())]})

    names = ["part", "h", "train", "every", "ending"]
    kind = "part int, h binary, train binary, every binary, ending binary"
    return cut(mapped(docs.select("text", "train"), run, kind).groupBy("part").applyInPandas(
        add, kind + ", n_train long, n_every long, n_known long"))


def takes_part(train: np.ndarray, n_train: int) -> np.ndarray:
    """Which words are items of their own: by training texts alone."""
    return (train > 0) & (train * CLUSTER >= n_train)


class Vocabulary:
    """The words of bounded number that every task knows: sorted hashes, training counts, item numbers."""

    def __init__(self, h, train, n_train: int):
        order = np.argsort(h)
        self.h, self.train = h[order], train[order]
        own = takes_part(self.train, n_train)
        self.items = int(own.sum())
        self.item = np.where(own, np.cumsum(own) - 1, -1)
        self.end = self.items + ENDINGS
        self.size = self.end + 1

    def find(self, h: np.ndarray, ending: np.ndarray):
        """Item of each word, and its place here or -1."""
        at = np.minimum(np.searchsorted(self.h, h), max(0, len(self.h) - 1))
        at = np.where(self.h[at] == h, at, -1) if len(self.h) else np.full(len(h), -1)
        item = np.where(at >= 0, self.item[at], -1) if len(self.h) else at
        return np.where(item >= 0, item, self.items + ending), at


def sequences(item: np.ndarray, before: np.ndarray, end: int):
    """Items of all documents in a row, each document between two ends, and the places of the first ones."""
    n = np.diff(before)
    out = np.full(len(item) + len(n) + 1, end, np.int64)
    out[np.arange(len(item)) + np.repeat(np.arange(len(n)), n) + 1] = item
    return out  # token i of document d is out[before[d] + d + 1 + i]; its predecessor stands before it


def count_bigrams(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """Rows of 256 items each: (side, item, other, n) of all their neighbours in training texts, as arrays."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    size, groups = words.size, -(-words.size // 256)
    kind = "grp int, side int, code binary, n binary"

    def rows_of(code, n, side):
        at = np.searchsorted(code // (256 * size), np.arange(groups + 1))
        some = np.flatnonzero(np.diff(at))
        return pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array([side] * len(some), pa.int32()),
             *(pa.array([a[at[g]:at[g + 1]].astype(t).tobytes() for g in some], pa.binary()) for a, t in ((code, "<u4" if size < 65536 else "<i8"), (n, "<u4")))],
            names=["grp", "side", "code", "n"])

    def run(batches):
        w, sums = shared.value, Sums(1)
        for _, data, offs in slices(batches):
            h, ending, before = words_of(data, offs)
            seq = sequences(w.find(h, ending)[0], before, w.end)
            code = seq[:-1] * size + seq[1:]
            # before[d] + d is where document d's first token looks back to the end of the one before
            sums.add(code, np.ones(len(code), np.int64))
            if sums.size > 4_000_000:
                yield rows_of(*sums.take(), 0)
        yield rows_of(*sums.take(), 0)

    def total(rows):
        code = np.concatenate([np.frombuffer(x, "<u4" if size < 65536 else "<i8") for x in rows.code]).astype(np.int64)
        return summed(code, np.concatenate([np.frombuffer(x, "<u4") for x in rows.n]).astype(np.int64))

    def forward(key, rows):
        code, n = total(rows)
        return pd.DataFrame({"grp": [key[0]], "side": [0], "code": [code.tobytes()], "n": [n.tobytes()]})

    def backward(batches):
        for b in batches:
            for code, n in zip(b.column("code").to_pylist(), b.column("n").to_pylist()):
                code, n = np.frombuffer(code, np.int64), np.frombuffer(n, np.int64)
                yield rows_of(*summed(code % size * size + code // size, n), 1)

    def join(key, rows):
        code, n = total(rows)
        return pd.DataFrame({"grp": [key[0]], "side": [1], "code": [code.tobytes()], "n": [n.tobytes()]})

    one = cut(mapped(docs.where("train").select("text"), run, kind).groupBy("grp").applyInPandas(forward, kind))
    two = mapped(one, backward, kind).groupBy("grp").applyInPandas(join, kind)
    return cut(one.union(two))


def class_sums(bigrams: DataFrame, classes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(items x classes) how often a class follows and precedes each item, and how often an item follows itself."""
    shared = bigrams.sparkSession.sparkContext.broadcast(classes)

    def run(batches):
        for b in batches:
            for g, side, code, n in zip(*(b.column(c).to_pylist() for c in ("grp", "side", "code", "n"))):
                code, n = np.frombuffer(code, np.int64), np.frombuffer(n, np.int64)
                item, other = code // size, code % size
                m = np.bincount((item - 256 * g) * CLASSES + shared.value[other], n, 256 * CLASSES)
                own = np.bincount((item - 256 * g)[item == other], n[item == other], 256)
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([side], pa.int32()),
                                                  pa.array([m.tobytes()]), pa.array([own.tobytes()])], names=["g", "side", "m", "own"])

    out = np.zeros((2, -(-size // 256) * 256, CLASSES))
    own = np.zeros(out.shape[1])
    for r in mapped(bigrams, run, "g int, side int, m binary, own binary").collect():  # items x classes in all
        at = slice(256 * r["g"], 256 * (r["g"] + 1))
        out[r["side"], at] = np.frombuffer(r["m"]).reshape(256, CLASSES)
        own[at] = np.frombuffer(r["own"])
    return out[0][:size], out[1][:size], own[:size]


def _xlogx(a: np.ndarray) -> np.ndarray:
    return a * np.log(np.maximum(a, 1e-300))


def best_classes(after, ahead, own, classes, items: np.ndarray):
    """For each of ``items`` the class that raises the class bigram log-likelihood most, and by how much."""
    g = np.zeros((CLASSES, CLASSES))
    np.add.at(g, classes, after)
    total = g.sum(axis=1)
    best, gain = np.zeros(len(items), np.int64), np.zeros(len(items))
    for k, w in enumerate(items):
        c, r, l, s = classes[w], after[w], ahead[w], own[w]
        n = r.sum()
        m = g.copy()  # the counts without w
        m[c] -= r
        m[:, c] -= l
        m[c, c] += s
        t = total.copy()
        t[c] -= n
        r, l = r.copy(), l.copy()
        r[c] -= s
        l[c] -= s
        # w joins class x: row x gains r, column x gains l, cell (x, x) also s
        rows = (_xlogx(m + r) - _xlogx(m)).sum(axis=1)
        cols = (_xlogx(m + l[:, None]) - _xlogx(m)).sum(axis=0)
        d = np.diag(m)
        cell = _xlogx(d + r + l + s) - _xlogx(d + r) - _xlogx(d + l) + _xlogx(d)
        value = rows + cols + cell - 2 * (_xlogx(t + n) - _xlogx(t))
        value[0] = -np.inf  # the end token's own class
        best[k] = int(value.argmax())
        gain[k] = value[best[k]] - value[c]
    return best, gain


def exchange(bigrams: DataFrame, words: Vocabulary, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Class of each item, and the class bigram counts."""
    size = words.size
    classes = np.zeros(size, np.int64)
    classes[:words.end] = 1 + np.arange(words.end) % (CLASSES - 1)
    after, ahead, own = class_sums(bigrams, classes, size)
    for i in range(rounds):
        items = np.flatnonzero((after.sum(axis=1) > 0) & (np.arange(size) != words.end) & ((mix(np.arange(size, dtype=np.uint64)) >> U64(i // 2) & U64(1)) == i % 2))
        best, gain = best_classes(after, ahead, own, classes, items)
        classes = classes.copy()
        classes[items[gain > 1e-6]] = best[gain > 1e-6]
        after, ahead, own = class_sums(bigrams, classes, size)
    g = np.zeros((CLASSES, CLASSES))
    np.add.at(g, classes, after)
    return classes, g


def score(docs: DataFrame) -> DataFrame:
    """doc_id, th, n_tokens, n_known, train_tokens, base_score and score of every text; learns where ``train``."""
    base = keyed(docs, "train")
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(min(1 << 20, max(32, size >> 25)))
    counts = count_words(base, parts)
    n_docs = base.where("train").count()
    n_train, n_every, n_known = (int(x or 0) for x in counts.agg(F.sum("n_train"), F.sum("n_every"), F.sum("n_known")).first())

    def often(batches):
        for b in batches:
            for h, train, every in zip(*(b.column(c).to_pylist() for c in ("h", "train", "every"))):
                h, train, every = np.frombuffer(h, np.int64), np.frombuffer(train, np.int64), np.frombuffer(every, np.int64)
                ok = (every * LOOKUP >= n_every) | takes_part(train, n_train)
                yield pa.RecordBatch.from_arrays([pa.array(a[ok]) for a in (h, train)], names=["h", "train"])

    def endings(batches):
        for b in batches:
            for h, train, ending in zip(*(b.column(c).to_pylist() for c in ("h", "train", "ending"))):
                known = np.frombuffer(train, np.int64) > 0
                own = shared.value.find(np.frombuffer(h, np.uint64), np.zeros(len(known), np.int64))[0] < shared.value.items
                n = np.bincount(np.frombuffer(ending, np.int64)[known & ~own], minlength=ENDINGS)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(ENDINGS, dtype=np.int32)), pa.array(n)], names=["ending", "n"])

    many = mapped(counts, often, "h long, train long").toArrow()  # LOOKUP + CLUSTER rows at most
    words = Vocabulary(*(many.column(c).to_numpy() if c != "h" else many.column(c).to_numpy().view(np.uint64) for c in ("h", "train")), n_train)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(words)
    classes, g = exchange(count_bigrams(base, words), words)

    tokens, distinct = n_train + n_docs, n_known + (n_docs > 0)
    own_words = np.zeros(words.size)  # training words of each item
    own_words[:words.items] = words.train[words.item >= 0] > 0
    for r in mapped(counts, endings, "ending int, n long").groupBy("ending").agg(F.sum("n").alias("n")).collect():
        own_words[words.items + r["ending"]] = r["n"]
    own_words[words.end] = n_docs > 0
    n_class, n_words = g.sum(axis=0), np.bincount(classes, own_words, CLASSES)
    share = (n_class + 1) / (n_class.sum() + CLASSES)
    kinds = (g > 0).sum(axis=1, keepdims=True) + 1.0
    turn = np.log10((g + kinds * share) / (g.sum(axis=1, keepdims=True) + kinds))
    spread = np.log10(n_class + n_words + 1)
    model = context.broadcast((words, classes, turn, spread, np.log10(n_docs + 1.0), np.log10(tokens + distinct + 1.0)))

    def ask(batches):
        for rows, data, offs in slices(batches):
            w, classes, turn, spread, log_end, log_all = model.value
            h, ending, before = words_of(data, offs)
            item, at = w.find(h, ending)
            n, size = np.diff(before), len(offs) - 1
            seq = classes[sequences(item, before, w.end)]
            steps = np.add.reduceat(turn[seq[:-1], seq[1:]] - spread[seq[1:]], before[:-1] + np.arange(size))
            doc, near = np.repeat(np.arange(size), n), at >= 0
            logs = np.bincount(doc[near], np.log10(w.train[at[near]] + 1.0), size) + log_end
            known = np.bincount(doc[near], w.train[at[near]] > 0, size) + (log_end > 0)
            local = np.stack([logs - log_all * (n + 1), logs + steps, n + 1.0, known, np.ones(size)], axis=1)
            ids, ths = rows.column("doc_id").cast(pa.int64()), rows.column("th").to_numpy()
            null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            order = np.argsort(h[~near])
            far_h, far_doc = h[~near][order], doc[~near][order]
            cuts = np.searchsorted(part_of(far_h, parts), np.arange(parts + 1))
            home = part_of(mix(ths.view(np.uint64)), parts)  # where the document's local sums go
            out = []
            for p in np.unique(np.concatenate([home, np.flatnonzero(np.diff(cuts))])):
                hs, ds = far_h[cuts[p]:cuts[p + 1]], far_doc[cuts[p]:cuts[p + 1]]
                some = np.unique(np.concatenate([ds, np.flatnonzero(home == p)]))
                out.append((p, hs.tobytes(), np.searchsorted(some, ds).astype("<u4").tobytes(), ids[some].tobytes(), null[some].tobytes(),
                            ths[some].tobytes(), np.where((home[some] == p)[:, None], local[some], 0.0).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), *[pa.binary()] * 6))],
                                             names=["part", "h", "doc", "ids", "null", "ths", "local"])

    def answer(key, table, asked):
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in table.h]) if len(table) else np.zeros(0, np.uint64)
        train = np.concatenate([np.frombuffer(x, np.int64) for x in table.train]) if len(table) else np.zeros(0, np.int64)
        out = []
        for x in asked.itertuples(index=False):
            ids, ths = np.frombuffer(x.ids, np.int64), np.frombuffer(x.ths, np.int64)
            want, doc = np.frombuffer(x.h, np.uint64), np.frombuffer(x.doc, "<u4")
            n = train[np.searchsorted(h, want)] if len(want) else np.zeros(0, np.int64)
            logs = np.bincount(doc, np.log10(n + 1.0), len(ids))
            sums = np.stack([logs, logs, np.zeros(len(ids)), np.bincount(doc, n > 0, len(ids)), np.zeros(len(ids))], axis=1)
            sums += np.frombuffer(x.local).reshape(-1, 5)
            out.append(pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "th": ths} | {c: sums[:, i] for i, c in enumerate(cols)}))
            out[-1].loc[np.frombuffer(x.null, bool), "doc_id"] = pd.NA
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("doc_id", "th", *cols)})

    cols = ["base_score", "score", "n_tokens", "n_known", "copies"]
    asked = mapped(base, ask, "part int, h binary, doc binary, ids binary, null binary, ths binary, local binary")
    each = counts.select("part", "h", "train").groupBy("part").cogroup(asked.groupBy("part")).applyInPandas(
        answer, "doc_id long, th long, " + ", ".join(f"{c} double" for c in cols))
    total = each.groupBy("doc_id", "th").agg(*(F.sum(c).alias(c) for c in cols))
    return total.select("doc_id", "th", *(F.round(F.col(c) / F.col("copies")).cast("long").alias(c) for c in ("n_tokens", "n_known")),
                        F.lit(tokens).cast("long").alias("train_tokens"), *((F.col(c) / F.col("copies")).alias(c) for c in ("base_score", "score")))


def op2_class_lm(spark: SparkSession, sf: str) -> DataFrame:
    """Learns from the documents whose crc32 remainder is not 2, scores all."""
    out = score(documents(spark, sf).withColumn("train", crc_mod(7) != 2))
    return out.select("doc_id", (crc_mod(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op2_class_lm": op2_class_lm}
SQL: dict[str, str] = {}
