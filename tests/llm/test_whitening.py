"""Whitening against plain numpy over all rows."""

import numpy as np
import pytest

from tabforge.llm import op11_whitening as W
from tabforge.llm.common import documents


def plain(vectors, by_count=False, components=16):
    """{key of x: (n, deviation, |whitened|, explained)} of usable vectors of one length."""
    x = np.array([np.floor(64 * np.asarray(v, dtype=np.float64)).astype(np.int64) for v in vectors]) + 1_000_000
    u, counts = np.unique(x, axis=0, return_counts=True)
    w = counts if by_count else np.ones(len(u), np.int64)
    n, s = int(w.sum()), (w[:, None] * u).sum(axis=0)
    c = u - s / n
    e, v = np.linalg.eigh((c.T * w) @ c / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    total = np.trace((c.T * w) @ c / n)
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return n, dev, (x - s / n) @ v / np.sqrt(e), e / total


@pytest.mark.parametrize("by_count", [False, True])
def test_table(spark, by_count):
    df = documents(spark, "/root/testdata/sf0.001", "embeddings")
    copies = df.union(df.where("vec_id % 3 = 0")).repartition(3)
    rows = copies.select("vec_id", "embedding").collect()
    n, dev, white, share = plain([r.embedding for r in rows], by_count)
    got = {}
    out = W.whiten(copies, by_count=by_count).collect()
    assert len(out) == len(rows) * 16
    for r in out:
        got.setdefault(r.vec_id, {})[r.component] = r
        assert r.n == n and abs(r.explained / share[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    signs = np.sign([white[0][c] * got[rows[0].vec_id][c + 1].whitened for c in range(16)])
    for r, d, w in zip(rows, dev, white):
        assert got[r.vec_id][1].deviation == d
        assert np.allclose([got[r.vec_id][c + 1].whitened for c in range(16)], w * signs, atol=1e-8)


def test_odd_rows(spark):
    rows = [(1, [0.5, 1.0, 2.0]), (1, [0.5, 1.0, 2.0]), (2, [1.5, -1.0, 0.25]), (3, None), (4, [None, 1.0, 2.0]), (5, [float("nan"), 1.0, 2.0]),
            (6, [float("inf"), 1.0, 2.0]), (7, []), (None, [300.0, -9.0, 400.0]), (8, [1.0, 2.0]), (9, [1.0, 2.0]), (10, [3.0])]
    df = spark.createDataFrame([(a, b, 1, 2, 3) for a, b in rows], "vec_id long, embedding array<double>, _k int, dims int, n int")
    out = W.whiten(df).collect()
    kept = [r for r in rows if r[1] and len(r[1]) == 3 and r[0] not in (4, 5, 6)]
    n, dev, white, _ = plain([v for _, v in kept], components=2)  # three points span two components
    assert n == 3 and sorted((r.vec_id or 0, r.component) for r in out) == sorted((i or 0, c) for i, _ in kept for c in (1, 2))
    assert {(r.vec_id, r.deviation) for r in out} == {(i, d) for (i, _), d in zip(kept, dev)}
    assert all(r.identity_error < 1e-9 for r in out)
    assert W.whiten(df.limit(0)).count() == 0
    assert W.whiten(df.where("vec_id = 3")).count() == 0


def test_entries_beyond_longs(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [5.0, 1e300])], "vec_id long, embedding array<double>")
    out = W.whiten(df).collect()
    assert len(out) == 6 and all(r.deviation is None for r in out) and all(np.isfinite(r.whitened) for r in out)


def test_a_third_is_one_vector(spark, monkeypatch):
    monkeypatch.setattr(W, "HOT", 4)
    rows = [(i, [1.0, 2.0] if i % 3 == 0 else [float(i % 7), float(i % 11)]) for i in range(300)]
    out = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    n, dev, white, _ = plain([v for _, v in rows])
    assert len(out) == 600 and all(r.n == n and r.deviation == dev[r.vec_id] for r in out)
    assert np.allclose([abs(r.whitened) for r in sorted(out, key=lambda r: (r.vec_id, r.component))], np.abs(white).ravel())
