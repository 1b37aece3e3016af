"""Checkpoints and connected components: files that stay, and both ways of joining labels."""
import random
import time

import pytest

from tabforge.llm import common, components


def _shuffled(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_")}


def test_cut_leaves_no_shuffle_files(spark):
    df = spark.range(0, 10_000, 1, 4).selectExpr("id % 97 as k").groupBy("k").count()
    before, conf = _shuffled(spark), spark.conf.get(common.CLEANUP, None)
    out = common.cut(df)
    for _ in range(100):  # files are removed in the background
        if not (left := _shuffled(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(common.CLEANUP, None) == conf
    assert out.count() == df.count() == 97
    assert {r["count"] for r in out.collect()} == {103, 104}


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_components_with_and_without_broadcast(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW", few)
    monkeypatch.setattr(components, "FEW", few)
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7), (9, 8), (9, 8)]
    top = {}

    def root(v):
        while top.setdefault(v, v) != v:
            v = top[v]
        return v
    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        top[y] = x
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.v, r.c) for r in got) == sorted((v, root(v)) for v in list(top))
