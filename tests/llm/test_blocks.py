"""Near duplicates don't depend on the size of the blocks in which buckets are compared."""

import pytest

from tabforge.llm import op03_bagminhash as M
from tabforge.llm.common import documents


@pytest.mark.parametrize("block", [2, 5])
def test_any_block_size(spark, monkeypatch, block):
    base = " ".join(f"w{i}" for i in range(200))
    # a large group of near copies and many texts that share half of it
    rows = [(i, base + f" tail{i} end") for i in range(40)] + [
        (100 + i, " ".join(f"w{j}" for j in range(130)) + " " + " ".join(f"own{i}x{j}" for j in range(60))) for i in range(40)]
    docs = documents(spark, "/root/testdata/sf0.001").select("doc_id", "text").union(
        spark.createDataFrame([(10_000 + i, t) for i, t in rows], "doc_id long, text string"))
    want = {(r.doc_id, r.th): r["first"] for r in M.near_duplicates(docs).collect()}
    monkeypatch.setattr(M, "BLOCK", block)
    assert {(r.doc_id, r.th): r["first"] for r in M.near_duplicates(docs).collect()} == want
    assert len({want[k] for k in want if 10_000 <= k[0] < 10_100}) == 1
