"""op4's last join: a text is shuffled once."""

from pyspark.sql import functions as F

from tabforge.llm import op04_suffixes as SU


def test_last_join_has_each_text_once(spark):
    same = "a passage that two documents have in common, " * 5
    rows = [(1, "one " + same), (2, "two " + same), (3, None), (4, "short")]
    out = SU.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    node = out._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().apply(0)
    left = node.children().apply(0).output()
    assert sorted(left.apply(i).name() for i in range(left.size())) == ["d", "h", "row"]
    kept = {r.id: r for r in out.select(F.col("row.doc_id").alias("id"), "row.text", "spans", "kept").collect()}
    assert {i: kept[i].text for i in kept} == dict(rows)
    assert not kept[1].spans or kept[1].spans[0].lo > 4  # within itself: the passage repeats its own sentence
    assert bytes(kept[3].kept) == b"" and bytes(kept[4].kept) == b"short"
    assert len(bytes(kept[2].kept)) < len(bytes(kept[1].kept)) and kept[2].spans
