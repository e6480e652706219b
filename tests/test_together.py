"""Items of small groups are not multiplied on their way; groups of several slices are whole."""

from collections import Counter

from plans import shuffled

from litforge.operators import graph


def test_small_groups_are_sent_once(spark):
    df = spark.range(8000).selectExpr("id div 4 as g", "id % 4 + 10 * (id div 400) as i")
    got = []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large for it
    try:
        n = shuffled(spark, lambda: got.extend(graph.together(df, "g", "i").collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(r.n for r in got) == 2000 * 6
    assert n < 8 * 8000  # it was 64 times the rows


def test_groups_of_several_slices(spark, monkeypatch):
    monkeypatch.setattr(graph, "SLICE", 16)
    groups = {"big": range(150), "next": range(100, 140), "one": range(16), "two": range(17)}
    rows = [(g, str(i)) for g, s in groups.items() for i in s for _ in range(1 + i % 2)]
    want = Counter((str(a), str(b)) for s in groups.values() for a in s for b in s if str(a) < str(b))
    assert {(r.item_1, r.item_2): r.n for r in graph.together(spark.createDataFrame(rows, "g string, i string"), "g", "i").collect()} == want
