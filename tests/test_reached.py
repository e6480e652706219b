"""Rounds of chains send no table through the driver."""

from plans import ran

from litforge.operators import graph


def test_rounds_without_broadcasts(spark, tmp_path):
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(6, 0)], "src long, dst long")
    found = []
    plans = ran(spark, lambda: found.extend(graph.reached(edges, str(tmp_path), edges.select("src")).collect()))
    assert {tuple(r) for r in found} == {(a, (a + h) % 7, h) for a in range(7) for h in range(1, 7)}
    assert len(plans) > 6 and not any("Broadcast" in p for p in plans)
