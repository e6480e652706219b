"""A paper's chains: no side of the join goes through the driver."""

from plans import ran

from litforge.operators import sections


def test_chains_without_broadcasts(spark):
    microbes = spark.createDataFrame([(i, n) for i in range(30) for n in ("a", "a", "b")], "paper_id long, taxon_name string")
    made = spark.createDataFrame([(i, ["a", "z"], f"m{i}", "o") for i in range(30)], "paper_id long, produced_by array<string>, name string, associated_outcome string")
    found = []
    plans = ran(spark, lambda: found.extend(sections.chains(microbes, made, "paper_id").collect()))
    assert {tuple(r) for r in found} == {(i, "a", f"m{i}", "o") for i in range(30)} and len(found) == 30
    assert plans and not any("Broadcast" in p for p in plans)
