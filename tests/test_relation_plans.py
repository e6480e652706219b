"""Joins of papers' entries send no table through the driver."""

from plans import ran

from litforge.operators import graph

PAPER = '{"disease": {"primary_disease": "d%d"}, "intervention": "i%d", "microbe_relationships": [{"taxon_name": "a", "change_context": "x"}, {"taxon_name": "b", "change_context": "treatment_effect"}, {"taxon_name": "c"}], "metabolites": [{"name": "m", "produced_by": ["a"], "associated_outcome": "o"}]}'


def papers(spark):
    return spark.createDataFrame([(i, PAPER % (i, i)) for i in range(20)], "paper_id long, j string")


def test_edges_without_broadcasts(spark):
    found = []
    plans = ran(spark, lambda: found.extend(graph.relations(papers(spark), "j", "paper_id").collect()))
    assert plans and not any("Broadcast" in p for p in plans)
    of = {(r.src, r.dst, r.rel) for r in found if r.id == 7}
    assert of == {("a", "d7", graph.RELATIONS[0]), ("c", "d7", graph.RELATIONS[0]), ("i7", "b", graph.RELATIONS[1]), ("a", "m", graph.RELATIONS[2]), ("m", "o", graph.RELATIONS[3])}
