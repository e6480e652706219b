"""Relation graphs, kept states and the vector index against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from litforge.operators import graph, index
from litforge.operators.extract import nearest, violations
from litforge.streaming import events as streams


def plain_reach(edges):
    onward = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            onward.setdefault(a, set()).add(b)
    out = set()
    for s in onward:
        seen, now, hops = {s}, {s}, 0
        while now:
            hops += 1
            now = {b for a in now for b in onward.get(a, ())} - seen
            out |= {(s, b, hops) for b in now}
            seen |= now
    return out


def test_chains_with_cycles(spark, tmp_path):
    rng = random.Random(1)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(25)] + [(125, 100), (7, 7), (None, 3), (3, None), (5, 6), (5, 6)]
    df = spark.createDataFrame([(*e, "r") for e in edges], "src long, dst long, rel string")
    assert {tuple(r) for r in graph.reached(df, f"{tmp_path}/a").collect()} == plain_reach(edges)
    some = graph.reached(df, f"{tmp_path}/b", spark.createDataFrame([(100,), (5,), (5,), (999,)], "src long"))
    assert {tuple(r) for r in some.collect()} == {x for x in plain_reach(edges) if x[0] in (100, 5)}
    assert graph.reached(df.where("false"), f"{tmp_path}/c").collect() == []
    with pytest.raises(RuntimeError, match="3 rounds"):
        graph.reached(df, f"{tmp_path}/d", most=3)


def test_together_with_a_hot_group(spark):
    rng = random.Random(2)
    rows = [("hot", i) for i in range(400)] + [(f"g{rng.randrange(40)}", rng.randrange(50)) for _ in range(400)] + [("g1", 3), ("g1", 3), (None, 4), ("g1", None)]
    groups = {}
    for g, i in rows:
        if g is not None and i is not None:
            groups.setdefault(g, set()).add(i)
    want = Counter((a, b) for s in groups.values() for a in s for b in s if a < b)
    got = graph.together(spark.createDataFrame(rows, "g string, item long"), "g", "item")
    assert {(r.item_1, r.item_2): r.n for r in got.collect()} == want
    plan = got._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_state_outlives_a_crash(spark, tmp_path):
    docs = [(i, "\n".join(f"line {i % 5} {k}" for k in range(4))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {tuple(r) for r in streams.first_chunks(df).collect()}
    for i in range(4):
        df.where(f"doc_id % 4 = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        if i == 2:  # a run that dies after the state is taken in and a part of the output is there
            def broken(changed, batch):
                changed.limit(1).write.mode("overwrite").parquet(f"{tmp_path}/state/batch={batch}")
                raise OSError("lost")

            with pytest.raises(Exception, match="lost"):
                streams.first_chunks(stream).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).foreachBatch(broken).start().awaitTermination()
        streams.keep(streams.first_chunks(stream), f"{tmp_path}/state", f"{tmp_path}/check")
    assert {tuple(r) for r in streams.latest(spark, f"{tmp_path}/state", ["chunk_md5"]).collect()} == want
    streams.compact(spark, f"{tmp_path}/state", f"{tmp_path}/next", ["chunk_md5"])
    assert {tuple(r) for r in streams.latest(spark, f"{tmp_path}/next", ["chunk_md5"]).collect()} == want


def test_index_recall_and_edges(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asked = vectors.where("vec_id % 20 = 0")
    exact = {(r.query_id, r.vec_id) for r in nearest(asked, vectors).collect()}
    c = index.fit(vectors)
    for size in (20_000, 7):
        found = index.search(asked, index.assigned(vectors, c), c, slice_rows=size).collect()
        got = {(r.query_id, r.vec_id) for r in found}
        assert len(got & exact) / len(exact) >= 0.9
        assert all(r.query_id != r.vec_id and 1 <= r.r <= 10 for r in found)
    # with all cells probed it is exact, whatever the slices
    every = {(r.query_id, r.vec_id, r.similarity, r.r) for r in index.search(asked, index.assigned(vectors, c), c._replace(probes=len(c.centroids)), slice_rows=11).collect()}
    assert every == {(r.query_id, r.vec_id, r.similarity, r.r) for r in nearest(asked, vectors).collect()}
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (None, [1.0, 1.0]), (6, [1.0, 0.5]), (6, [1.0, 0.5])], "vec_id long, embedding array<double>")
    c = index.fit(odd, cells=2)._replace(probes=2)
    got = index.search(odd, index.assigned(odd, c), c).where("query_id = 1").collect()
    assert [(r.vec_id, r.r) for r in got] == [(6, 1), (6, 2)]
    none = odd.where("false")
    assert index.search(none, index.assigned(none, c), c).collect() == [] and index.search(odd, none.withColumn("cell", F.lit(0)), index.fit(none)).collect() == []
    assert np.isfinite(c.centroids).all()


def test_clustered_vectors_need_few_cells(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.15 * rng.normal(size=16)).tolist()) for i in range(4000)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked, c = vectors.where("vec_id % 20 = 0"), index.fit(vectors, cells=40)
    assert c.probes <= 4
    exact = {(r.query_id, r.vec_id) for r in nearest(asked, vectors).collect()}
    got = {(r.query_id, r.vec_id) for r in index.search(asked, index.assigned(vectors, c), c).collect()}
    assert len(got & exact) / len(exact) >= 0.9


def test_domains_by_field(spark):
    rows = spark.createDataFrame([("day_12", "day_12", None, "x"), ("oral_subsite_", "followup_", "temporal", None), ("uterine", "year_2", "dose", None)], "sample_site string, temporal_context string, change_context string, violations string")
    assert [r.violations for r in violations(rows, "microbe_relationships").collect()] == [["sample_site"], ["sample_site", "temporal_context"], ["change_context"]]
    assert [r.violations for r in violations(rows.select("sample_site"), "virus_associations").collect()] == [[]] * 3
