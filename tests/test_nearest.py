"""Searches over every stated query, against plain loops and SQL."""

import math
import random

import duckdb

from litforge.operators.extract import nearest
from litforge.plans.queries import ORACLES, QUERIES

D = "/root/testdata/sf0.01"


def test_all_queries_in_blocks(spark):
    rng = random.Random(20)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(400)]
    rows = [(i, v if any(v) else [1.0] * 4) for i, v in rows] + [(400, None), (420, [0.0] * 4), (440, [math.nan, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r.query_id, r.r, r.vec_id, r.similarity) for r in nearest(df.where("vec_id % 20 = 0"), df, 5, block=6).collect())
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 6)
    want = []
    for q, a in rows[:400:20]:
        best = sorted((-cos(a, b), i) for i, b in rows[:400] if i != q)[:5]
        want += [(q, n, i, -s + 0.0) for n, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)


def test_queries_take_every_twentieth_row(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{D}/embeddings.parquet'")
    stated = {i for (i,) in con.execute("select vec_id from embeddings where vec_id % 20 = 0").fetchall()}
    got = [(r.query_id, r.vec_id, r.similarity) for r in QUERIES["nearest_k"](spark, D).collect()]
    assert {q for q, _, _ in got} == stated and len(stated) > 3
    assert sorted(got) == sorted(con.execute(ORACLES["nearest_k"]).fetchall())
    got = [tuple(r) for r in QUERIES["accuracy_at_k"](spark, D).collect()]
    assert got == [tuple(map(float, r)) for r in con.execute(ORACLES["accuracy_at_k"]).fetchall()]
