import math
import random

import duckdb
import pytest

from litforge.llm.op8_top_k import OP8_SQL, op8_top_k, top_k


def brute(rows, k=10, every=100):
    """Every row but the query's own is a candidate; scores are exact and shown within 64 bits."""
    whole = lambda x: math.floor(1024 * x) if math.isfinite(1024 * x) else 1024 * int(x)
    fine = [(i, tuple(map(whole, v))) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(fine):
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(fine) if m != n)[:k]
            out += [(q, r, i, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [1.0, 1e5])
def test_matches_brute_force(spark, spread):
    rng = random.Random(8)
    rows = [(i, [round(rng.gauss(0, 1), 1) * spread for _ in range(6)]) for i in range(700)]
    rows += [(i, [0.5 * spread] * 6) for i in range(700, 760)] + [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [math.nan] * 6), (903, [math.inf] * 6), (904, [1.0]), (905, []), (None, [1.0])]
    rows += [(3, rows[3][1]), (100, rows[100][1]), (100, rows[100][1]), (200, rows[7][1]), (600, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in top_k(df.where("vec_id % 100 = 0"), df, block=3).collect())
    assert got == brute(rows)


def test_large_components_take_part(spark):
    rng = random.Random(80)
    rows = [(i, [rng.gauss(0, 1) * 10.0 ** rng.choice([0, 0, 0, 6, 9, 13, 40, 307, 308]) for _ in range(4)]) for i in range(300)]
    rows += [(300, [1e13, 0.0, 0.0, 0.0]), (301, [-1e13, 1.0, 0.0, 0.0]), (302, [1.7e308] * 4), (400, [-1.7e308] * 4), (303, [0.01, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for k in (10, 400):
        assert sorted(tuple(r) for r in top_k(df.where("vec_id % 100 = 0"), df, k=k).collect()) == brute(rows, k)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 7), (1, [1.0, -2.0], 7)], "vec_id long, embedding array<double>, score int")
    assert [tuple(r) for r in top_k(df.where("vec_id = 0"), df).collect()] == [(0, 1, 1, 1024 * 1024 - 4 * 1024 * 1024)]
    assert top_k(df.where("false"), df).count() == 0 and top_k(df.where("vec_id = 0"), df.where("false")).count() == 0


def test_sql(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    assert sorted(tuple(r) for r in op8_top_k(spark, d).collect()) == sorted(con.execute(OP8_SQL).fetchall())
    rows = [(i, [float(i % 7), -1.5]) for i in range(250)] + [(100, [1e9, 0.0]), (100, [2.0, -1.5]), (7, [0.01, 1.0])] + [(8, [1.0, -1.5])] * 3
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con.execute(f"create or replace view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(tuple(r) for r in op8_top_k(spark, str(tmp_path)).collect()) == sorted(con.execute(OP8_SQL).fetchall())
