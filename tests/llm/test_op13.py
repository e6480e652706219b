import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from litforge.llm.op13_dominance import OP13_SQL, WaveletMatrix, dominance, op13_dominance

D = "/root/testdata/sf0.001"


def brute(rows):
    out = []
    for s, k, _ in rows:
        if s is None or k is None:
            out.append((None, None))
            continue
        above = [w or 0 for t, l, w in rows if t is not None and l is not None and t <= s and l > k]
        out.append((len(above), sum(above)))
    return out


def test_matrix_answers_prefixes():
    rng = np.random.default_rng(13)
    for n in (1, 2, 7, 64, 301):
        ranks, weights = rng.integers(0, max(1, n // 2), n), rng.integers(-3, 9, n)
        m = WaveletMatrix(ranks, [weights, np.ones(n, dtype=np.int64)])
        prefix, rank = rng.integers(0, n + 1, 200), rng.integers(0, max(1, n // 2), 200)
        want = [(weights[:p][ranks[:p] > r].sum(), (ranks[:p] > r).sum()) for p, r in zip(prefix, rank, strict=True)]
        assert list(zip(*m.above(prefix, rank), strict=True)) == want


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_matches_brute_force(spark, shards):
    rng = random.Random(shards)
    rows = [(rng.randrange(-5, 12), rng.randrange(-3, 9), rng.randrange(4)) for _ in range(300)]
    rows += [(4, 2, 1)] * 200 + [(4, k, 1) for k in range(60)] + [(s, 5, None) for s in range(60)]  # a hot cell, slot and level
    rows += [(None, 3, 1), (2, None, 1), (None, None, None)] * 5
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, slot long, level long, w long").repartition(3)
    got = sorted(tuple(r) for r in dominance(df, F.col("slot"), F.col("level"), F.col("w"), shards).select("id", "n_above", "w_above").collect())
    assert [g[1:] for g in got] == brute(rows)


def test_columns_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 2, "a", {"x": 1}), (1, 2, "a", {"x": 1}), (0, 9, None, None)], "slot int, level int, salt string, w map<string,int>").withColumn("n_above", F.lit("x")).withColumn("row", F.lit(7)).withColumn("chunk", F.lit(0))
    out = dominance(df, F.col("slot"), F.col("level"), F.lit(2))
    assert out.columns == ["slot", "level", "salt", "w", "row", "chunk", "n_above", "w_above"]
    assert sorted((r["slot"], r["n_above"], r["w_above"]) for r in out.collect()) == [(0, 0, 0), (1, 1, 2), (1, 1, 2)]
    none = df.where("slot > 5")
    assert dominance(none, F.col("slot"), F.col("level"), F.lit(1)).collect() == []
    only = df.select(F.lit(None).cast("long").alias("slot"), "level")
    assert {(r["n_above"], r["w_above"]) for r in dominance(only, F.col("slot"), F.col("level"), F.lit(1)).collect()} == {(None, None)}


def test_query_matches_sql_in_any_zone(spark):
    con = duckdb.connect()
    con.execute(f"create view sales as select * from '{D}/sales.parquet'")
    want = sorted(con.execute(OP13_SQL).fetchall())
    zone = spark.conf.get("spark.sql.session.timeZone")
    for z in ("UTC", "Pacific/Auckland"):
        spark.conf.set("spark.sql.session.timeZone", z)
        assert sorted(tuple(r) for r in op13_dominance(spark, D).collect()) == want
    spark.conf.set("spark.sql.session.timeZone", zone)
    assert len(want) > 100


def test_no_join_copies_a_table(spark):
    plan = op13_dominance(spark, D)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
