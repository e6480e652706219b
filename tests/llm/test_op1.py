import hashlib

import duckdb
from pyspark.sql import functions as F

from litforge.llm.op1_mix import OP1_SQL, expected_copies, mix, op1_mix


def u(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def plain(rows, weights, seed=1):
    size = {}
    for _, s, t in rows:
        size[s] = size.get(s, 0) + len(t or "")
    total, w = sum(size.values()), {s: weights(s, n) if n else 0.0 for s, n in size.items()}
    rate = {s: w[s] / sum(w.values()) * total / size[s] if size[s] else 0.0 for s in size}
    return sorted((str(i), str(s), c) for i, s, t in rows for c in range(1, expected_copies(rate[s], u(seed, "" if i is None else i, hashlib.md5((t or "").encode()).hexdigest())) + 1) if t != "again")


ROWS = [(i, ["a", "a", "a", "b", None][i % 5], "x" * (i % 7)) for i in range(400)] + [(500, "empty", None), (501, "empty", ""), (None, "b", "xyz"), (7, "a", "again"), (7, "a", "again")]


def test_matches_plain(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, source string, text string, copy int").repartition(5)
    want = plain(ROWS, lambda s, n: n**0.5)
    for limit in (10_000, 1):  # broadcast, and the join of salted slices
        got = mix(df, broadcast_sources=limit).where("text is distinct from 'again'").collect()
        assert sorted((str(r.doc_id), str(r.source), r.copy) for r in got) == want
    named = {"a": 1.0, "b": 9.0}
    got = mix(df, weights=named).where("text is distinct from 'again'").collect()
    assert sorted((str(r.doc_id), str(r.source), r.copy) for r in got) == plain(ROWS, lambda s, n: named.get(s, 0.0))
    assert mix(df.where("false")).count() == 0


def test_columns_of_any_name(spark):
    names = ["doc_id", "source", "text", "_rate", "_cdf", "_n", "_source", "_slice", "_salt", "id", "row", "size", "Place"]
    df = spark.createDataFrame([(*r, *range(10)) for r in ROWS], "doc_id long, source string, text string, " + ", ".join(f"{n} int" for n in names[3:]))
    for limit in (10_000, 1):
        got = mix(df, broadcast_sources=limit)
        assert got.columns == [*names[:-1], "rate", "copy", "place"]
        rows = got.where("text is distinct from 'again'").collect()
        assert sorted((str(r.doc_id), str(r.source), r.copy) for r in rows) == plain(ROWS, lambda s, n: n**0.5)
        assert {tuple(r)[3:12] for r in rows} == {tuple(range(9))}


def test_large_rates(spark):
    rows = [(i, "rare" if i < 20 else "big", "x" * 10) for i in range(2000)]
    got = mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), weights={"rare": 1.0, "big": 1.0}).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in got}
    assert 850 < n["rare"] < 1150 and 900 < n["big"] < 1100


def test_ids_and_rows_that_repeat(spark):
    rows = [(i, "web", f"text {i} of its own") for i in range(6000)]
    for more in ([(None, "web", f"without an id {i}") for i in range(3000)], [(7, "web", f"one id {i}") for i in range(3000)], [(None, "web", "one and the same row")] * 3000):
        df = spark.createDataFrame(rows + more, "doc_id long, source string, text string").repartition(4)
        for limit in (1 << 20, 0):
            got = mix(df, budget=1.2 * sum(len(t) for _, _, t in rows + more), broadcast_numbers=limit)
            n = got.count()
            of_more = got.where("text like 'without%' or text like 'one %'").count()
            assert abs(n - 1.2 * 9000) < 5 * (1.2 * 9000) ** 0.5 and abs(of_more - 3600) < 5 * 60
        sizes = sorted(r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())
        assert sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    assert sorted(tuple(r) for r in op1_mix(spark, d).collect()) == sorted(con.execute(OP1_SQL).fetchall())
