"""Words of a batch are followed in pieces of bounded size."""

import pyarrow as pa

from litforge.operators import entities


def test_pieces_of_a_batch():
    n = entities.WORDS
    lists = [[1] * (n // 3)] * 7 + [None, [], [2] * (2 * n), [], [3]]
    batch = pa.RecordBatch.from_pydict({"i": list(range(len(lists))), "w": pa.array(lists, pa.list_(pa.int64()))})
    pieces = list(entities._pieces([batch, batch.slice(0, 0), batch.slice(8, 3)], "w"))
    assert [i for p in pieces for i in p.column("i").to_pylist()] == [*range(len(lists)), 8, 9, 10]
    for p in pieces:
        sizes = [len(w or ()) for w in p.column("w").to_pylist()]
        assert sum(sizes) <= n or sum(s > 0 for s in sizes) == 1


def test_rows_of_several_pieces(spark):
    text = "x " * 40_000 + "green fever"
    df = spark.createDataFrame([(i, text if i % 3 else None) for i in range(12)], "id long, text string").coalesce(1)
    terms = spark.createDataFrame([(1, "green fever"), (2, "fever")], "term_id long, term string")
    for block in (1, 10):
        got = {r.id: [tuple(e) for e in r.entities] for r in entities.matched(df, terms, block_words=block).collect()}
        assert got == {i: [(40_000, 2, 1)] if i % 3 else [] for i in range(12)}
