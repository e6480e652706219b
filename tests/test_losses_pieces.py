"""Texts are aligned a few rows of a batch at a time."""

import pyarrow as pa

from litforge.operators import losses


def test_pieces_of_a_batch():
    batch = pa.RecordBatch.from_pydict({"n": list(range(1000))})
    pieces = list(losses._pieces([batch, batch.slice(0, 0), batch.slice(5, 1)]))
    assert max(p.num_rows for p in pieces) <= losses.ROWS
    assert [n for p in pieces for n in p.column("n").to_pylist()] == [*range(1000), 5]


def test_rows_of_several_pieces(spark):
    df = spark.createDataFrame([(i, f"a w{i} b" if i % 7 else None, "a b") for i in range(300)], "id long, x string, y string").coalesce(1)
    got = {r.id: [(s.start, s.words, s.text) for s in r.lost] for r in losses.lost_spans(df, "x", "y").collect()}
    assert got == {i: [(1, 1, f"w{i}")] if i % 7 else [] for i in range(300)}
