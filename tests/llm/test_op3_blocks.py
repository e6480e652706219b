from litforge.llm.op3_decontaminate import contaminated


def test_blocks_give_each_row_its_verdict(spark):
    items = [(i, " ".join(f"w{i}x{j}" for j in range(12))) for i in range(30)]
    texts = [items[3][1], items[4][1] + " " + items[9][1], "clean words only here and there", None]
    docs = spark.createDataFrame([(i, t) for i in (7, None) for t in texts + texts[:1]], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda **more: sorted(map(str, map(tuple, contaminated(docs, bench, **more).collect())))
    for keep in (["doc_id"], ["doc_id", "text"], None):
        assert rows(keep=keep, block_bytes=300) == rows(keep=keep) and len(rows(keep=keep)) == 10


def test_blocks_write_verdicts_only(spark, monkeypatch):
    from litforge.llm import op3_decontaminate as op

    made = []
    monkeypatch.setattr(op, "written", lambda df, name: made.append(df.cache()) or made[-1])
    items = [(i, " ".join(f"w{i}x{j}" for j in range(12))) for i in range(30)]
    rows = [(i, items[i % 30][1] if i % 50 == 0 else f"clean text number {i} of many words", "_h", 1) for i in range(2000)] + [(5, items[0][1], "_h", 1)] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, _h string, _salt int")
    found = op.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=500)
    got = found.collect()
    assert found.columns[:3] == ["doc_id", "_h", "_salt"] and len(got) == 2500 and sum(r.n_items > 0 for r in got) == 540
    assert len(made) > 3 and sum(df.count() for df in made) <= 30 and "_text" not in {c for df in made for c in df.columns}
