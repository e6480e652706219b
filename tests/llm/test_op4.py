import zlib

from litforge.llm.op4_language_id import op4_language_id, predict, train


def test_held_out_accuracy(spark):
    rows = op4_language_id(spark, "/root/testdata/sf0.001").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    rows = [(1, "the cat and the dog", "en", "x"), (2, "der hund und die katze", "de", "x"), (3, "le chat et le chien", "fr", "x"), (4, None, "en", "x"), (5, "", None, "x"), (6, "12 34 !!", "en", "x"), (7, "the dog " * 60000, None, "x"), (7, "the dog and the cat", None, "x"), (None, "le chien", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = train(docs, "doc_id", "text", "lang")
    got = predict(docs.select("doc_id", "text", "score"), model).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert by[4] == by[5] == by[6] == [("und", 0.0)]
    assert by[1][0][0] == "en" and [x[0] for x in by[7]] == ["en", "en"] and by[None][0][0] == "fr"
    assert train(docs.where("false"), "doc_id", "text", "lang") is None
    assert {r.lang_pred for r in predict(docs.select("doc_id", "text"), None).collect()} == {"und"}
