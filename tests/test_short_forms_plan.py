"""Of the words of texts only known short forms are shuffled."""

from plans import shuffled

from litforge.operators import language


def test_words_that_are_no_short_forms_stay(spark, tmp_path):
    plain = " ".join(f"w{i}" for i in range(500))
    docs = [(i, f"{plain} the Greatly Narrowed Path (GNP) and GNP" if i % 2 else f"{plain} GNP") for i in range(60)]
    docs = spark.createDataFrame([*docs, (0, "GNP again"), (1, "an Other Way (OW) OW"), (None, "GNP"), (99, None)], "doc_id long, text string")
    found = language.definitions(docs)
    for name, df in (("found", found), ("known", language.dictionary(found))):
        df.write.parquet(f"{tmp_path}/{name}")
    got = []
    n = shuffled(spark, lambda: got.extend(language.expanded(docs, *(spark.read.parquet(f"{tmp_path}/{x}") for x in ("found", "known"))).collect()))
    assert n < 1000  # it was a row for each different word of each text
    want = [(i, f"{plain} the Greatly Narrowed Path (GNP) and greatly narrowed path" if i % 2 else f"{plain} greatly narrowed path") for i in range(60)]
    want += [(0, "greatly narrowed path again"), (1, "an Other Way (OW) other way"), (None, "greatly narrowed path"), (99, None)]
    assert sorted(((r.doc_id, r.expanded) for r in got), key=str) == sorted(want, key=str)
