"""Abbreviations and sentences that are learned, on planted cases."""

from pyspark.sql import functions as F

from litforge.operators import language


def test_long_forms(spark):
    cases = [
        ("heat shock protein", "HSP", "heat shock protein"), ("we saw acquired immune deficiency syndrome", "AIDS", "acquired immune deficiency syndrome"),
        ("the gamma interferon of gamma interferon", "GI", "gamma interferon"), ("nothing that fits", "QRS", None), ("a b c d e f g h", "AH", None),
        ("polymerase chain reaction", "PcR", "polymerase chain reaction"), ("Interleukin-2", "IL-2", "Interleukin-2"), ("see", "SEE", None), ("in the year", "1999", None), ("Überflüssige Maße", "ÜM", "Überflüssige Maße"),
    ]
    df = spark.createDataFrame([(w + " ", s) for w, s, _ in cases], "w string, s string")
    assert [r[0] for r in df.select(language.long_form(F.col("w"), F.col("s"))).collect()] == [x for _, _, x in cases]


def test_own_definition_goes_before_the_corpus(spark):
    rows = [(1, "the fast path (FP) is a FP"), (2, "a fast path (FP) now"), (3, "a full page (FP) and FP"), (4, "FP alone FP."), (5, None), (None, "FP here"), (6, "a rare thing (RT) once"), (7, "RT")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = language.definitions(docs)
    known = language.dictionary(found)
    assert [tuple(r) for r in known.collect()] == [("FP", "fast path")]
    got = {r.doc_id: r.expanded for r in language.expanded(docs, found, known).collect()}
    assert got == {1: "the fast path (FP) is a fast path", 2: "a fast path (FP) now", 3: "a full page (FP) and full page", 4: "fast path alone FP.", 5: None, None: "fast path here", 6: "a rare thing (RT) once", 7: "RT"}
    assert language.dictionary(found, share=0.7).count() == 0


def test_planted_abbreviations_do_not_split(spark):
    rows = [(i, f"Here word{i} met dr. Green. They left town{i % 9} and dr. Brown stayed. End it, e.g. now! \"Done.\" Then all") for i in range(200)] + [(300, "green and stayed " * 30)] + [(900, ""), (901, None), (None, "No stop and dr. Who")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = language.abbreviations(docs)
    assert {r.kind for r in known.collect()} == {"dr", "e.g"}
    got = {r.doc_id: r.sentences for r in language.sentences(docs, known).collect()}
    assert got[3] == ["Here word3 met dr. Green.", "They left town3 and dr. Brown stayed.", "End it, e.g. now!", '"Done."', "Then all"]
    assert got[900] == [] and got[901] is None and got[None] == ["No stop and dr. Who"]
