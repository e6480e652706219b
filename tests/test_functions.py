import json
import random

import pytest
from pyspark.sql import functions as F

from litforge.functions import jsonx, tags, text
from litforge.operators import corpus, extract, rollup
from litforge.sources import files


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("raw", "fallback", "post"),
    [
        ("word [1].", "word.", "word ."),
        ("a [1] b", "a  b", "a b"),
        ("x [2–5] y", "x  y", "x y"),
        ("x [1, 3-5] y", "x [1, 3-5] y", "x [1, 3-5] y"),
        ("e.g. this", "e. g. this", "e. g. this"),
        ("endStart", "endStart", "end. Start"),
        ("wait... ok", "wait... ok", "wait. ok"),
        ("a b c\x0bd\x1ce", "a b c d e", "a b c d e"),
    ],
)
def test_chains(spark, raw, fallback, post):
    assert one(spark, text.fallback_clean, raw) == fallback and one(spark, text.post_process, raw) == post


def test_junk_and_merge(spark):
    junk = lambda s: one(spark, text.is_junk, s)
    long = "x" * 40
    assert junk("y" * 29 + "   ") and not junk("y" * 30) and junk(f"[DOI] [PubMed] [PMC1] {long}") and not junk(f"[DOI] [PMC1] {long}")
    assert junk(f"10.1234/{long}") and not junk(f"10.123/{long}") and not junk(f"a 10.1234/{long}")
    rows = spark.createDataFrame([(["a" * 30 + ". ", "short", "b" * 30, "c" * 30],), (["no"],)], "c array<string>")
    assert [r[0] for r in rows.select(text.merge_chunks(F.col("c"))).collect()] == ["a" * 30 + ".  " + "b" * 30 + ". " + "c" * 30, ""]


def test_tolerant_json(spark):
    cases = ['{"a":1}', 'x\n```json\n{"a":1}\n```', 'so {"a":1} {"a":2}', '{"a":"}"', "", "[1]", "{}", '{"bacteria_relationships":null}', '{"bacteria_relationships":[{},{}]}']
    got = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", jsonx.extraction(F.col("t")).alias("e")).orderBy("i").collect()
    assert [(r.e.status, r.e.n) for r in got] == [("ok", 0)] * 3 + [("error", None)] * 3 + [("ok", 0), ("error", None), ("ok", 2)]


def test_tags(spark):
    files_ = spark.createDataFrame([("f", "# c\n\na\tO\nb B-X\nshort\n\n\nc\tI-X\r\nd\tI-Y")], "file string, value string")
    got = sorted((r.sent_id, r.pos, r.token, r.tag) for r in tags.conll(files_).collect())
    assert got == [(0, 0, "a", "O"), (0, 1, "b", "B-X"), (1, 0, "c", "I-X"), (1, 1, "d", "I-Y")]
    spans = tags.bio_spans(tags.conll(files_), ["file", "sent_id"], "pos", "tag")
    assert sorted((r.sent_id, r.type, r.start, r.end) for r in spans.collect()) == [(0, "X", 1, 1), (1, "X", 0, 0), (1, "Y", 1, 1)]
    scores = tags.span_scores(spans, spans.where("sent_id = 0"), ["file", "sent_id"])
    assert {r.type: (r.tp, round(r.f1, 4)) for r in scores.collect()} == {"X": (1, 0.6667), "Y": (0, 0.0)}
    wide = [["Crohn's", "x", ""], ["['B-D',", "O']", ""], ["", "", ""], ["y", "", ""], ["['O']", "", ""], ["tail", "", ""]]
    rows = spark.createDataFrame([("f", i, c) for i, c in enumerate(wide)], "file string, pos int, cells array<string>")
    assert [[tuple(p) for p in r.pairs] for r in tags.wide_bio(rows).orderBy("sent_id").collect()] == [[("Crohns", "B-D"), ("x", "O")], [("y", "O")]]
    ids = spark.createDataFrame([([None, 0, 0, 1, None], [7, 8])], "w array<int>, l array<int>").select(tags.align_labels(F.col("w"), F.col("l"))).first()[0]
    assert ids == [-100, 7, -100, 8, -100]


def test_corpus_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"p": {"name": "N", "chunks": ["x", "y"]}, "q": ["z"], "r": "s", "t": {"name": "u"}}))
    got = {r.article_id: r.chunks for r in files.article_corpus(spark, str(tmp_path / "a.json")).collect()}
    assert got["p"] == ["x", "y"] and got["q"] == ["z"] and got["r"] == ["s"] and json.loads(got["t"][0]) == {"name": "u"}
    (tmp_path / "b.json").write_text(json.dumps([{"id": "i", "chunks": ["a", "b"], "text": "t"}, {"text": "t"}, {}]))
    assert [(r.id, r.text) for r in files.paper_list(spark, str(tmp_path / "b.json")).orderBy("pos").collect()] == [("i", "a b"), ("paper_2", "t"), ("paper_3", "{}")]


def test_rollup_retry_and_order(spark):
    rows = spark.createDataFrame([("s", 2, None), ("s", 1, "a"), (None, 1, "b")], "study string, ord int, alias string")
    got = {r.study: (r.total, r.alias) for r in rollup.rollup(rows, "study", "ord", ["alias"]).collect()}
    assert got == {"s": (2, ["a", None]), "Unknown": (1, ["b"])}
    waits, calls = [], []

    def call(p):
        calls.append(p)
        raise ValueError("no")

    with pytest.raises(RuntimeError, match="3 attempts"):
        extract.with_retry(call, "p", sleep=waits.append)
    assert len(calls) == 3 and waits == [10.0, 10.0]
    shuffled = spark.range(1000).select((F.col("id") * 7919 % 100003).alias("k"))
    for slices in (None, 1, 2, 3, 40):
        assert all(a == b for b, a in enumerate(r.ord for r in corpus.ordinal(shuffled, "k", slices=slices).orderBy("k").collect()))


def test_strip_is_that_of_python(spark):
    assert set(text.SPACES) == {chr(i) for i in range(0x10000) if chr(i).isspace()}
    for s in ("", text.SPACES, f"{text.SPACES}a é{text.SPACES}b　", "​x​", "é"):
        assert one(spark, text.strip, s) == s.strip()


def test_ids_scan_marks_and_repair(spark):
    row = spark.createDataFrame([("a PMC123456 b doi:10.1000/x.y-z, c", "bro-\nken ﬁn\x0c x-\nY", "{'a': [1, 2,],}", "{\"a\": ", None)], "i string, s string, j string, k string, n string").select(
        text.drop_ids(F.col("i")).alias("i"), text.drop_scan_marks(F.col("s")).alias("s"), F.to_json(jsonx.repaired(F.col("j"))).alias("j"), jsonx.repaired(F.col("k")).isNull().alias("k"), text.drop_ids(F.col("n")).alias("n"), jsonx.repaired(F.col("n")).isNull().alias("m")
    ).first()
    assert tuple(row) == ("a  b , c", "broken fin x-\nY", '{"a":[1,2]}', True, None, True)


def test_models_without_keys():
    assert extract.with_keys({"a": "A_KEY", "b": "B_KEY", "c": "A_KEY"}, {"A_KEY": "x", "B_KEY": ""}) == (["a", "c"], ["B_KEY"])


def plain_wide(rows):
    """Two rows at a time, then past the blank ones, as the format's reader takes them."""
    clean = lambda x: (x or "").replace('"', "").replace("'", "").strip()
    empty = lambda row: not "".join(x or "" for x in row).strip()
    out, rest = [], list(rows)
    while len(rest) > 1:
        words, marks, *rest = rest
        words = [w for w in map(clean, words) if w]
        marks = [m for m in (clean(m) for m in "".join(x or "" for x in marks).replace("[", "").replace("]", "").split(",")) if m]
        if words and marks:
            out.append(list(zip(words, marks)))
        while rest and empty(rest[0]):
            rest = rest[1:]
    return out


def test_wide_rows_by_file(spark, tmp_path):
    rng = random.Random(7)
    made = {}
    for f in range(40):
        kinds = [["a%d" % f, "it's", ""], ["['O',", "B-X]"], ["", " "], [], ["'"], ["b", None, "c"], [",,O,"]]
        made[f"f{f}"] = [rng.choice(kinds) for _ in range(rng.randint(0, 14))]
    rows = spark.createDataFrame([(f, i, c) for f, cs in made.items() for i, c in enumerate(cs)], "file string, pos int, cells array<string>").repartition(5)
    got = {}
    for r in tags.wide_bio(rows).orderBy("file", "sent_id").collect():
        got.setdefault(r.file, []).append([tuple(p) for p in r.pairs])
        assert r.sent_id == len(got[r.file]) - 1
    assert got == {f: plain_wide(cs) for f, cs in made.items() if plain_wide(cs)}
    for name in ("x", "y"):
        (tmp_path / f"{name}.csv").write_text(f"C1,C2\n{name}0,{name}1\n\"['O',\",'B-X']\n,\n{name}2,\n['O'],\n")
    found = tags.numbered(tags.wide_bio(files.wide_rows(spark, str(tmp_path)))).orderBy("place").collect()
    assert [(r.place, [p.token for p in r.pairs]) for r in found] == [(0, ["x0", "x1"]), (1, ["x2"]), (2, ["y0", "y1"]), (3, ["y2"])]


def test_answers_are_read_as_stated(spark):
    cases = {
        'see {x} ```json prefix {"a":1} ```': {"a": 1},
        '{"a":1} ```json {bad ```': None,
        '```\nnone\n``` {"a":1}': None,
        '{"a":1,"a":2}': {"a": 2},
        '{"a":NaN,"b":2}': {"a": None, "b": 2},
        'x {"a":"}"}': None,
        "é {\"a\":\"é😀\"} y": {"a": "é😀"},
        "{{}": None,
        "}{}": {},
        "": None,
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = [r.j and json.loads(r.j) for r in rows.select("i", F.to_json(jsonx.tolerant(F.col("t"))).alias("j")).orderBy("i").collect()]
    want = list(cases.values())
    assert [g if g is None else {k: g.get(k) for k in w} for g, w in zip(got, want)] == want
    junk = lambda s: one(spark, text.is_junk, s)
    assert junk("é@b.cc " + "x" * 30 + " k@b.c m@d_x.org") and not junk("é@b.cc " + "x" * 30 + " k@b.c m@.")


def test_cells_and_requests():
    import pandas as pd

    book = json.dumps({"cells": [{"source": ["a"]}, {"source": ["b"], "outputs": [1], "execution_count": 2}]})
    new = json.loads(jsonx.with_cell.func(pd.Series([book]), pd.Series([1]), pd.Series(["x\ny"]))[0])
    assert new["cells"] == [{"source": ["a"]}, {"source": ["x\n", "y"], "outputs": [], "execution_count": None}]
    assert extract.request("chat", "m", "s", "u")["messages"][1] == {"role": "user", "content": "u"}
    with pytest.raises(ValueError):
        extract.request("other", "m", "s", "u")
    count = []
    call = extract.loaded(lambda: count.append(1) or str.upper)
    assert [call("m", "a"), call("m", "b")] == ["A", "B"] and count == [1]


def test_first_tokens(spark):
    from litforge.functions.tokens import encoding, first_tokens

    texts = ["", None, "one two three four five " * 50, "日本語のテキスト" * 30, "short"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(first_tokens(F.col("t"), 20)).collect()]
    assert got[0] == "" and got[1] is None and got[4] == "short"
    e = encoding("/opt/tokenizers/byte_bpe_50k.tiktoken")
    for t, g in zip(texts[2:4], got[2:4]):
        assert t.startswith(g) and 0 < len(e.encode_ordinary(g)) <= 20 and len(e.encode_ordinary(t[: len(g) + 6])) > 20
