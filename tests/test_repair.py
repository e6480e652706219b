"""Mended JSON and corrected words, on generated breakages and planted confusions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from litforge.functions import repair
from litforge.operators import corrections


def value(rng, depth=0):
    kind = rng.choice(["text", "number", "constant", "list", "object"][: 5 if depth < 3 else 3])
    if kind == "list":
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    if kind == "object":
        return {f"key{rng.randrange(99)}": value(rng, depth + 1) for _ in range(rng.randrange(4))}
    return {"text": f"te\"xt, [{rng.randrange(99)}] é\n: \\", "number": rng.choice([0, -7, 1.5e3]), "constant": rng.choice([True, None])}[kind]


def test_whole_lines_have_no_faults():
    rng = random.Random(1)
    for _ in range(300):
        own = {"a": value(rng), "b": [value(rng)]}
        for text in (json.dumps(own), json.dumps(own, indent=2, ensure_ascii=False)):
            assert repair.mend(text) == (own, [])


def test_each_breakage_is_undone():
    rng = random.Random(2)
    for _ in range(200):
        own = {"first": value(rng), "last": {"x": [1, "two"]}}
        text = json.dumps(own)
        cuts = {
            "missing bracket": text.rstrip("}]"), "surplus comma": text[:-1] + ",}", "comment": text[:1] + "/* no } */" + text[1:], "single quotes": text.replace('"two"', "'two'"),
            "bare word": text.replace('"last"', "last"), "missing colon": text.replace('"last":', '"last"'), "missing comma": text.replace('1, "two"', '1 "two"'), "other bracket": text[:-3] + "}}",
        }
        for kind, broken in cuts.items():
            got, faults = repair.mend(broken)
            assert got == own and kind in {k for _, k in faults}, (kind, broken)
    assert repair.mend('{"a": "cut off in the mid') == ({"a": "cut off in the mid"}, [(6, "open string"), (25, "missing bracket")])
    assert repair.mend('{"a": , "b": 1}') == ({"a": None, "b": 1}, [(6, "missing value")])
    assert repair.mend("{1: 2}") == ({"1": 2}, [(1, "key without quotes")])
    for text in ("", "plain", "{} {}", "7", '"text"', "]", "{a b c d e f g h i j k l m n}", "{{}}"):
        with pytest.raises(repair.Unmendable):
            repair.mend(text)


def test_cut_anywhere_is_mended_or_told(spark):
    text = json.dumps({"a": [1, {"b": "c, d"}, None], "e": {"f": -2.5, "g": True}})
    df = spark.createDataFrame([(i, text[:i], 1, "x") for i in range(len(text) + 1)] + [(900, None, 1, "x"), (901, "[" * 5000, 1, "x"), (902, "{} {}", 1, "x"), (903, "{}] x", 1, "x"), (904, "{}, {}", 1, "x")], "id int, line string, faults int, reason string")
    fine, left = repair.repaired(df, "line")
    got = {r.id: (r.v, len(r.faults)) for r in fine.select("id", F.to_json("value").alias("v"), "faults").collect()}
    assert got[len(text)][1] == 0 and json.loads(got[len(text)][0]) == json.loads(text)
    assert all(n > 0 for i, (_, n) in got.items() if i < len(text))
    reasons = {r.id: r.reason for r in left.collect()}
    assert set(got) | set(reasons) == {*range(len(text) + 1), 900, 901, 902, 903, 904} and not set(got) & set(reasons)
    assert reasons[0] == "empty" and reasons[900] == "null" and {901, 902, 903, 904} <= set(reasons)


def test_planted_confusions(spark):
    rng = random.Random(3)
    words = ["morning", "water", "silver", "garden", "window", "little", "flowers", "cloud"]
    rows = [(i, " ".join(rng.choices(words, k=30))) for i in range(40)]
    bad = {"rnorning": "morning", "vvater": "water", "si1ver": "silver", "gardn": "garden", "windouw": "window", "litt1e": "little", "ﬂowers": "flowers", "doud": "cloud", "xyzzy": None}
    rows += [(100 + i, f"the {w}\n\n{w},  end") for i, w in enumerate(bad)] + [(200, None), (None, "si1ver")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = corrections.corrections(corrections.vocabulary(docs))
    assert {r.word: r.correct for r in found.collect()} == {k: v for k, v in bad.items() if v}
    got = {r.doc_id: r.corrected for r in corrections.corrected(docs, found).collect()}
    assert all(got[i] == t for i, t in rows[:40]) and got[200] is None and got[None] == "silver"  # no clean word is changed
    assert all(got[100 + i] == f"the {v or w}\n\n{w},  end" for i, (w, v) in enumerate(bad.items()))
