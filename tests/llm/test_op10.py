import random
import re
import textwrap
import time

import duckdb

from litforge.llm.op10_license_scan import OP10_SQL, TEMPLATES, bigrams, bounds, full_texts, key_words, op10_license_scan, scan

D = "/root/testdata/sf0.001"
EVERY = dict(sorted((TEMPLATES | full_texts()).items()))


def plain(text, templates=EVERY, t=0.8):
    """Every window of every template, one by one, without prunings."""
    words = [(w, n) for n, s in enumerate((text or "").split("\n"), 1) for w in re.findall("[a-z0-9]+", s.lower())]
    grams = [f"{a[0]} {b[0]}" for a, b in zip(words, words[1:])]
    found = []
    for name, template in templates.items():
        own = set(bigrams(template))
        widest = bounds(len(re.findall("[a-z0-9]+", template.lower())) - 1, t)[1]
        for p, g in enumerate(grams):
            if g not in own or (p and grams[p - 1] in own and g != bigrams(template)[0]):
                continue
            best, seen, shared = (0, 0), set(), 0
            for q in range(p, min(len(grams), p + widest)):
                if grams[q] not in seen:
                    seen.add(grams[q])
                    shared += grams[q] in own
                    best = min(best, (-2 * shared / (len(own) + len(seen)), q))
            if best[0] <= -t + 1e-9:
                found.append((best[0], -(best[1] - p + 2), p, name, best[1]))
    kept = [x for x in found if not any(y[:4] < x[:4] and y[2] <= x[4] and x[2] <= y[4] for y in found)]
    return [(round(-d, 9), words[p][1], words[q + 1][1] - words[p][1] + 1, name, p, -n) for d, n, p, name, q in sorted(kept)]


def found(spark, texts, **more):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, license string").repartition(4)
    return {r.doc_id: [(round(h.dice, 9), *h[1:]) for h in r.hits] for r in scan(df, **more).collect()}


def test_matches_all_windows(spark):
    rng = random.Random(10)
    texts = [None, "", "\n", "word", "no licence " * 5000, "Released under the MIT License. x y " * 5, "the license " * 400]
    for text in TEMPLATES.values():
        for _ in range(6):
            w = text.split(" ")
            for _ in range(rng.randint(0, 1 + len(w) // 8)):
                w[rng.randrange(len(w))] = rng.choice(["THE", "foo,", "", "Of the"])
            body = "\n".join(f" * {s}" for s in textwrap.wrap(" ".join(w), 40)) if rng.random() < 0.5 else " ".join(w)
            texts.append(rng.choice(["", "of the work\n", "int main of this ", "é\n\n"]) + body + rng.choice(["", " and more of the same", "\n" + body, "\nimport os\n# " + text]))
    for full in full_texts().values():
        w = full.split(" ")
        for _ in range(len(w) // 40):
            w[rng.randrange(len(w))] = rng.choice(["THE", "foo,"])
        texts += ["once upon a time " + full + "\nthe end " + full, "of the License " + " ".join(w) + " of the License"]
    want = {i: plain(t) for i, t in enumerate(texts)}
    assert found(spark, texts) == want
    assert {h[3] for v in want.values() for h in v} == set(EVERY)
    assert all(v == [] for v in found(spark, texts[:9], templates={"": "", "one": "word"}).values())
    assert scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_key_words_are_needed():
    for name, text in EVERY.items():
        keys, grams = set(key_words(text, 0.8, {"license"})), bigrams(text)
        assert sum(not keys & set(g.split(" ")) for g in grams) < bounds(len(grams), 0.8)[0], name


def test_many_notices_in_one_text(spark):
    """Time follows the number of notices, and so do the hits."""
    names = [k for k in TEMPLATES if k != "Apache-2.0-header"]
    texts = ["Released under the MIT License.\n" * 10_000, "\n".join(TEMPLATES[names[i % len(names)]] for i in range(3000))]
    began = time.time()
    got = found(spark, texts)
    assert len(got[0]) == 10_000 and len(got[1]) == 3000
    assert time.time() - began < 60


def test_sql_and_plan(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{D}/documents.parquet'")
    df = op10_license_scan(spark, D)
    want = sorted(map(str, con.execute(OP10_SQL).fetchall()))
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == want and any("MIT" in r for r in want)
    assert not re.search("Python|Arrow|Pandas|Exchange", df._jdf.queryExecution().executedPlan().toString())


def test_wrapped_header_in_a_file(spark):
    header = "\n".join(f"# {x}" for x in textwrap.wrap(TEMPLATES["Apache-2.0-header"], 72))
    code = "import os\n\ndef f(x):\n    return x\n"
    got = found(spark, [f"#!/bin/sh\n{header}\n{code}", code, "x " + TEMPLATES["Apache-2.0-header"] + " y"])
    assert [h[:4] for h in got[0]] == [(1.0, 2, header.count("\n") + 1, "Apache-2.0-header")] and got[1] == []
    assert [h[:4] for h in got[2]] == [(1.0, 1, 1, "Apache-2.0-header")]
