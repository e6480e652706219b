"""The whole operator against a plain rendering: split, sample, features, machines, family and vote."""

import zlib

import numpy as np

from litforge.llm.op4_language_id import BITS, family_of, op4_language_id, predict, sampled, train

D = "/root/testdata/sf0.001"


def plain_features(text):
    """Counts of hashed trigrams, one at a time."""
    raw = [b if 97 <= b <= 122 or b >= 128 else 32 for b in text.lower().encode()]
    x = np.zeros(1 << BITS)
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        if (a, b, c) != (32, 32, 32):
            x[((a | b << 8 | c << 16) * 0x9E3779B1 % 2**32) >> (32 - BITS)] += 1
    blank = ((32 | 32 << 8 | 32 << 16) * 0x9E3779B1 % 2**32) >> (32 - BITS)
    x[blank] = 0
    x = np.sqrt(x)
    return x / max(np.sqrt((x * x).sum()), 1e-9)


def plain_svm(x, y, cost=10.0):
    """Squared hinge loss by plain gradient descent, until it stands still."""
    x = np.hstack((x, np.ones((len(x), 1))))
    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    w = np.zeros(x.shape[1])
    for _ in range(4000):
        step = w / cost - 2 * x.T @ (share * y * np.maximum(0, 1 - y * (x @ w)))
        w -= step / (1 / cost + 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def test_matches_plain_rendering(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").orderBy("doc_id").collect()
    learn = [r for r in docs if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None and any(c.isalpha() for c in r.text or "")]
    x, langs = np.array([plain_features(r.text) for r in learn]), np.array([r.lang for r in learn])
    known = sorted(set(langs))
    families = sorted({family_of(k) for k in known})
    of = np.array([family_of(k) for k in langs])
    first = {f: plain_svm(x, np.where(of == f, 1.0, -1.0)) for f in families}
    duels = {}
    for a in known:
        for b in known:
            if a < b and family_of(a) == family_of(b):
                own = (langs == a) | (langs == b)
                duels[a, b] = plain_svm(x[own], np.where(langs[own] == a, 1.0, -1.0))
    got = {r.doc_id: r for r in op4_language_id(spark, D).collect()}
    assert len(got) == len(docs)
    differ = 0
    for r in docs:
        if not any(c.isalpha() for c in r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        f = np.append(plain_features(r.text), 1.0)
        family = max(families, key=lambda k: f @ first[k])
        members = [k for k in known if family_of(k) == family]
        votes = dict.fromkeys(members, 0)
        for (a, b), w in duels.items():
            if a in votes:
                votes[a if f @ w >= 0 else b] += 1
        best = max(votes.values())
        differ += got[r.doc_id].lang_pred not in [k for k in members if votes[k] == best]
    assert differ <= 0.02 * len(docs)  # the operator stops its descent after 150 steps, in single precision


def test_every_label_is_learned(spark):
    rows = [(i, f"the cat and the dog {i}" if i % 2 else f"der hund und die katze {i}", "en" if i % 2 else "de") for i in range(400)]
    rows += [(1000 + i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}x" * 20, f"l{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = train(docs, "doc_id", "text", "lang", train_rows=604)
    assert len(model.langs) == 302
    got = {r.doc_id: r.lang_pred for r in predict(docs.select("doc_id", "text"), model).collect()}
    assert sum(got[i] == k for i, _, k in rows) > 0.95 * len(rows)


def test_ids_that_repeat_or_are_null(spark):
    text = lambda i: (f"the cat and the dog number {i}" if i % 2 else f"der hund und die katze nummer {i}")
    for id_of in (None, 7):
        rows = [(id_of, text(i), "en" if i % 2 else "de") for i in range(12_000)] + [(id_of, "one text over and over", "xx")] * 3000
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
        taken = sampled(docs, "doc_id", "text", "lang", 300).groupBy("lang").count().collect()
        assert {r["lang"]: r["count"] for r in taken} == {"en": 100, "de": 100, "xx": 1}
        model = train(docs, "doc_id", "text", "lang", train_rows=300)
        assert model.langs == ["de", "en", "xx"]
    assert train(docs.where("false"), "doc_id", "text", "lang") is None
