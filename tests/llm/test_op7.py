import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from litforge.llm import op7_quality as op

GOOD, BAD = "the river and the stone and the sand of the river ", "!!## XQ ZZ 99 $$$ "


def data(spark):
    rows = [(i, (GOOD if i % 4 else BAD) * (1 + i % 5)) for i in range(80)] + [(80, None), (81, ""), (82, "ab"), (83, GOOD * 20000), (None, BAD * 3), (5, GOOD), (5, GOOD)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, key double")
    labels = spark.createDataFrame([(i, 1 if i % 4 else 0) for i in range(0, 80, 3)] + [(None, 1), (5, 1), (999, 1)], "doc_id long, quality int")
    return rows, docs, labels


def plain(rows, good, prior):
    """Both models, n-gram by n-gram."""
    known = {}

    def bucket(f, gram):
        if (f, gram) not in known:
            known[f, gram] = int(next(g for k, _, _, g, _, _ in op._grams(pa.array([gram])) if k == f)[0])
        return known[f, gram]

    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    trigrams = lambda t: [bucket(0, t[i : i + 3]) for i in range(len(t) - 2)]
    bigrams = lambda t: [bucket(1, f"{a} {b}") for a, b in zip(words(t), words(t)[1:])]
    out = [0.0] * len(rows)
    for f, grams in enumerate((trigrams, bigrams)):
        per = [Counter(grams(t or "")) for _, t in rows]
        raw = sum(per, Counter())
        aim = sum((p for (i, _), p in zip(rows, per) if i in good), Counter())
        mixed = max(0.05, prior / (prior + aim.total())) if f else 0.05
        ratio = {g: math.log(mixed + (1 - mixed) * (aim[g] / aim.total()) / (n / raw.total())) for g, n in raw.items()}
        for r, p in enumerate(per):
            out[r] += sum(n * ratio[g] for g, n in p.items()) / op.N[f] * min(1, 100 / max(1, p.total()))
    return out


def test_weights_match_plain_counts(spark):
    rows, docs, labels = data(spark)
    good = {i for i in range(0, 80, 3) if i % 4} | {5}
    for prior in (50, 1e6):
        got = op.resample(docs.repartition(3), labels, temperature=0.0, prior=prior).collect()
        same_weights(got, rows, plain(rows, good, prior))
    kept = {r.doc_id for r in got if r.kept} - {83}  # 83 is most of the raw text: its weight is about 1 a trigram
    assert kept == {i for i, t in rows if i != 83 and (t is None or len(t) < 3 or t.startswith("the"))}


def same_weights(got, rows, weights):
    want = sorted((str(i), round(w, 4)) for (i, _), w in zip(rows, weights))
    for (a, x), (b, y) in zip(sorted((str(r.doc_id), r.log_weight) for r in got), want, strict=True):
        assert a == b and math.isclose(x, y, rel_tol=1e-4, abs_tol=1e-3)


def test_one_repeated_word_is_no_good_text(spark):
    """Each of its trigrams is as usual as any, but not each of its bigrams."""
    rng = random.Random(5)
    words = ["river", "stone", "water", "north", "small", "paper", "field", "light"]
    prose = lambda: " ".join(w for _ in range(8) for w in rng.sample(words[:4], 4) + rng.sample(words[4:], 4))
    rows = [(i, prose()) for i in range(300)] + [(300 + i, f"{rng.choice(words)} " * 80) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(0, 340, 2)], "doc_id long, quality int")
    kept = lambda prior: {r.doc_id for r in op.resample(docs, labels, temperature=0.0, prior=prior).where("kept").collect()}
    assert kept(100.0) & set(range(300, 340)) == set() and len(kept(100.0)) >= 290


@pytest.mark.parametrize("k", [0, 1, 37, 87, 500])
def test_k_highest_keys(spark, k):
    _, docs, labels = data(spark)
    got = op.resample(docs, labels, k=k).collect()
    order = sorted(got, key=lambda r: (-r.key, str(r.doc_id or "")))
    assert [r.kept for r in order[:k]] == [True] * min(k, len(got))
    assert sum(r.kept for r in got) in (min(k, len(got)), min(k, len(got)) + 2)  # rows that repeat go together


def test_narrow_bins(spark):
    rows = spark.createDataFrame([(i, float(i // 3) * 1e-7) for i in range(3000)], "id long, key double")
    order = sorted(((-r.key, str(r.id)) for r in rows.collect()))
    for k in (1, 2, 1500, 3000):
        assert op.kth(rows, k, bins=7, bin_rows=5) == (-order[k - 1][0], order[k - 1][1])
    assert op.kth(rows, 3001) is None and op.kth(rows.where("false"), 1) is None


def test_many_ties_go_by_id(spark):
    docs = spark.createDataFrame([(i, GOOD) for i in range(20_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    got = [r.doc_id for r in op.resample(docs, labels, k=5, temperature=0.0).where("kept").collect()]
    assert sorted(map(str, got)) == sorted(map(str, range(20_000)))[:5]
    rows = spark.createDataFrame([(i, 1.0) for i in range(500)] + [(7, 1.0)] * 60 + [(None, 1.0)] * 3 + [(1, 1.0 + 2**-52), (2, 0.5)], "id long, key double")
    order = sorted((-r.key, str(r.id) if r.id is not None else "") for r in rows.collect())
    for k in (1, 2, 3, 4, 300, 420, 470, 564, 565):
        assert op.kth(rows, k, bins=4, bin_rows=20) == (-order[k - 1][0], order[k - 1][1])
    assert op.kth(rows, 566, bins=4, bin_rows=20) is None


def test_empty(spark):
    _, docs, labels = data(spark)
    assert op.resample(docs.where("false"), labels).count() == 0
    assert {(r.log_weight, r.kept) for r in op.resample(docs, labels.where("false")).collect()} == {(0.0, True)}


def test_short_texts_at_the_end_of_a_batch(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for last in ("", "a", "ab", None):
        docs = spark.createDataFrame([(1, GOOD), (2, BAD), (3, last), (4, last)], "doc_id long, text string").coalesce(1)
        got = {r.doc_id: r.log_weight for r in op.resample(docs, labels, temperature=0.0).collect()}
        assert len(got) == 4 and got[3] == got[4] == 0.0 and got[1] > 0 > got[2]


def test_any_number_of_target_rows(spark):
    rng = random.Random(11)
    docs = spark.createDataFrame([(i, " ".join(rng.choices("alpha beta gamma delta".split(), k=9))) for i in range(5000)], "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    for n in (1, 20, 50, 100):
        assert op.resample(docs, labels, target_rows=n, k=10).where("kept").count() == 10
