import random
import re

import pytest

from litforge.llm.op5_jaccard_join import components, jaccard_join, plan, representatives

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def brute(rows, threshold=0.8, k=5):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").lower())
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else None)
    n, links, root = len(rows), [0] * len(rows), list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and len(a & b) >= threshold * len(a | b):
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    low = {}
    for i in range(n):
        low[top(i)] = min(low.get(top(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], low[top(i)], links[i]) for i in range(n))


def corpus(seed, copies):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["été", "ÜB"]
    rows = []
    for base in range(12):
        words = [rng.choice(vocab) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.choice([1, 2, 5, copies])):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append(", ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
    rows += [None, "", "?!", "one two", "One, two", "one two three four five", " ".join(vocab * 40)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "block"), [(1, 1024), (2, 8), (3, 1)])
def test_matches_all_pairs(spark, seed, block):
    rows = corpus(seed, 40)
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, name int").repartition(3)
    got = jaccard_join(df, recall=0.99999, bucket=block, block=block).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute(rows)


def test_edges(spark):
    text = "a b c d e f g h i j"
    rows = [(4, text), (4, text), (None, text), (4, "x y z v w u t"), (9, None)]
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(4, 4, 2), (4, 4, 2), (None, 4, 2), (4, 4, 0), (9, 9, 0)], key=str)
    assert jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_plan_and_components(spark):
    bands, rows = plan(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 100
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 103), (103, 101), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 103: 100}


def hot_group(n, seed=3):
    rng = random.Random(seed)
    vocab = [f"word{i}" for i in range(2000)]
    base = [rng.choice(vocab) for _ in range(120)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    return rows


def shuffled(spark, since=-1):
    """The last stage, and the bytes that the stages after a given one have written to shuffles."""
    sc = spark.sparkContext
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), sc._gateway.jvm.java.util.ArrayList())
    stages = [found.apply(i) for i in range(found.size())]
    return max((s.stageId() for s in stages), default=-1), sum(s.shuffleWriteBytes() for s in stages if s.stageId() > since)


def test_large_group_is_shuffled_in_proportion(spark):
    took = []
    for n in (600, 1200):  # 5 and 10 blocks
        rows = hot_group(n)
        before, _ = shuffled(spark)
        got = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), bucket=128, block=128).collect()
        took.append(shuffled(spark, before)[1] / sum(len(t) for _, t in rows))
        if n == 600:
            assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute(rows)
    assert took[1] < 6 and took[1] < 1.3 * took[0]


def test_recall_of_the_default_plan(spark):
    rows = corpus(5, 60)
    got = {r.doc_id: r for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert sum(got[i].n_links for i, _, _ in want) >= 0.99 * sum(n for _, _, n in want)
    assert all(got[i].n_links <= n for i, _, n in want)


def test_representatives(spark):
    rows = corpus(6, 9) + [(4, "x y z v w u t"), (None, "x y z v w u t"), (None, None), (None, None), (700, "")]
    got = sorted(((r.doc_id, r.n) for r in representatives(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.99999).collect()), key=str)
    low = [(i, t) for i, t in rows if i is not None]
    want = [(i, 1) for i, c, _ in brute(low) if i == c]
    assert got == sorted([*want, (None, 2)], key=str)
