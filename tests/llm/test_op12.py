import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from litforge.llm.op12_ranked_search import LEAF, OP12_SQL, MaxTree, op12_ranked_search, search

D = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    """Each item's best documents by the formula, one after the other."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for q, text in items:
        found = []
        for i, c in held:
            m, score = 100 - 50 + 50 * sum(c.values()) * n // total, 0
            for t in set(terms(text)) & set(c):
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, i is None, i))
        out += [(q, r, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def sample(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["École", "ÉCOLE", "straße", "a-b", "x_y", "10.5", "日本"]
    docs = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.randrange(40)))) for i in range(n)]
    items = [(i, " ".join(rng.sample(words, rng.randrange(1, 12))).upper()) for i in range(25)]
    return docs, items


@pytest.mark.parametrize(("k", "shard", "block", "vocabulary"), [(7, 64, 8192, 1000), (50, 1 << 16, 20, 1000), (3, 600, 8192, 5)])
def test_matches_brute_force(spark, k, shard, block, vocabulary):
    docs, items = sample(1500, k)
    docs += [(9001, docs[3][1]), (9000, docs[3][1]), (3, docs[3][1]), (None, docs[3][1]), (9002, None), (9003, ""), (9004, " .,;"), (9005, "w1 " * 30_000)]
    items += [(100, None), (101, ""), (102, "unheard of"), (3, docs[3][1]), (None, "w1 w2")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    queries = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    got = search(df, queries, k=k, shard=shard, block_terms=block, vocabulary=vocabulary)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, k)


def test_the_tree_prunes_and_opens_ties():
    n = 64 * LEAF
    impact = np.where(np.arange(n) < LEAF, 900, 100)
    impact[[5 * LEAF, 9 * LEAF]] = 900
    tree = MaxTree(np.arange(n)[::1], np.ones(n, dtype=bool), np.arange(n + 1), np.zeros(n, dtype=np.int64), impact, 1)
    best: list = []
    opened = tree.search(np.array([0]), np.array([2]), np.array([2]), best, 3)
    assert sorted(best, reverse=True) == [(1800, 1, 0), (1800, 1, -1), (1800, 1, -2)]
    assert opened == 3  # the leaves whose bound ties, no other


def test_empty_tables_and_other_columns(spark):
    docs, items = sample(30, 1)
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, id string, score int")
    queries = spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, terms string")
    assert sorted(map(tuple, search(df, queries, k=5).collect()), key=str) == brute(docs, items, 5)
    assert search(df.where("doc_id < 0"), queries).collect() == []
    assert search(df, queries.where("item_id < 0")).collect() == []


def test_query_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    want = sorted(con.execute(OP12_SQL).fetchall())
    assert sorted(map(tuple, op12_ranked_search(spark, D).collect())) == want and len(want) > 100
