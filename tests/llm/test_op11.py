import random
import re

import duckdb
import numpy as np
import pytest

from litforge.llm import _hashing as H
from litforge.llm.op11_setsketch import OP11_SQL, by_setsketch, cardinality, estimated, merged, near_duplicates, op11_setsketch, sketched

D = "/root/testdata/sf0.001"


def shingle_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """All pairs, then the smallest id that links lead to."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return [(d, len(s), least[top(i)], d == least[top(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def texts(seed, groups=12, size=9):
    rng = random.Random(seed)
    words = [f"Wort{i}," for i in range(4000)]
    out = []
    for _ in range(groups):
        base = rng.choices(words, k=rng.randrange(30, 900))
        for _ in range(size):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8, 16])):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append(rng.choice([" ", "\n", " \t"]).join(own))
    return out


def sets_of(n, j, seed):
    """Two sets of hashes of similarity j."""
    rng = np.random.default_rng(seed)
    both = rng.integers(0, 1 << 63, 3 * n).astype(np.uint64)
    shared = int(2 * n * j / (1 + j))
    return H.mix(both[:n]), H.mix(both[n - shared : 2 * n - shared])


def test_registers_merge():
    a, b = sets_of(500, 0.3, 1)
    one, two, whole = sketched([a, b, np.union1d(a, b)], 128)
    assert (merged(one, two) == whole).all()
    assert one.dtype == np.uint16 and (one != two).any()


def test_estimates():
    for j in (0.0, 0.2, 0.5, 0.85, 0.95, 1.0):
        found = []
        for seed in range(40):
            a, b = sets_of(400, j, seed)
            x, y = sketched([a], 256), sketched([b], 256)
            found.append(estimated(x, np.array([len(a)]), y, np.array([len(b)]))[0, 0])
        assert abs(np.mean(found) - j) < 0.02, (j, np.mean(found))
        assert np.std(found) < 1.3 * (j * (1 - j) / 256) ** 0.5 + 0.01
    sizes = cardinality(sketched([sets_of(n, 0, 3)[0] for n in (50, 1000, 40_000)], 1024))
    assert np.abs(sizes / np.array([50, 1000, 40_000]) - 1).max() < 0.12


def test_likely_is_where_the_peak_lies():
    scheme = by_setsketch(5, 0.85, 0.999)
    sets = [x for i, j in enumerate((0.3, 0.55, 0.65, 0.7, 0.8, 0.9, 1.0)) for x in sets_of(300, j, i)]
    rows = np.frombuffer(b"".join(scheme.sign(sets)[1]), dtype=np.uint8).reshape(len(sets), -1)
    sizes, registers = np.array([len(s) for s in sets]), rows[:, 8:].copy().view(np.uint16)
    found = estimated(registers, sizes, registers, sizes)
    least = 0.85 - 5 * (0.85 * 0.15 / registers.shape[1]) ** 0.5
    likely = scheme.likely(rows, rows)
    assert likely.any() and not likely.all()
    sure = np.abs(found - least) > 1e-6
    assert (likely == (found >= least))[sure].all()


@pytest.mark.parametrize("bucket", [256, 3])
def test_matches_all_pairs(spark, bucket):
    rows = list(enumerate(texts(bucket)))
    random.Random(2).shuffle(rows)
    rows += [(900, rows[0][1]), (901, rows[0][1].upper()), (902, None), (903, ""), (904, " \n\t"), (905, "drei kurze Worte"), (906, "DREI kurze  worte"), (907, "drei kurze worte."), (908, "É a b c d"), (909, "é a b c d"), (910, "x " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_duplicates(df, bucket=bucket, block=8)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))


def test_ids_that_repeat_or_are_null(spark):
    a, b = texts(5, groups=2, size=1)
    rows = [(None, a), (None, b), (7, a), (7, b), (7, b), (3, b), (None, None), (None, "one two")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_shingles int, h string")
    got = sorted(map(tuple, near_duplicates(df).select("doc_id", "component_id", "kept").collect()), key=str)
    assert got == sorted([(None, 7, False), (None, 3, False), (7, 7, True), (7, 3, False), (7, 3, False), (3, 3, True), (None, None, True), (None, None, True)], key=str)
    assert near_duplicates(df.where("doc_id < 0")).collect() == []


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{D}/documents.parquet'")
    want = sorted(con.execute(OP11_SQL).fetchall())
    assert sorted(map(tuple, op11_setsketch(spark, D).collect())) == want
    assert any(not r[3] for r in want)
