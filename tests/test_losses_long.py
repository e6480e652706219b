"""Long parts without anchors are aligned as exactly as short ones."""

import random

from litforge.operators import losses


def plain(a, b):
    """A longest common subsequence by the whole table."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def texts(seed, size, kinds):
    """A text of words that it has often, and without some of them; their ends differ, so that nothing is an anchor."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(kinds)}" for _ in range(size)]
    gone = set(rng.sample(range(size), size // 20))
    return ["p", *words, "q"], ["r", *(w for k, w in enumerate(words) if k not in gone), "s"]


def test_long_parts_without_anchors():
    for size in (505, 700, 1100):
        a, b = texts(size, size, 25)
        assert losses.aligned(a, b) == plain(a, b)


def test_pairs_are_those_of_the_whole_table(monkeypatch):
    rng = random.Random(8)
    for kept, places in ((2, 1), (3, 64), (losses.KEPT, losses.PLACES)):
        monkeypatch.setattr(losses, "KEPT", kept)
        monkeypatch.setattr(losses, "PLACES", places)
        for _ in range(400):
            kinds = rng.choice((1, 2, 4, 12))
            a, b = ([rng.randrange(kinds) + rng.choice((0, 0, k)) for _ in range(rng.randrange(30))] for k in (100, 200))
            assert losses._common(a, b) == plain(a, b), (a, b)


def test_losses_of_long_texts(spark):
    rows = [(n, *texts(n, n, 30)) for n in (40, 900, 4000)]
    df = spark.createDataFrame([(n, " ".join(a), " ".join(b)) for n, a, b in rows], "id long, x string, y string")
    got = {r.id: r.lost for r in losses.lost_spans(df, "x", "y").collect()}
    for n, a, b in rows:
        gone = {k for s in got[n] for k in range(s.start, s.start + s.words)}
        assert {0, n + 1} <= gone and len(gone) <= n // 20 + 2, n
        left, rest = [w for k, w in enumerate(a) if k not in gone], iter(b)
        assert all(w in rest for w in left)
