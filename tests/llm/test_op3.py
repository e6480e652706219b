import random
import re

import numpy as np

from litforge.llm.op3_decontaminate import contaminated, tile

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def plain_tile(a, b, minimum):
    """Greedy string tiling as published, comparing all pairs of places."""
    fa, fb, out = [True] * len(a), [True] * len(b), 0
    while True:
        longest, found = minimum, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and fa[i + n] and fb[j + n]:
                    n += 1
                if n > longest:
                    longest, found = n, [(i, j)]
                elif n == longest:
                    found.append((i, j))
        if not found:
            return out
        for i, j in found:
            if all(fa[i : i + longest]) and all(fb[j : j + longest]):
                fa[i : i + longest] = fb[j : j + longest] = [False] * longest
                out += longest


def test_tiles_like_the_plain_version():
    rng = random.Random(4)
    for _ in range(60):
        a = [rng.randint(0, 3) for _ in range(rng.randint(5, 40))]
        b = [rng.randint(0, 3) for _ in range(rng.randint(0, 30))] + a[rng.randint(0, 10) :] + a[: rng.randint(0, 12)]
        tiles = tile(np.array(a, dtype=np.uint64) + 5, np.array(b, dtype=np.uint64) + 5, 5)
        for p, t, n in tiles:
            assert n >= 5 and a[p : p + n] == b[t : t + n]
        for at, whole in ((0, len(a)), (1, len(b))):
            marked = [x for s in tiles for x in range(s[at], s[at] + s[2])]
            assert len(marked) == len(set(marked)) and all(x < whole for x in marked)
        assert sum(n for _, _, n in tiles) == plain_tile(a, b, 5)


def test_finds_whole_reordered_and_no_clean_text(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)] + ["é", "ÜBER"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(40)) for i in range(20)] + [(50, "too short"), (51, None), (52, ""), (None, "x")]
    half = items[3][1].split()
    docs = [(1, text(300) + " " + items[0][1].upper() + " " + text(50)), (2, " ".join(half[20:]) + " " + text(30) + ", " + "! ".join(half[:20])), (3, text(4000)), (4, " ".join(half[:15]) + text(100)), (5, None), (6, ""), (7, "too short"), (7, "too short"), (8, items[1][1] + " " + items[2][1])]
    df = spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, text string, coverage int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 600):
        got = {r.doc_id: r for r in contaminated(df, bench, keep=["doc_id"], block_bytes=block).collect()}
        assert {i: got[i].n_items for i in got} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 2}
        assert (got[1].item_id, got[1].coverage, got[1].n_tiles) == (0, 1.0, 1) and got[2].item_id == 3 and got[8].item_id == 1
    assert contaminated(df, bench.where("false"), keep=["doc_id"]).where("n_items > 0").count() == 0
    assert contaminated(df.where("false"), bench, keep=["doc_id"]).count() == 0


def test_words_are_as_stated():
    import pyarrow as pa

    from litforge.llm import _hashing as H

    texts = ["One two-three", "", None, "é_ü x2", "one", "TWO"]
    data, offsets = H.utf8(H.lowered(pa.array(texts)))
    hashes, first = H.words(data, offsets)
    want = [WORD.findall((t or "").lower()) for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in want]
    flat = [x for w in want for x in w]
    assert len(set(hashes.tolist())) == len(set(flat)) and hashes[0] == hashes[flat.index("one", 1)]


def test_ties_long_texts_and_other_columns(spark):
    rng = random.Random(31)
    item = " ".join(f"q{rng.randrange(10**6)}" for _ in range(30))
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(120_000))  # more than a piece
    bench = spark.createDataFrame([(9, item), (4, item), (6, item), (6, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{long} {item} {long}", "mine", 1), (2, long, "mine", 2), (3, item, None, 3)], "doc_id long, text string, coverage string, N int")
    for block in (1 << 20, 100):
        got = contaminated(docs, bench, keep=docs.columns, block_bytes=block, prefix="_")
        assert got.columns == [*docs.columns, "_n_items", "_item_id", "_coverage", "_n_tiles"]
        rows = {r.doc_id: r for r in got.collect()}
        assert [(rows[i]._n_items, rows[i]._item_id, rows[i].coverage) for i in (1, 2, 3)] == [(3, 4, "mine"), (0, None, "mine"), (3, 4, None)]
    assert contaminated(docs, bench).columns == ["doc_id", "N", "n_items", "item_id", "coverage", "n_tiles"]
