import hashlib
import random

import pytest

from litforge.llm.op2_suffix_dedup import remove_repeats


def brute(rows, span):
    """By a table of all windows, in the order of id and place."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - span + 1):
            w = raw[i : i + span]
            if w in seen:
                gone[i : i + span] = b"\1" * span
            seen.add(w)
        out[doc] = (len(raw), sum(gone), sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1])), hashlib.sha256(bytes(b for b, x in zip(raw, gone) if not x)).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "and", "über", "stone", "river", "a", "of", "sand", "élan"]
    line = lambda n: " ".join(rng.choice(words) + rng.choice(["", "x", "yz", "q"]) for _ in range(n))
    shared = [line(30) for _ in range(4)]
    rows = [(i, " ".join([line(rng.randint(0, 40)), rng.choice(shared), line(rng.randint(0, 30)), rng.choice(shared + [""])])) for i in range(60)]
    rows += [(100, "ab" * 400), (101, "a" * 500), (102, "a" * 99), (103, None), (104, ""), (105, rows[3][1]), (106, rows[3][1][:150]), (107, "x" + rows[3][1] + "y"), (108, line(4000)), (109, "ü" * 300)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "hot", "few"), [(1, 1024, None), (2, 1024, None), (1, 1, None), (2, 2, None), (1, 1024, 2000), (3, 1024, 100)])
def test_matches_brute_force(spark, seed, hot, few):
    rows = corpus(seed)
    if few:  # one string of 70 bytes in many contexts, and in long repeats
        rng, often = random.Random(seed), "".join(map(chr, range(33, 103)))
        more = [(200 + i, "".join(rng.choice("uvwxyz ") for _ in range(90)) + often + "".join(rng.choice("uvwxyz ") for _ in range(90))) for i in range(80)]
        rows += more + [(300 + i, more[i][1][5:190] + "!") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = remove_repeats(docs, hot=hot, few=few, share=1 if few else 64).collect()
    found = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in got}
    assert found == brute(rows, 100)


def test_long_text_is_cut_without_loss(spark, monkeypatch):
    import litforge.llm._hashing as H
    from litforge.llm import op2_suffix_dedup as op

    rng = random.Random(5)
    text = "".join(rng.choice("abcd") for _ in range(9000))
    text = text + text[100:4000] + text[50:300]
    monkeypatch.setattr(H, "PIECE", 1000)
    import pyarrow as pa

    rows = list(op._sampled(100, *[op.np.zeros(0, dtype=op.U)] * 2)([pa.RecordBatch.from_pydict({"doc": [1], "tag": [0], "text": [text]})]))
    samples = sum(int(((b["m"].to_numpy() >> 8) + 1)[b["m"].to_numpy() >= 0].sum()) - int(b["m"].to_numpy()[b["m"].to_numpy() < 0].sum()) for b in rows)
    assert samples == len(text) - 99  # each window belongs to one sample


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, key int, at string")
    assert remove_repeats(empty).count() == 0
    same = "p" * 50 + "q" * 100
    rows = [(None, same, 1), (5, same, 2), (5, same, 3), (6, same + "r", 4)]
    got = {(r.doc_id, r.n_bytes): len(r.kept) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, marks int")).collect()}
    assert got[(None, 150)] == 150 and got[(5, 150)] == 0 and got[(6, 151)] == 1


def test_many_texts_under_one_id(spark):
    rng = random.Random(6)
    halves = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(101, 140))) for _ in range(3000)]
    want = {t + t: (2 * len(t), len(t)) for t in halves}
    for id_of in (None, 7):
        rows = [(id_of, t + t) for t in halves] + [(8, "short")]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = remove_repeats(docs).where("n_bytes > 5").collect()
        assert len(got) == 3000 and all(s["end"] <= r.n_bytes for r in got for s in r.removed)
        assert sorted((r.n_bytes, r.n_bytes - len(r.kept), bytes(r.kept).decode()) for r in got) == sorted((*want[t], t[: len(t) // 2]) for t in want)


def test_repeated_rows_of_one_batch(spark):
    text = corpus(3)[0][1] + "".join(random.Random(4).choice("abcd ") for _ in range(300))
    rows = [(1, text), (1, text), (2, text + "z"), (2, text + "z")]
    want = brute([(1, text), (2, text + "z")], 100)
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert len(got) == 4 and all((r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), hashlib.sha256(r.kept).hexdigest()) == want[r.doc_id] for r in got)


def test_frequent_k_grams_are_cut(spark):
    from litforge.llm import op2_suffix_dedup as op

    rng, often = random.Random(8), "".join(map(chr, range(33, 103)))
    noise = lambda n: "".join(rng.choice("uvwxyz ") for _ in range(n))
    docs = spark.createDataFrame([(i, 0, noise(300) + often + noise(300)) for i in range(400)], "doc long, tag long, text string")
    keys, parts = op._frequent(docs, 100, 100, 1)
    assert 1 <= len(keys) <= 100 and parts.max() >= 2
    batches = docs.toArrow().to_batches()
    least = lambda rows: max(op.np.unique(op.np.concatenate([b["key"].to_numpy() for b in rows]), return_counts=True)[1])
    none = op.np.zeros(0, dtype=op.U)
    assert least(list(op._sampled(100, keys, parts)(batches))) < least(list(op._sampled(100, none, none)(batches)))
