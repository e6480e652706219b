"""Only words behind runs that may be kept are counted, and what is kept is still what plain counts give."""

import random

import pytest
from plans import shuffled
from test_generate import plain

from litforge.operators import generate


def test_other_runs_are_not_shuffled(spark, tmp_path):
    texts = [" ".join(["so it goes"] * 3 + [f"w{i}x{j}" for j in range(500)]) for i in range(40)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = []
    n = shuffled(spark, lambda: got.extend(generate.train(docs, str(tmp_path / "counts"), contexts=6).collect()))
    assert n < 25_000  # 20,000 words differ; it was a row for each run of one and of two words too
    want = plain(texts)
    kept = sorted(want, key=lambda c: (-sum(want[c].values()), c))[:6]
    assert {r.context: dict(zip(r.words, r.n, strict=True)) for r in got} == {c: dict(sorted(want[c].items(), key=lambda x: (-x[1], x[0]))[:32]) for c in kept}


@pytest.mark.parametrize("order, width, contexts", [(1, 3, 9), (2, 2, 40), (3, 3, 37), (3, 40, 10_000), (4, 1, 150), (5, 2, 1)])
def test_kept_runs_and_ties(spark, tmp_path, monkeypatch, order, width, contexts):
    monkeypatch.setattr(generate, "PART", 8)  # words behind frequent runs are dealt to many parts
    draw = random.Random(order)
    texts = [draw.choice(["", " ", "\x0b"]) + draw.choice(" \t\n\f\r").join(draw.choice("a b c d e é zz \x1c 𝄞 ﬀ".split(" ")) for _ in range(draw.randint(1, 25))) for _ in range(60)]
    want = plain([t.replace("\x1c", "Q") for t in texts], order)  # Python's split takes it for white space
    want = {c.replace("Q", "\x1c"): {w.replace("Q", "\x1c"): n for w, n in x.items()} for c, x in want.items()}
    docs = spark.createDataFrame([(t,) for t in [*texts, None, "", "\n \r"]], "text string").repartition(3)
    got = generate.train(docs, str(tmp_path / "counts"), order=order, width=width, contexts=contexts).collect()
    code = lambda x: x.encode()
    kept = sorted(want, key=lambda c: (-sum(want[c].values()), code(c)))[:contexts]
    best = {c: sorted(want[c].items(), key=lambda x: (-x[1], code(x[0])))[:width] for c in kept}
    assert {r.context: (r.total, list(zip(r.words, r.n, strict=True))) for r in got} == {c: (sum(want[c].values()), best[c]) for c in kept}
    assert len(got) == len(kept)
