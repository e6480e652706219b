"""The n-gram model and its answers against plain counts and a plain decoder."""

import math
import random
from collections import Counter, defaultdict

import pytest

from litforge.operators import generate


def plain(texts, order=3):
    found = defaultdict(Counter)
    for t in texts:
        w = (t or "").split()
        w += [generate.END] if w else []
        for i, x in enumerate(w):
            for k in range(min(i, order - 1) + 1):
                found[" ".join(w[i - k : i])][x] += 1
    return found


def corpus(n=60):
    draw = random.Random(5)
    return [" ".join(draw.choice("a b c dd é".split()) for _ in range(draw.randint(1, 30))) for _ in range(n)] + [None, "", " \n", "b " * 5000]


@pytest.fixture()
def model_of(spark, tmp_path):
    return lambda texts, **how: generate.train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), str(tmp_path / "counts"), **how)


def greedy(found, prompt, most, order=3):
    text, out = prompt.split(), []
    while len(out) < most:
        c = next(found[" ".join(text[len(text) - k :])] for k in range(min(order - 1, len(text)), -1, -1) if " ".join(text[len(text) - k :]) in found)
        w = min(c, key=lambda x: (-c[x], x))
        if w == generate.END:
            break
        text.append(w)
        out.append(w)
    return " ".join(out)


def test_counts_and_greedy(spark, model_of):
    texts = corpus()
    want = plain(texts)
    table = model_of(texts).cache()
    rows = {r.context: r for r in table.collect()}
    assert {c: (r.total, dict(zip(r.words, r.n, strict=True))) for c, r in rows.items()} == {c: (sum(x.values()), dict(x)) for c, x in want.items()}
    model = generate.loaded(table)
    prompts = ["a", "", "b dd", "zz", "q a b", "é é é c", " b\tb "]
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate([*prompts, None])], "id int, p string, answer string")
    got = {r.id: r.answer for r in generate.generated(df, "p", model, most=9).collect()}
    assert got == {i: greedy(want, p, 9) for i, p in enumerate(prompts)} | {len(prompts): None}
    assert generate.generated(df, "p", model).columns == ["id", "p", "answer"]


def test_sizes_bound_the_model(spark, model_of):
    texts = corpus()
    want = plain(texts)
    table = model_of(texts, width=2, contexts=5).collect()
    kept = sorted(want, key=lambda c: (-sum(want[c].values()), c))[:5]
    assert {r.context: list(r.words) for r in table} == {c: sorted(want[c], key=lambda w: (-want[c][w], w))[:2] for c in kept}
    with pytest.raises(ValueError, match="over 3"):
        generate.loaded(model_of(texts, width=2, contexts=5), most=3)


def test_draws(spark, model_of):
    model = generate.loaded(model_of(["x a", "x a", "x a", "x b"]))
    n = Counter(generate.continued(model, "x", 1, temperature=1.0, seed=s) for s in range(4000))
    assert abs(n["a"] / 4000 - 0.75) < 0.03 and set(n) == {"a", "b"}
    cold = Counter(generate.continued(model, "x", 1, temperature=0.5, seed=s) for s in range(4000))  # squares of the shares
    assert abs(cold["a"] / 4000 - 0.9) < 0.03
    assert {generate.continued(model, "x", 1, temperature=1.0, top_p=0.7, seed=s) for s in range(200)} == {"a"}
    assert generate.continued(model, "x", 1, temperature=1.0, seed=3) == generate.continued(model, "x", 1, temperature=1.0, seed=3)
    assert generate.continued(model, "a x", 1, penalty=math.log(0.25) / math.log(0.75) + 0.1) == "b"


def test_no_texts(spark, model_of):
    model = generate.loaded(model_of([None, ""]))
    assert generate.continued(model, "a b") == "" and model.order == 1
