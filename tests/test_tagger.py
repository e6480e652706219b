"""The tagger against plain versions of its sums, and on held-out text."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from litforge.operators import tagger


def by_paths(places, sizes, emit, step):
    """Of each sentence every path of labels with its score."""
    n, at = emit.shape[1], 0
    for size in sizes:
        scores = emit[places[at : at + size]].sum(axis=1)
        yield at, {p: step[n][p[0]] + sum(scores[t][k] for t, k in enumerate(p)) + sum(step[a][b] for a, b in zip(p, p[1:])) for p in itertools.product(range(n), repeat=size)}
        at += size


@pytest.fixture
def small():
    rng = np.random.default_rng(3)
    sizes = np.array([3, 0, 1, 5, 2, 4])
    places = rng.integers(0, 12, (sizes.sum(), tagger.PER_TOKEN))
    return places, sizes, rng.integers(0, 3, sizes.sum()), rng.normal(size=(12, 3)), rng.normal(size=(4, 3))


def test_likelihood_and_gradient_are_those_of_all_paths(small):
    places, sizes, gold, emit, step = small
    value = lambda e, s: sum(w[tuple(gold[at : at + len(next(iter(w)))])] - np.log(sum(map(np.exp, w.values()))) for at, w in by_paths(places, sizes[sizes > 0], e, s))
    total, of_emit, of_step = tagger.gradient(places, sizes, gold, emit, step)
    assert total == pytest.approx(value(emit, step))
    for i, k in [(0, 0), (3, 1), (7, 2), (11, 0)]:
        moved = emit.copy()
        moved[i, k] += 1e-5
        assert of_emit[i, k] == pytest.approx((value(moved, step) - total) / 1e-5, abs=1e-3)
    for i, k in itertools.product(range(4), range(3)):
        moved = step.copy()
        moved[i, k] += 1e-5
        assert of_step[i, k] == pytest.approx((value(emit, moved) - total) / 1e-5, abs=1e-3)


def test_decoding_takes_the_best_path(small):
    places, sizes, _, emit, step = small
    got = tagger.decode(places, sizes, emit, step)
    for at, w in by_paths(places, sizes[sizes > 0], emit, step):
        assert tuple(got[at : at + len(next(iter(w)))]) == max(w, key=w.get)


def test_trained_stored_and_applied(spark, tmp_path):
    rows = [(i, f"on day {i} we saw Green River {i % 7} and Old Mill".split(), "O O B-NUM O O B-NAME I-NAME B-NUM O B-NAME I-NAME".split()) for i in range(120)]
    rows += [(900, None, None), (901, [], []), (902, ["a"], ["O", "O"]), (903, ["a", None], ["O", None]), (904, [None, "x"], ["O", "O"])]
    df = spark.createDataFrame(rows, "id int, tokens array<string>, tags array<string>")
    first = tagger.train(df, "tokens", "tags", f"{tmp_path}/a", bits=10, steps=15)
    other = tagger.train(df.repartition(7), "tokens", "tags", f"{tmp_path}/b", bits=10, steps=15)
    assert first.labels == ("B-NAME", "B-NUM", "I-NAME", "O") and np.abs(first.emit - other.emit).max() < 1e-6
    # the plain trainer: the same objective, by plain descent, until it stands still
    own = df.where("id < 900 or id = 904").select(tagger.features(F.col("tokens"), 10).alias("places"), "tags").toArrow()
    places, sizes = tagger._packed(own.column("places").combine_chunks())
    gold = np.array([first.labels.index(t) for s in own.column("tags").to_pylist() for t in s])
    value = lambda m: -tagger.gradient(places, sizes, gold, m.emit, m.step)[0] / len(sizes) + 5e-5 * ((m.emit**2).sum() + (m.step**2).sum())
    emit, step = np.zeros_like(first.emit), np.zeros_like(first.step)
    for _ in range(400):
        _, e, s = tagger.gradient(places, sizes, gold, emit, step)
        emit, step = emit + 0.05 * (e / len(sizes) - 1e-4 * emit), step + 0.05 * (s / len(sizes) - 1e-4 * step)
    assert value(first) <= value(tagger.Tagger(first.labels, 10, emit, step)) + 1e-3
    version = tagger.save(spark, first, f"{tmp_path}/model")
    again = tagger.load(spark, f"{tmp_path}/model")
    assert again.version == version == first.version
    got = {r.id: r.tags for r in tagger.tagged(df.withColumn("_places", F.lit(1)), "tokens", again).collect()}
    assert all(got[i] == t for i, _, t in rows[:120]) and got[900] == got[901] == [] and len(got[904]) == 2
    spark.read.parquet(f"{tmp_path}/model/weights").withColumn("weight", F.col("weight") + 1).write.parquet(f"{tmp_path}/other/weights")
    spark.read.parquet(f"{tmp_path}/model/about").write.parquet(f"{tmp_path}/other/about")
    with pytest.raises(ValueError, match="version"):
        tagger.load(spark, f"{tmp_path}/other")
    assert tagger.train(df.where("id = 900"), "tokens", "tags", f"{tmp_path}/c") is None


def test_held_out_spans_are_found(spark):
    from litforge.plans import learned

    scores = {(r.held_out, r.type): r for r in learned.tagger_scores(spark, "/root/testdata/sf0.001").collect()}
    assert {t for _, t in scores} >= {"NAME", "NUM"}
    assert scores[True, "NAME"].n_gold > 500 and scores[True, "NAME"].f1 > 0.85 and scores[False, "NAME"].f1 > 0.95
