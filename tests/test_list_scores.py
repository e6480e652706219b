"""Spans of lists of tags against the spans of their tokens, and their scores, with no token shuffled."""

import random

from plans import shuffled
from pyspark.sql import functions as F

from litforge.functions import tags


def test_lists_as_tokens(spark):
    rng = random.Random(4)
    one = lambda n: [rng.choice(("O", "O", "B-X", "I-X", "B-Y Z", "I-Y Z")) for _ in range(n)]
    rows = [(i, bool(i % 2), one(i % 9), one(i % 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, held boolean, gold array<string>, said array<string>")
    got = []
    n = shuffled(spark, lambda: got.extend(tags.list_scores(df, "gold", "said", ["held"]).collect()))
    assert n <= 4 * 2 * 2 * 2
    for held in (False, True):
        own = df.where(F.col("held") == held).select("id", F.posexplode(F.arrays_zip("gold", "said")).alias("pos", "t")).select("id", "pos", "t.*")
        want = tags.span_scores(*(tags.bio_spans(own, ["id"], "pos", c) for c in ("gold", "said")), ["id"]).collect()
        assert {tuple(r) for r in want} == {tuple(r)[1:] for r in got if r.held == held} and len(want) == 2
