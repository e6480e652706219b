import random

import pytest
from tokenizers import Tokenizer

from litforge.llm.op9_token_counts import token_counts

TEXTS = ["one two\nthree  four\n\n five", "", None, "\n\n\n", "übergröße\n日本語 text 🙂🙂\nend\n", "x" * 50000 + "\n" + "y z " * 9000, "a\r\nb", "one two\nthree  four\n\n five"]


def test_lines_match_an_independent_encoder(spark):
    """Counts by the offsets of another library's encoder over the same vocabulary."""
    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice(["the ", "\n", "é", "12", " \n ", "zq", "'s "]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    got = {}
    for r in token_counts(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, section int")).collect():
        got.setdefault(r.doc_id, {})[r.section] = (r.start, r.end, r.n_tokens)
    for i, t in enumerate(texts):
        t = t or ""
        lines = t.splitlines(keepends=True) if "\r" not in t else ["a\r\n", "b"]
        lines = [x for x in t.split("\n")]
        spans, at = [], 0
        for k, x in enumerate(lines):
            n = len(x) + (k < len(lines) - 1)
            if n or not spans:
                spans.append((at, at + n))
            at += n
        enc = other.encode(t, add_special_tokens=False)
        want = {}
        for k, (a, b) in enumerate(spans):
            want[k] = (a, b, float(sum(a <= s < b for s, _ in enc.offsets)))
        assert got[i] == want, (i, t[:50])
        assert sum(x[2] for x in got[i].values()) == len(enc.ids)


@pytest.mark.parametrize("rule", ["first", "last", "split"])
def test_given_sections(spark, rule):
    text = "hello world, this is é a test of tokens"
    rows = [(1, text, [(0, 3), (3, 8), (10, 23)]), (2, None, None), (3, "abc", [])]
    df = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<start:int,end:int>>")
    got = {(r.doc_id, r.section): r.n_tokens for r in token_counts(df, sections_col="parts", rule=rule).collect()}
    import tiktoken  # noqa: F401

    from litforge.llm.op9_token_counts import encoder

    enc, sizes = encoder()
    ids = enc.encode_ordinary(text)
    assert sum(v for (d, _), v in got.items() if d == 1) == pytest.approx(len(ids))
    if rule == "split":
        assert got[1, 0] == pytest.approx(3 / 5)  # three of the bytes of "hello"
    if rule == "first":
        assert got[1, 0] == 1 and got[1, 1] == 1  # " world" starts in the second
    if rule == "last":
        assert got[1, 0] == 0 and got[1, 1] == 1
    assert (2, 0) not in got and got[3, -1] > 0


def test_rejects_and_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts(df).count() == 0
    with pytest.raises(ValueError):
        token_counts(df, rule="middle")
