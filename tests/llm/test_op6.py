import random
import re

from litforge.llm.op6_secret_scan import Automaton, Scanner, find_secrets, labelled, redact


def plain(text):
    """The base spans, pattern by pattern as they are stated."""
    out = []
    for kind, pattern, flags, test in (
        (0, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m.group(2)) >= 12),
        (1, r"AKIA[A-Z0-9]+", 0, lambda m: len(m.group()) >= 18),
        (2, r"[0-9a-f]+", 0, lambda m: len(m.group()) >= 16),
    ):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, flags) if test(m)]
    return [(a, b, ("assign", "access", "hex")[k]) for a, k, b in sorted(out)]


def test_base_spans(spark):
    rng = random.Random(3)
    bits = ["token: ", "PassWord=", "api_key='", "APIKEY : \"", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "dead", " ", "\n", "é", "secret", "==", "ſecret=abcdefghijklm", "x.y-z/+", "𝒳", "token: password: abcdefghijklmnop"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(300)] + [None, "", "a" * 300000 + " token=" + "z" * 40]
    got = {r.doc_id: [tuple(s) for s in r.spans if s.kind in ("assign", "access", "hex")] for r in find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: plain(t or "") for i, t in enumerate(texts)}


def test_automata_find_other_formats(spark):
    scanner = Scanner()
    new = labelled(30, seed=99)
    assert sum(scanner.score(s)[0] >= scanner.threshold for _, s in new) >= 0.9 * len(new)
    prose = ["internationalisation2", "2024-01-15-report-final", "the_quick_brown_fox_1", "aaaaaaaaaaaaaaaa1", "a/b/c/d/e/f/g/h/i/9"]
    assert not any(scanner.score(s)[0] >= scanner.threshold for s in prose)
    text = "see ghp_" + "a1B2" * 9 + " here"
    assert [k for _, _, k in scanner.scan(text)] == ["github"]


def test_merging_generalises():
    a = Automaton(["ab" * n for n in range(1, 30)] * 5)
    assert len(a.states) < 30 and a.likelihood("ab" * 40) > a.likelihood("ba" * 40)


def test_redact(spark):
    docs = spark.createDataFrame([(1, "x password=abcdefabcdef0123456789 y", 1), (2, None, 2), (3, "clean", 3), (3, "clean", 3)], "doc_id long, text string, kind int")
    got = sorted(((r.doc_id, r.text) for r in redact(docs).collect()), key=lambda x: x[0])
    assert got == [(1, "x [SECRET] y"), (2, None), (3, "clean"), (3, "clean")]
    assert find_secrets(docs.where("false")).count() == 0
