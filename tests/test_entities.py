"""Dictionary matches against brute force, and scopes of denials by worked cases."""

import random
import re

from litforge.operators import entities

WORD = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")


def brute(text, terms):
    """Terms by their words; from the left, the longest first."""
    ws, out, i = WORD.findall((text or "").lower()), [], 0
    longest = max((len(t) for t in terms), default=0)
    while i < len(ws):
        for n in range(min(longest, len(ws) - i), 0, -1):
            if tuple(ws[i : i + n]) in terms:
                out.append((i, n, terms[tuple(ws[i : i + n])]))
                i += n
                break
        else:
            i += 1
    return out


def test_matches_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)] + ["β-globin", "o’neil", "don't", "É"]
    made = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 2, 3, 6])))) for i in range(100_000)]
    made += [(200_001, None), (200_002, " ,. "), (None, "w1"), (200_003, made[5][1].upper()), (200_004, "W1   w2, w3")]
    terms = {}
    for i, t in made:
        ws = tuple(WORD.findall((t or "").lower()))
        if ws and i is not None:
            terms[ws] = min(i, terms.get(ws, i))
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(60))) + rng.choice([".", " w1 w2 w3", ""]) for _ in range(60)] + [None, "", "nothing known", "w1 " * 2000]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, entities int, _words string")
    table = spark.createDataFrame(made, "term_id long, term string").repartition(3)
    want = {i: brute(t, terms) for i, t in rows}
    for block in (1_000_000, 60_000):
        got = entities.matched(df, table, block_words=block)
        assert got.columns == ["doc_id", "text", "_words", "entities"]
        assert {r.doc_id: [tuple(e) for e in r.entities] for r in got.collect()} == want
    none = entities.matched(df, table.where("term_id < 0"))
    assert all(r.entities == [] for r in none.collect()) and entities.matched(df.where("false"), table).count() == 0


def test_denials_by_worked_cases(spark):
    cases = [
        ("There was no fever or cough.", [True, True]),
        ("Not only fever but cough.", [False, False]),
        ("No fever, but cough was seen.", [True, False]),
        ("No rash. Fever was there.", [False]),
        ("Absence of fever; cough", [True, False]),
        ("Without doubt fever was not ruled out", [False]),
        ("no one two three four five six fever", [False]),
        ("no one two three four five fever", [True]),
        ("It failed to raise the fever whereas cough did", [True, False]),
        ("fever was not seen", [False]),
        ("", []),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)] + [(99, None)], "doc_id long, text string")
    terms = spark.createDataFrame([(1, "fever"), (2, "cough")], "term_id long, term string")
    got = {r.doc_id: r.negated for r in entities.negated(entities.matched(df, terms)).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)} | {99: []}
