"""The inferred automata and their scores against plain versions, and what they find and leave alone."""

import math
import random
import re
import string
import time

import pytest

from litforge.llm.op6_secret_scan import ALPHABET, FORMATS, Automaton, Scanner, labelled


@pytest.fixture(scope="module")
def scanner():
    return Scanner()


def plain_score(scanner, label, s):
    """The log likelihood ratio, symbol by symbol."""
    automaton, at, out = scanner.automata[label], 0, 0.0
    for c in s:
        to, chance = automaton.moves[at].get(c, (at, automaton.other[at]))
        out, at = out + chance - math.log(1 / (len(ALPHABET) + 1)), to
    return out + automaton.stop[at]


def plain_best(scanner, s):
    """The highest sum that any cut into parts and rests reaches, by trying every part at every end."""
    joints = [i for i, c in enumerate(s) if c in "+/_=-"]
    best = [0.0]
    for j in range(1, len(s) + 1):
        best.append(best[-1])
        if j < len(s) and j not in joints:
            continue
        for label, prefix in scanner.prefix.items():
            for i in range(j):
                fits = s.startswith(prefix, i) if len(prefix) > 2 else i == 0 or i - 1 in joints
                if fits and j - i >= scanner.least[label]:
                    best[j] = max(best[j], best[i] + plain_score(scanner, label, s[i:j]) - scanner.threshold)
    return best[-1]


def test_cuts_are_the_best_ones(scanner):
    rng = random.Random(12)
    some = labelled(4, seed=5)
    for _ in range(60):
        bits = [rng.choice(some)[1][: rng.choice([12, 30, 200])] if rng.random() < 0.5 else "".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 20))) for _ in range(rng.randint(1, 4))]
        s = rng.choice(["", "-", "/"]).join(bits)
        loose = Scanner.__new__(Scanner)
        loose.__dict__ = {**scanner.__dict__, "rest": dict.fromkeys(scanner.rest, ())}  # without going on behind a part
        got = loose.parts(s)
        assert all(a < b <= c for (a, b, _), (c, _, _) in zip(got, got[1:]))
        assert all(plain_score(scanner, k, s[a:b]) >= scanner.threshold - 1e-9 for a, b, k in got)
        assert math.isclose(sum(plain_score(scanner, k, s[a:b]) - scanner.threshold for a, b, k in got), plain_best(scanner, s), abs_tol=1e-6)


def test_prefix_states_stay_apart(scanner):
    for label, prefix, alphabet, _, _ in FORMATS:
        automaton, at = scanner.automata[label], 0
        for c in prefix:  # each state of the prefix knows its next symbol only
            assert list(automaton.moves[at]) == [c], label
            at = automaton.moves[at][c][0]
        assert set(automaton.moves[at]) == set(alphabet)
    assert scanner.score("ABCDEFGHIJKLMNOP1234")[0] < scanner.threshold
    # compatible states are merged: a loop of two symbols has few states
    assert len(Automaton(["xy" * n for n in range(1, 30)] * 5).states) < 30


def negatives(rng, n):
    """Long runs that are no secrets: names, slugs, dates, numbers, UUIDs, versions, words in base64."""
    words = "report final data model user name value index table query stream window batch cluster worker driver http static assets image".split()
    word = lambda: rng.choice(words)
    made = (
        lambda: "".join(word().title() for _ in range(4)) + str(rng.randint(1, 999)),
        lambda: "-".join([word(), word(), word(), str(rng.randint(1, 9999))]),
        lambda: "_".join([word().upper(), word().upper(), word().upper(), str(rng.randint(1, 99))]),
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}-{rng.randint(0, 23):02d}-{rng.randint(0, 59):02d}-{rng.randint(0, 59):02d}",
        lambda: "-".join("".join(rng.choice("0123456789abcdef") for _ in range(k)) for k in (8, 4, 4, 4, 12)),
        lambda: "/".join([word(), word(), word(), str(rng.randint(1, 10**6))]),
        lambda: "-".join(str(rng.randint(100, 9999)) for _ in range(5)),
        lambda: "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(40)),
    )
    return [rng.choice(made)() for _ in range(n)]


def test_recall_and_precision(scanner):
    new = labelled(60, seed=77)
    found = {}
    for label, s in new:
        text = f"config KEY={s} and more"
        hit = any(a <= 11 and b >= 11 + len(s) for a, b, _ in scanner.scan(text))
        found.setdefault(label, []).append(hit)
    recall = {k: sum(v) / len(v) for k, v in found.items()}
    assert min(recall.values()) >= 0.9, recall
    wrong = [s for s in negatives(random.Random(78), 4000) if scanner.more(f"see {s} here", [])]
    assert len(wrong) <= 0.005 * 4000, wrong[:10]


def test_time_is_in_proportion(scanner):
    rng = random.Random(4)
    hexes = lambda n: " ".join("".join(rng.choice("0123456789abcdef") for _ in range(24)) for _ in range(n))
    keys = lambda n: "/".join("ghp_" + "a1B2" * 9 for _ in range(n))
    for made in (hexes, keys):
        took = []
        for n in (4000, 16000):
            text, began = made(n // (1 if made is hexes else 20)), time.process_time()
            spans = scanner.scan(text)
            took.append(time.process_time() - began)
            assert len(spans) >= len(re.split("[ /]", text))
        assert took[1] < 12 * took[0] + 0.5
