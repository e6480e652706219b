import pytest

from litforge.llm.op6_secret_scan import Scanner, labelled


@pytest.fixture(scope="module")
def scanner():
    return Scanner()


@pytest.mark.parametrize("before", ["GITHUB_PAT=", "KEY=", "auth/v1/", "https://h.example/x-", "a_b-c/"])
def test_found_behind_names_paths_and_urls(scanner, before):
    def found(lead, s):
        text = f"see {lead}{s} here"
        at = text.index(s)
        return any(a <= at and at + len(s) <= b for a, b, _ in scanner.scan(text))

    new = labelled(30, seed=99)
    for label in {k for k, _ in new}:
        strings = [s for k, s in new if k == label]
        assert sum(found(before, s) for s in strings) >= sum(found("", s) for s in strings)


def test_all_parts_of_a_token_and_of_a_run(scanner):
    token = "eyJ" + "hbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9" + ".eyJ" + "zdWIiOiIxMjM0NTY3ODkwIn0" + ".dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
    a, b, kind = scanner.scan(f"KEY={token} x")[0]
    assert kind == "jwt" and a <= 4 and b == 4 + len(token)
    two = "a/ghp_" + "a1B2" * 9 + "/b/ghp_" + "C3d4" * 9
    assert [k for _, _, k in scanner.scan(two)] == ["github"] * 2
    assert scanner.scan("internationalisation2 2024-01-15-report-final a/b/c/d/e/f/g/h/i/9 the_quick_brown_fox_1") == []


def test_only_what_lies_in_a_base_span_is_left_out(scanner):
    held = "ghp_" + "a1B2" * 5 + "0123456789abcdef"  # 16 lower-case hex characters end it
    text = f"see {held} here"
    assert (4, 4 + len(held), "github") in scanner.scan(text)
    assert [k for _, _, k in scanner.scan("token=ghp_" + "a1B2" * 9)] == ["assign"]
