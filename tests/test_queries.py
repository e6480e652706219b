"""Every registered query of the base library against its SQL."""

import math

import duckdb
import pytest

from litforge.plans import derived, forms, learned  # noqa: F401  (they register their queries)
from litforge.plans.queries import _LINES, _NOISY, ANSWERS, JUNK, ORACLES, QUERIES, _strip

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(float(v), 6) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, D)
    got = con.execute(ORACLES[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = rows(columns, got.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want and want


def test_only_these_have_no_sql():
    assert set(QUERIES) - set(ORACLES) == {"prompt_tokens", "tagger_scores", "nearest_by_index"}


def test_every_branch_changes_a_row(con):
    """Chunks that are junk for one reason only, for each reason, and chunks that a wider pattern would take."""
    chunks = f"(SELECT {_strip('chunk')} AS c FROM ({_LINES.format(_NOISY)}))"
    for name, test in JUNK.items():
        others = " OR ".join(f("c") for n, f in JUNK.items() if n != name)
        assert con.execute(f"SELECT count(*) FROM {chunks} WHERE {test('c')} AND NOT ({others})").fetchall()[0][0] > 0, name
    assert con.execute(f"SELECT count(*) FROM {chunks} WHERE c LIKE '10.123/%' AND NOT ({' OR '.join(f('c') for f in JUNK.values())})").fetchall()[0][0] > 0
    kinds = con.execute(f"SELECT DISTINCT event_id % {len(ANSWERS)} FROM events").fetchall()
    assert len(kinds) == len(ANSWERS)
    found = {k for (k,) in con.execute(f"SELECT DISTINCT k IS NULL FROM ({ORACLES['tolerant_json']})").fetchall()}
    assert found == {True, False}
