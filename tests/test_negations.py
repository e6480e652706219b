"""negations against its SQL where the text's end denies, a text is null, or a word stands beside a letter with an accent."""

import duckdb

from litforge.plans.forms import query  # noqa: F401  (registers)
from litforge.plans.queries import ORACLES, QUERIES

TEXTS = ["it was not", "It was NOT", "so no", "there was no change", "", None, "énot changed", "no échange", "nothing associated", "no aſſociation", "not. change", "no" + " " * 40 + "change", "no" + " " * 42 + "change"]


def test_texts_and_what_is_put_behind_them(spark, tmp_path):
    rows = [(4 * n + k, t) for n, t in enumerate(TEXTS) for k in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = {tuple(r) for r in QUERIES["negations"](spark, str(tmp_path)).select("doc_id", "negated").collect()}
    want = set(con.execute(ORACLES["negations"]).fetchall())
    assert got == want and len(got) == len(rows)
