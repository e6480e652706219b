import re

import corpus_pipeline as p
from litforge.llm.op6_secret_scan import Scanner
from tests.llm.test_op5 import brute

D = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    good = p.quality(spark, docs, D)
    assert good.columns == docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    ids = {r.doc_id for r in good.select("doc_id").collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in ids for i in clean) >= 0.97 * len(clean)

    rows = [(r.doc_id, r.text) for r in good.select("doc_id", "text").collect()]
    unique = p.near_duplicates(spark, good, D)
    assert unique.columns == docs.columns
    left = {r.doc_id for r in unique.collect()}
    assert left == {i for i, low, _ in brute(rows) if i == low}

    words = lambda t: " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower()))
    items = [words(r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    apart = p.decontamination(spark, unique, D)
    assert apart.columns == docs.columns
    texts = {i: words(t) for i, t in rows if i in left}
    whole = {i for i, t in texts.items() if any(x in t for x in items)}
    assert whole.isdisjoint({r.doc_id for r in apart.collect()}) and apart.count() == len(left) - len(whole)

    masked = {r.doc_id: r for r in p.secrets(spark, apart, D).collect()}
    scanner = Scanner()
    for r in apart.collect():
        spans = scanner.scan(r.text)
        assert (masked[r.doc_id].text == r.text) == (not spans) and masked[r.doc_id].n_chars == len(masked[r.doc_id].text)
        assert all(r.text[a:b] not in masked[r.doc_id].text for a, b, _ in spans)

    mixed = p.mixture(spark, apart, D)
    assert set(docs.columns) <= set(mixed.columns) and mixed.count() > 0


MORE = ["n_items", "item_id", "coverage", "N_TILES", "_n_items", "rate", "place", "id", "row", "key", "spans", "h", "n", "name", "class_id", "_rest"]
NAMES = ["doc_id", "text", "lang", "source", "n_chars", *MORE]


def odd_rows(docs):
    """Rows of the table with columns of clashing names, and beside them nulls, empty and long texts, ties and repeats."""
    rows = [tuple(r[c] for c in NAMES[:5]) for r in docs.orderBy("doc_id").limit(60).collect()]
    text = rows[0][1]
    rows += [(None, text, "en", None, None), (9001, None, None, "web", 0), (9001, None, None, "web", 0), (9002, "", "", "", 0), (9003, "", "", "", 0), (9004, text, "en", "web", len(text)), (9004, text, "en", "web", len(text)), (9004, "quite another text of few words", "en", "web", 1), (9005, "ü" * 200_000, "xx", "web", 1), (None, None, None, None, None)]
    return [(*r, *(f"{c}-mine" for c in MORE)) for r in rows]


def test_every_stage_on_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = odd_rows(docs)
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in MORE))
    odd.write.parquet(f"{tmp_path}/odd")
    odd = spark.read.parquet(f"{tmp_path}/odd")
    for name, stage in p.STAGES:
        got = stage(spark, odd, D)
        if name != "mixture":
            assert got.columns == NAMES
        found = [r.asDict() for r in got.collect()]
        own = [c for c in MORE if c not in ("rate", "place")] if name == "mixture" else MORE
        assert all(r[c] == f"{c}-mine" for r in found for c in own), name
        texts = sorted(str((r["doc_id"], r["text"])) for r in found)
        if name == "near_duplicates":
            kept = {str((r[0], r[1])) for r in rows if r[1] is None or not r[1]}
            assert len(texts) == len(set(texts)) and kept <= set(texts)  # texts without words: one row for each id and text
            worded = [(r[0], r[1]) for r in rows if r[1]]
            groups = {}
            for i, low, _ in brute([(n, t) for n, (_, t) in enumerate(worded)]):
                groups.setdefault(low, []).append(worded[i][0])
            least = [min(g, key=lambda i: (i is None, i)) for g in groups.values()]
            assert sorted(str(r["doc_id"]) for r in found if r["text"]) == sorted(map(str, least))
        if name == "decontamination":
            assert {str((r[0], r[1])) for r in rows if not r[1]} <= set(texts)
        if name == "secrets":
            assert len(texts) == len(rows)
    again = [sorted(map(str, stage(spark, odd, D).collect())) for _, stage in p.STAGES[1:2] for _ in range(2)]
    assert again[0] == again[1]


def test_run_and_empty(spark, tmp_path):
    assert p.run(spark, D).count() > 0
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{D}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
