import json

import pytest
from pyspark.sql import functions as F

from litforge.functions import tags
from litforge.operators import sections
from litforge.plans import jobs
from litforge.sources import files, service


def read(path, pattern="part-*"):
    return "".join(p.read_text() for p in sorted(path.glob(pattern)))


def test_clean_articles_goes_on(spark, tmp_path):
    source, target = tmp_path / "in.json", tmp_path / "out"
    first = {"a": {"chunks": ["word [1].", 'say "x"']}, "b": ["y  z"]}
    source.write_text(json.dumps(first))
    assert jobs.clean_articles(spark, str(source), str(target))["processed_articles"] == 2
    source.write_text(json.dumps(first | {"c": "new"}))
    stats = jobs.clean_articles(spark, str(source), str(target), batches=2)
    assert (stats["resumed_articles"], stats["processed_articles"], stats["total_chunks_processed"]) == (2, 3, 1)
    got = json.loads((target / "output").read_text())
    assert json.loads((target / "output.stats.json").read_text())["processed_articles"] == 3
    assert got == {"a": 'word. say "x"', "b": "y z", "c": "new"} and list(got) == ["a", "b", "c"]


def test_clean_articles_by_model(spark, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps({"a": ["one"], "b": ["two [3]"]}))

    def model(name, prompt):
        if "two" in prompt:
            raise ValueError("no")
        return prompt + "Here is the cleaned and merged text: fine ..  text"

    jobs.clean_articles(spark, str(tmp_path / "in.json"), str(tmp_path / "out"), model)
    assert (tmp_path / "out" / "output").read_text() == '{\n  "a": "fine. text",\n  "b": "two"\n}\n'
    jobs.clean_articles(spark, str(tmp_path / "in.json"), str(tmp_path / "out"), drop_store=True)
    assert not (tmp_path / "out" / "cleaned").exists()


def test_log(tmp_path):
    jobs.log_to(str(tmp_path / "log"), "litforge-test").info("read %d", 3)
    assert "INFO - read 3" in (tmp_path / "log").read_text()


def test_empty_object(spark, tmp_path):
    none = spark.createDataFrame([], "k string, v string, o int")
    files.write_object(none, "k", "v", "o", str(tmp_path / "o"))
    assert json.loads((tmp_path / "o").read_text()) == {} and files.if_there(spark, str(tmp_path / "not")) is None


def test_extraction_matrix(spark):
    papers = spark.createDataFrame([(f"p{i}", i, ["x" * 40]) for i in range(6)] + [("junk", 6, ["short"])], "id string, pos int, chunks array<string>")

    def call(model, prompt):
        if model == "bad":
            raise ValueError("down")
        return '{"bacteria_relationships":[{},{}]}' if model == "good" else "nothing"

    got = jobs.extraction_matrix(papers, ["good", "bad", "odd"], call, "P:", ":S", excluded=(0,), wait=0.0).cache()
    assert got.count() == 12 and not got.where("paper_id in ('p0', 'junk')").count()
    assert {(r.model, r.status, r.n, r.error) for r in got.collect()} == {("good", "ok", 2, None), ("bad", "error", None, "failed after 3 attempts: down"), ("odd", "error", None, "JSON parse failed")}
    assert {(r.good, r.bad, r.none) for r in jobs.paper_summary(got, ["good", "bad", "none"]).collect()} == {(2, None, 0)}


def test_studies(spark, tmp_path):
    (tmp_path / "S1.json").write_text(json.dumps([{"sample_accession": "b", "sample_alias": "B", "sample_title": "", "study_accession": "S1"}, {"sample_accession": "a", "study_accession": "S1"}]))
    (tmp_path / "c.csv").write_text('code,Notes,Notes\r\nS1,"x\r\ny",\r\nS1,,\r\nS9,,\r\n')
    found, failed = jobs.study_rollups(spark, str(tmp_path / "c.csv"), "code", service.folder(str(tmp_path)), str(tmp_path / "t"))
    assert [(r.total_samples_found, r.alias, r.title) for r in found.collect()] == [(4, ["N/A", "N/A", "B", "B"], ["N/A", "N/A", "", ""])]
    assert [r.study_accession for r in failed.collect()] == ["S9"] and json.loads((tmp_path / "t" / "studies" / "S1_metadata.json").read_text()) == {"study_accession": "S1", "total_samples_found": 4, "alias": ["N/A", "N/A", "B", "B"], "title": ["N/A", "N/A", "", ""]}
    name = service.register(spark, service.folder(str(tmp_path)))
    asked = spark.read.format(name).option("studies", "S1,S9,S8").load()
    assert asked.where("study_accession = 'S1'").rdd.getNumPartitions() == 1 and asked.where("error is not null").count() == 2
    assert spark.read.format(service.register(spark, service.folder(str(tmp_path)))).load().count() == 0


def test_tagged_to_conll(spark, tmp_path):
    rows = ["head"] + ["t%d,u,\r\n\"['B-D', 'O']\",,\r\n,," % i for i in range(10)]
    (tmp_path / "w.csv").write_text("\r\n".join(rows), newline="")
    found = jobs.tagged_to_conll(spark, str(tmp_path / "w.csv"), str(tmp_path / "t"))
    assert [r.tag for r in found.collect()] == ["B-D", "O"]
    sizes = [read(tmp_path / "t" / s).count("B-D") for s in ("train", "val", "test")]
    assert sizes == [7, 1, 2] and read(tmp_path / "t" / "val") == "t7\tB-D\nu\tO\n\n"
    assert json.loads(read(tmp_path / "t" / "labels")) == {"label_to_id": {"B-D": 0, "O": 1}, "id_to_label": {"0": "B-D", "1": "O"}}


def test_sections(spark):
    new = {"microbe_relationships": [{"taxon_name": "t", "domain": "fungi", "quantitative_data": {"p_value": 0.01}}, "odd"], "mechanistic_pathways": [{"description": "d", "steps": [{"name": "X"}, {"name": "Y"}]}, {"description": "e"}], "extraction_metadata": {"total_microbes_found": "3", "contradictions_found": ["c"]}}
    old = {"bacteria_relationships": [{"taxon_name": "u"}], "extraction_metadata": {"total_bacteria_found": 1}}
    papers = spark.createDataFrame([("n", json.dumps(new)), ("o", json.dumps(old)), ("x", "{"), ("y", None)], "id string, j string")
    got = sections.section(papers, "j", "id", "microbe_relationships").orderBy("id", "pos").collect()
    assert [(r.id, r.pos, r.taxon_name, r.domain) for r in got] == [("n", 0, "t", "fungi"), ("n", 1, None, "bacteria"), ("o", 0, "u", "bacteria")] and got[0].quantitative_data == {"p_value": "0.01"}
    steps = sections.steps(sections.section(papers, "j", "id", "mechanistic_pathways"), "id")
    assert sorted((r.pos, r.step, r.name) for r in steps.where("name is not null").collect()) == [(0, 0, "X"), (0, 1, "Y")] and steps.count() == 3
    assert [tuple(r) for r in sections.incomplete(papers, "j", "id").collect()] == [("n", 3, 2)]
    assert [r.text for r in sections.contradictions(papers, "j", "id").collect()] == ["c"]
    for name in sections.SECTIONS:
        assert sections.section(papers, "j", "id", name).count() >= 0


def test_tag_conversions(spark):
    f = lambda v: spark.createDataFrame([("f", v)], "file string, value string")
    got = tags.zipped_lines(f("a b\n\nc d e"), f("O B-X\n\nI-X O")).orderBy("sent_id").collect()
    assert [(r.sent_id, [tuple(p) for p in r.pairs]) for r in got] == [(0, [("a", "O"), ("b", "B-X")]), (2, [("c", "I-X"), ("d", "O")])]
    tokens = spark.createDataFrame([("a", "O"), ("b", "Z")], "token string, tag string")
    ids = tags.label_ids(tokens.where("tag = 'O'"))
    assert tags.with_ids(tokens.where("tag = 'O'"), ids).first().label_id == 0
    with pytest.raises(Exception, match="unknown label: Z"):
        tags.with_ids(tokens, ids).select(F.sum("label_id")).collect()


def test_write_results(spark, tmp_path):
    rows = [("b", "2", "ok", '{"a":[1]}', None, None, 1.5), ("b", "1", "error", None, "JSON parse failed", 'x "y"', None), ("a", "1", "ok", "{}", None, None, 0.0), ("a", "1", "error", None, "late", None, None), ("b", 'é"', "ok", None, None, None, 2.0)]
    schema = "model string, paper_id string, status string, extraction string, error string, raw string, elapsed_s double"
    jobs.write_results(spark.createDataFrame(rows, schema), ["1", "é"], str(tmp_path / "r"))
    want = {"papers_sampled": ["1", "é"], "timings": {"a": {"1": 0.0}, "b": {"1": None, "2": 1.5, 'é"': 2.0}}, "results": {"a": {"1": {}}, "b": {"1": {"error": "JSON parse failed", "raw": 'x "y"'}, "2": {"a": [1]}, 'é"': None}}}
    assert json.loads((tmp_path / "r").read_text()) == want
    jobs.write_results(spark.createDataFrame(rows[2:3], schema), [], str(tmp_path / "one"))
    assert json.loads((tmp_path / "one").read_text()) == {"papers_sampled": [], "timings": {"a": {"1": 0.0}}, "results": {"a": {"1": {}}}}
    jobs.write_results(spark.createDataFrame([], schema), [], str(tmp_path / "none"))
    assert json.loads((tmp_path / "none").read_text()) == {"papers_sampled": [], "timings": {}, "results": {}}
