"""The boundaries over HTTP, against a small server of the test's own, and answers that are kept."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from litforge.functions import jsonx
from litforge.operators import extract
from litforge.sources import files, service


class Handler(BaseHTTPRequestHandler):
    seen: list = []

    def say(self, code, body):
        self.send_response(code)
        self.send_header("Content-Type", "application/json; charset=utf-8")
        self.end_headers()
        self.wfile.write(body.encode())

    def do_GET(self):
        asked = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
        self.seen.append(asked)
        study = asked["query"].split('"')[1]
        if study == "S9":
            return self.say(404, "no such study")
        self.say(200, json.dumps([{"sample_accession": f"{study}-{i}", "sample_alias": "é", "study_accession": study} for i in range(2)]))

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.seen.append((self.path, dict(self.headers), body))
        if self.path == "/messages":
            prompt, wrap = body["messages"][0]["content"], lambda t: {"content": [{"text": t}]}
        elif self.path == "/chat":
            prompt, wrap = body["messages"][1]["content"], lambda t: {"choices": [{"message": {"content": t}}]}
        else:
            prompt, wrap = body["contents"][0]["parts"][0]["text"], lambda t: {"candidates": [{"content": {"parts": [{"text": t}]}}]}
        self.say(503, "busy") if "busy" in prompt else self.say(200, json.dumps(wrap(f"to {prompt}")))

    def log_message(self, *_):
        pass


@pytest.fixture()
def server():
    made = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    Handler.seen = []
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}"
    made.shutdown()


def test_studies_over_http(spark, server):
    name = service.register(spark, service.http(server), "studies_over_http")
    bodies = spark.read.format(name).option("studies", "S1,S9,S1").load().cache()
    found, failed = files.samples(bodies)
    assert sorted(r.sample_accession for r in found.collect()) == ["S1-0", "S1-0", "S1-1", "S1-1"] and {r.sample_alias for r in found.collect()} == {"é"}
    assert [(r.study_accession, r.error.split(":")[0]) for r in failed.collect()] == [("S9", "HTTPError")]
    one = Handler.seen[0]
    assert (one["result"], one["format"], one["limit"]) == ("sample", "json", "0") and one["query"].startswith('study_accession="S') and "sample_alias" in one["fields"].split(",")


FORMS = {"alpha": ("messages", "a-1"), "beta": ("chat", "b-1"), "gamma": ("contents", "c-1")}


def ends(server, key=None):
    return {m: extract.Endpoint(f"{server}/{form}", key) for m, (form, _) in FORMS.items()}


def test_models_over_http(spark, server):
    prompts = spark.createDataFrame([(m, str(i), p) for m in FORMS for i, p in enumerate(("one é", "busy"))], "model string, paper_id string, prompt string")
    call = extract.client(FORMS, extract.posted(ends(server)), "sys")
    got = {(r.model, r.paper_id): r for r in extract.asked(prompts, call, tries=2, wait=0.0).collect()}
    assert {got[m, "0"].raw for m in FORMS} == {"to one é"} and {got[m, "1"].error for m in FORMS} == {"failed after 2 attempts: HTTP 503: busy"}
    assert all(got[m, "1"].elapsed_s is None and got[m, "0"].elapsed_s is not None for m in FORMS)
    assert sum("busy" in str(s) for s in Handler.seen) == 6  # each fault twice
    raw = spark.createDataFrame([(json.dumps({"content": [{"text": "x"}]}),)], "b string")
    assert raw.select(jsonx.provider_text("b").alias("t")).first().t == "x"


def test_keys_are_read_where_they_are_used(server, monkeypatch):
    send = extract.posted(ends(server, "LITFORGE_TEST_KEY"))
    with pytest.raises(PermissionError, match="LITFORGE_TEST_KEY is not set"):
        send("beta", extract.request("chat", "b-1", "s", "u"))
    monkeypatch.setenv("LITFORGE_TEST_KEY", "abc")
    send("beta", extract.request("chat", "b-1", "s", "u"))
    assert Handler.seen[-1][1]["Authorization"] == "Bearer abc" and b"abc" not in repr(send.__closure__).encode()


def test_ask_once(spark, server, tmp_path):
    call, store = extract.client(FORMS, extract.posted(ends(server)), "sys"), str(tmp_path / "answers")
    schema = "model string, paper_id string, prompt string"
    prompts = spark.createDataFrame([("alpha", "a", "p"), ("alpha", "b", "p"), ("beta", "a", "p"), ("alpha", "c", "busy"), ("alpha", "d", None), (None, "e", "p")], schema)
    got = {(r.model, r.paper_id): (r.raw, r.error) for r in extract.ask_once(prompts.where("model is not null"), call, store, tries=1).collect()}
    assert got["alpha", "a"] == got["alpha", "b"] == got["beta", "a"] == ("to p", None)
    assert got["alpha", "c"] == (None, "failed after 1 attempts: HTTP 503: busy") and got["alpha", "d"] == (None, "not asked yet")
    assert len(Handler.seen) == 3  # the shared prompt once a model, the fault once
    extract.ask_once(prompts.where("model is not null").union(spark.createDataFrame([("alpha", "z", "new")], schema)), call, store, tries=1).collect()
    assert len(Handler.seen) == 5  # the new prompt, and the fault again
    assert spark.read.parquet(store).count() == 5 and extract.kept(spark.read.parquet(store)).count() == 4
    assert extract.answered(prompts, spark.read.parquet(store)).count() == 6  # a null model is a row too, without an answer


def test_an_answer_comes_before_a_fault(spark):
    rows = spark.createDataFrame([("m", "h", None, "x", None), ("m", "h", "b", None, 1.0), ("m", "h", "a", None, 2.0)], "model string, prompt_md5 string, raw string, error string, elapsed_s double")
    assert [tuple(r) for r in extract.kept(rows).collect()] == [("m", "h", "a", None, 2.0)]
    assert extract.kept(rows.limit(0)).count() == 0
