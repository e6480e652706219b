"""Registered queries over readers, writers, tags, answers of models and extracted relations, each with its SQL. Raw forms
(files, answers, wide rows) are made of the tables' columns, in the same way on both sides; what a query writes on its
way lies in the session's shared folder and is deleted at the end of the process."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from litforge.functions import jsonx, tags, text, tokens
from litforge.operators import corpus, extract, generate, rollup, sections
from litforge.plans import jobs
from litforge.plans.queries import _K, _fallback, _strip, query, table
from litforge.sources import files
from litforge.streaming import events as streams

_scratch: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A place of one's own in the folder that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    shared = shared or spark.conf.get("spark.sql.warehouse.dir")
    if not _scratch:
        atexit.register(_clean)
    _scratch.append((spark, f"{shared.rstrip('/')}/litforge-queries/{name}-{uuid.uuid4().hex}"))
    return _scratch[-1][1]


def _clean() -> None:
    while _scratch:
        try:
            files.drop(*_scratch.pop())
        except Exception:  # the session has ended: whoever owns the folder cleans it
            return


def _j(*parts):
    """A text of literals and columns."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _of(column: str, forms: list):
    """The form of a row by column % the number of forms."""
    out = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        out = F.when(F.col(column) % len(forms) == i, F.lit(form) if isinstance(form, str) else form).otherwise(out)
    return out


def talks(spark, sf_dir):
    """Conversations with their texts as a JSON list."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.coalesce("text", F.lit("")).alias("t")).alias("s"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("s")).select("conv_id", F.transform("s", lambda x: x["t"]).alias("texts")).withColumn("j", F.to_json("texts"))


_TALKS = "t AS (SELECT conv_id, count(*) AS n, string_agg(coalesce(text, ''), '|' ORDER BY turn) AS x, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS y, arg_min(coalesce(text, ''), turn) AS f FROM conversations GROUP BY conv_id)"


@query(f"""WITH {_TALKS}
SELECT conv_id AS file, 'c' || conv_id AS article_id, 0 AS pos, 'n' || conv_id AS name, n, md5(x) AS chunks FROM t
UNION ALL SELECT conv_id, 'l' || conv_id, 1, NULL, 1, md5(f) FROM t
UNION ALL SELECT conv_id, 's' || conv_id, 2, NULL, 1, md5('plain ' || conv_id) FROM t
UNION ALL SELECT conv_id, 'o' || conv_id, 3, 'x', 1, md5('{{"name":"x"}}') FROM t
UNION ALL SELECT conv_id, 'e' || conv_id, 4, NULL, 0, md5('') FROM t""")
def article_read(spark, sf_dir):
    i = F.col("conv_id")
    raw = talks(spark, sf_dir).select(i.alias("file"), _j('{"c', i, '": {"name": "n', i, '", "chunks": ', F.col("j"), '}, "l', i, '": ', F.to_json(F.slice("texts", 1, 1)), ', "s', i, '": "plain ', i, '", "o', i, '": {"name":"x"}, "e', i, '": {"chunks": []}}').alias("value"))
    return files.articles(raw).select("file", "article_id", "pos", "name", F.size("chunks").cast("long").alias("n"), F.md5(F.array_join("chunks", "|")).alias("chunks"))


@query(f"""WITH {_TALKS}
SELECT conv_id AS file, 0 AS pos, CASE WHEN conv_id % 2 = 0 THEN 'p' || conv_id ELSE 'paper_1' END AS id, CASE WHEN conv_id % 2 = 0 THEN 't' ELSE 'Untitled' END AS title, md5(y) AS body FROM t
UNION ALL SELECT conv_id, 1, 'paper_2', 'Untitled', md5('t ' || conv_id) FROM t
UNION ALL SELECT conv_id, 2, 'paper_3', 'Untitled', md5('{{"other":1}}') FROM t WHERE conv_id % 2 = 0""")
def paper_read(spark, sf_dir):
    i, j = F.col("conv_id"), F.col("j")
    listed = _j('[{"id": "p', i, '", "name": "t", "chunks": ', j, ', "text": "no"}, {"text": "t ', i, '"}, {"other":1}]')
    keyed = _j('{"k": {"chunks": ', j, '}, "m": {"text": "t ', i, '"}}')
    raw = talks(spark, sf_dir).select(i.alias("file"), _of("conv_id", [listed, keyed]).alias("value"))
    return files.papers(raw).select("file", "pos", "id", "title", F.md5("text").alias("body"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, md5(text) AS body, NULL AS quality FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, NULL, CAST(quality AS VARCHAR) FROM labels""")
def csv_round_trip(spark, sf_dir):
    path = scratch(spark, "csv")
    files.write_csv([table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")], path)
    return files.table(spark, path).select("doc_id", "lang", F.md5("text").alias("body"), "quality")


@query("""WITH c AS (SELECT c_custkey AS k FROM customer UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0)
SELECT 'N' || k AS study, count(o_orderkey) AS n, coalesce(string_agg(CASE WHEN o_orderkey % 3 = 2 THEN 'N/A' ELSE 'a' || o_orderkey END, '|' ORDER BY CAST(o_orderkey AS VARCHAR)), '') AS alias, NULL AS error FROM c JOIN orders ON o_custkey = k WHERE k % 5 <> 4 GROUP BY k
UNION ALL SELECT 'N' || k, 0, NULL, 'HTTPError: no such study' FROM c WHERE k % 5 = 4""")
def study_samples(spark, sf_dir):
    """Customers as studies, whose orders are their samples: what a service has answered, some codes asked for twice, and
    some of which it does not know."""
    k = F.col("c_custkey")
    codes = table(spark, sf_dir, "customer").select(F.explode(F.when(k % 7 == 0, F.array(k, k)).otherwise(F.array(k))).alias("k"))
    study = _j("N", F.col("k"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.struct(F.col("o_orderkey").cast("string").alias("sample_accession"), F.when(F.col("o_orderkey") % 3 != 2, _j("a", F.col("o_orderkey"))).alias("sample_alias"), F.lit("").alias("sample_title"), _j("N", F.col("o_custkey")).alias("study_accession")).alias("s"))
    said = codes.join(orders.groupBy("k").agg(F.to_json(F.collect_list("s")).alias("body")), "k", "left")
    unknown = F.col("k") % 5 == 4
    bodies = said.select(study.alias("study_accession"), F.when(~unknown, F.coalesce("body", F.lit("[]"))).alias("body"), F.when(unknown, "HTTPError: no such study").alias("error"))
    found, failed = files.samples(bodies)
    rows = found.select("study_accession", "sample_accession", F.coalesce("sample_alias", F.lit("N/A")).alias("alias"))
    grouped = rollup.rollup(rows, "study_accession", "sample_accession", ["alias"])
    return grouped.select(F.col("study_accession").alias("study"), F.col("total").cast("long").alias("n"), F.array_join("alias", "|").alias("alias"), F.lit(None).cast("string").alias("error")).unionByName(failed.select(F.col("study_accession").alias("study"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("alias"), "error"))


@query("SELECT r_name AS asked_for, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 AS pos, CAST(n_nationkey AS VARCHAR) AS sample_accession, n_name AS sample_alias, 'none' AS sample_title FROM nation JOIN region ON n_regionkey = r_regionkey")
def study_tsv(spark, sf_dir):
    lines = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = lines.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.concat_ws("\t", "n_name", F.col("n_nationkey").cast("string")).alias("l")))).alias("l"))
    bodies = rows.select(F.col("r_name").alias("study_accession"), _j("sample_alias\tsample_accession\n", F.array_join(F.transform("l", lambda x: x["l"]), "\n"), "\n").alias("body"), F.lit(None).cast("string").alias("error"))
    return files.tabbed_samples(bodies).select("asked_for", F.col("pos").cast("long").alias("pos"), "sample_accession", "sample_alias", F.coalesce("sample_title", F.lit("none")).alias("sample_title"))


_WORDS = "w AS (SELECT item_id AS file, string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' ') AS w FROM benchmark)"


def words(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("file"), F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " ")), " ").alias("w"))


@query(f"""WITH {_WORDS}, s AS (SELECT file, unnest([[0, 0], [0, 1], [0, 2], [1, 0], [2, 0], [2, 1]]) AS spot, unnest([w[1], w[2], 'its', w[3], w[6], w[7]]) AS token, unnest(['O', 'B-X', 'O', 'B-Y', 'O', 'B-Z']) AS tag FROM w)
SELECT file, CAST(spot[1] AS BIGINT) AS sent_id, CAST(spot[2] AS INTEGER) AS pos, token, tag FROM s""")
def wide_tags(spark, sf_dir):
    w = lambda i: F.get("w", F.lit(i))
    # equal lists; fewer tags than tokens; a blank row in a pair; empty cells; a row without tags at the end
    value = _j("C1,C2\n", w(0), ",", w(1), ",it's\n\"['O',\",\"'B-X',\",\"'O']\"\n,,\n", w(2), ",", w(3), "\n['B-Y'],\n,,\n,,\n", w(4), ",\n,\n['O'],\n,\n\"\"\"", w(5), "\"\"\",,", w(6), "\nO,\",B-Z\"\n", w(7), ",\n")
    found = tags.wide_bio(files.wide_rows_of(words(spark, sf_dir).select("file", value.alias("value"))))
    return found.select("file", "sent_id", F.posexplode("pairs").alias("pos", "p")).select("file", "sent_id", "pos", "p.token", "p.tag")


@query("SELECT doc_id, false AS was_there FROM documents WHERE doc_id % 2 <> 0")
def resume_store(spark, sf_dir):
    docs, store = table(spark, sf_dir, "documents").select("doc_id"), scratch(spark, "store")
    before = files.if_there(spark, store) is not None
    docs.where("doc_id % 2 = 0").write.mode("append").parquet(store)
    return rollup.pending(docs, files.if_there(spark, store), "doc_id").withColumn("was_there", F.lit(before))


@query("SELECT n_name AS model, n_regionkey % 2 = 0 AS asked, CASE WHEN n_regionkey % 2 <> 0 THEN 'KEY_' || n_regionkey END AS missing FROM nation")
def models_with_keys(spark, sf_dir):
    """A catalogue of models, of which some have a key that is set."""
    models = {r["n_name"]: f"KEY_{r['n_regionkey']}" for r in table(spark, sf_dir, "nation").collect()}  # a catalogue
    there, missing = extract.with_keys(models, {k: "x" if int(k[-1]) % 2 == 0 else "" for k in models.values()})
    return spark.createDataFrame([(m, m in there, k if k in missing else None) for m, k in models.items()], "model string, asked boolean, missing string")


@query("SELECT page_id, url FROM pages WHERE page_id % 5 = 0")
def failed_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("html", F.when(F.col("page_id") % 10 == 0, "<p> </p><script>x</script>").when(F.col("page_id") % 5 == 0, F.lit(None)).otherwise(F.col("html")))
    return corpus.scraped(pages)[1].select("page_id", "url")


@query("SELECT CAST(item_id AS VARCHAR) AS article_id, row_number() OVER (ORDER BY item_id) - 1 AS pos, md5(text || chr(10) || '\"é') AS body FROM benchmark")
def object_round_trip(spark, sf_dir):
    path = scratch(spark, "object")
    files.write_object(table(spark, sf_dir, "benchmark").withColumn("text", _j(F.col("text"), '\n"é')), "item_id", "text", "item_id", path)
    return files.article_corpus(spark, path).select("article_id", F.col("pos").cast("long").alias("pos"), F.md5(F.get("chunks", F.lit(0))).alias("body"))


@query("SELECT r_name || '_metadata.json' AS file, r_name || 'é' AS study, count(*) AS n, string_agg(n_name, '|' ORDER BY n_nationkey) AS alias FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def group_files(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    grouped, path = rollup.rollup(rows, "r_name", "n_nationkey", ["n_name"]).withColumn("study", _j(F.col("r_name"), "é")), scratch(spark, "groups")
    files.write_group_files(grouped, "r_name", path)
    v = F.try_parse_json("value")
    read = spark.read.text(path, wholetext=True).select(F.url_decode("_metadata.file_name").alias("file"), "value").where(F.col("value").contains("\n  ") & ~F.col("value").contains("é"))
    return read.select("file", F.try_variant_get(v, "$.study", "string").alias("study"), F.try_variant_get(v, "$.total", "long").alias("n"), F.array_join(F.try_variant_get(v, "$.n_name", "array<string>"), "|").alias("alias"))


@query(f"WITH {_WORDS}, t AS (SELECT file, unnest(range(len(w))) AS pos, unnest(w) AS token FROM w) SELECT token, CASE WHEN pos % 3 = 0 THEN 'B-W' ELSE 'O' END AS tag, count(*) AS n FROM t GROUP BY 1, 2")
def conll_round_trip(spark, sf_dir):
    pairs = F.transform("w", lambda x, i: F.struct(x.alias("token"), F.when(i % 3 == 0, "B-W").otherwise("O").alias("tag")))
    path = scratch(spark, "conll")
    files.write_conll(words(spark, sf_dir).select(F.col("file").alias("sent_id"), tags.conll_text(pairs).alias("text")), path)
    read = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return tags.conll(read).groupBy("token", "tag").agg(F.count("*").alias("n"))


@query("""WITH i AS (SELECT event_type AS l, row_number() OVER (ORDER BY event_type) - 1 AS id FROM (SELECT DISTINCT event_type FROM events))
SELECT '{"label_to_id":{' || string_agg('"' || l || '":' || id, ',' ORDER BY id) || '},"id_to_label":{' || string_agg('"' || id || '":"' || l || '"', ',' ORDER BY id) || '}}' AS value FROM i""")
def label_file(spark, sf_dir):
    return files.label_map(tags.label_ids(table(spark, sf_dir, "events"), "event_type"))


_MODELS = ("alpha", "beta", "gamma")


def _asked(spark, sf_dir):
    """What three models have answered to the items, in the form of each: a table of answers, some of them faults."""
    text_ = F.col("text")
    listed = F.to_json(F.struct(F.array_repeat(F.create_map().cast("map<string,string>"), (F.length(text_) % 3).cast("int")).alias("bacteria_relationships")))
    reply = F.when(F.length(text_) % 5 == 4, F.concat(F.lit("none found: "), text_)).otherwise(_j("```json\n", listed, "\n```"))
    body = F.when(F.col("model") == "alpha", F.to_json(F.struct(F.array(F.struct(reply.alias("text"))).alias("content"))))
    body = body.when(F.col("model") == "beta", F.to_json(F.struct(F.array(F.struct(F.struct(reply.alias("content")).alias("message"))).alias("choices"))))
    body = body.otherwise(F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(reply.alias("text"))).alias("parts")).alias("content"))).alias("candidates"))))
    items = table(spark, sf_dir, "benchmark").withColumn("model", F.explode(F.array(*map(F.lit, _MODELS))))
    busy = F.length(text_) % 4 == 3
    answers = items.select("model", F.md5("text").alias("prompt_md5"), F.when(~busy, jsonx.provider_text(body)).alias("raw"), F.when(busy, "failed after 2 attempts: busy").alias("error"), F.when(~busy, F.lit(0.1)).alias("elapsed_s"))
    said = extract.answered(items.select("model", F.col("item_id").cast("string").alias("paper_id"), text_.alias("prompt")), answers)
    e, failed = jsonx.extraction(F.col("raw")), F.col("error").isNotNull()
    read = said.withColumn("e", e)
    return read.select("model", "paper_id", F.when(failed, "error").otherwise(F.col("e.status")).alias("status"), F.when(~failed, F.col("e.n")).alias("n"), F.coalesce("error", "e.error").alias("error"), F.col("e.raw").alias("raw"), "elapsed_s", F.col("raw").alias("answer"))


_SAID = """r AS (SELECT m.model, CAST(item_id AS VARCHAR) AS paper_id, text, CASE WHEN length(text) % 4 = 3 THEN 'failed after 2 attempts: busy' WHEN length(text) % 5 = 4 THEN 'JSON parse failed' END AS error, length(text) % 3 AS n
FROM benchmark, (VALUES ('alpha'), ('beta'), ('gamma')) m(model))"""


@query(f"""WITH {_SAID} SELECT model, paper_id, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status, CASE WHEN error IS NULL THEN n END AS n, error,
CASE WHEN error LIKE 'JSON%' THEN md5(left('none found: ' || text, 500)) END AS raw, error LIKE 'failed%' IS TRUE AS no_time FROM r""")
def asked_models(spark, sf_dir):
    found = _asked(spark, sf_dir)
    return found.select("model", "paper_id", "status", F.col("n").cast("long").alias("n"), "error", F.md5("raw").alias("raw"), F.col("elapsed_s").isNull().alias("no_time"))


@query(f"WITH {_SAID} SELECT paper_id, max(CASE WHEN model = 'alpha' AND error IS NULL THEN n END) AS alpha, max(CASE WHEN model = 'beta' AND error IS NULL THEN n END) AS beta, 0 AS never FROM r GROUP BY paper_id")
def paper_matrix(spark, sf_dir):
    found = jobs.paper_summary(_asked(spark, sf_dir), ["alpha", "beta", "never"])
    return found.select("paper_id", *(F.col(m).cast("long").alias(m) for m in ("alpha", "beta", "never")))


@query(f"WITH {_SAID} SELECT model, paper_id, error, CASE WHEN error IS NULL THEN n END AS n FROM r")
def combined_results(spark, sf_dir):
    found = _asked(spark, sf_dir).withColumn("extraction", F.to_json(jsonx.tolerant(F.col("answer"))))
    path = scratch(spark, "results")
    jobs.write_results(found, ["a", "b"], path)
    one = spark.read.text(path, wholetext=True)  # one file, as it is meant to be
    shape = "papers_sampled array<string>, timings map<string,map<string,double>>, results map<string,map<string,string>>"
    parsed = one.select(F.from_json("value", f"struct<{', '.join(p.replace(' ', ':', 1) for p in shape.split(', '))}>").alias("o"))
    cells = parsed.select(F.explode("o.results").alias("model", "papers")).select("model", F.explode("papers").alias("paper_id", "j"))
    v = F.try_parse_json("j")
    return cells.select("model", "paper_id", F.try_variant_get(v, "$.error", "string").alias("error"), F.size(F.try_variant_get(v, "$.bacteria_relationships", "array<variant>")).cast("long").alias("n"))


@query("SELECT item_id, 'x = ' || item_id || chr(10) || 'y' AS source, 'none' AS outputs, true AS cleared, 'a' AS first, 4 AS nbformat FROM benchmark")
def notebook_edit(spark, sf_dir):
    books = table(spark, sf_dir, "benchmark").select("item_id", F.lit('{"cells":[{"source":["a"],"outputs":[1],"execution_count":3},{"source":["b"],"outputs":[{"t":1}],"execution_count":7}],"nbformat":4}').alias("b"))
    edited = books.withColumn("v", F.try_parse_json(jsonx.with_cell("b", F.lit(1), _j("x = ", F.col("item_id"), "\ny"))))
    get = lambda p, t: F.try_variant_get("v", p, t)
    return edited.select("item_id", F.array_join(get("$.cells[1].source", "array<string>"), "").alias("source"), F.coalesce(get("$.cells[1].outputs[0]", "string"), F.lit("none")).alias("outputs"), get("$.cells[1].execution_count", "long").isNull().alias("cleared"), get("$.cells[0].source[0]", "string").alias("first"), get("$.nbformat", "int").alias("nbformat"))


@query("SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'B-X' ELSE 'I-X' END || CASE WHEN event_id % 2 = 0 THEN '' ELSE '|I-X' END AS names FROM events")
def decoded_labels(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.array((F.col("user_id") % 3).cast("int"), F.lit(1), F.lit(2)).alias("ids"), F.array(F.lit(0), F.lit(tags.IGNORED), F.when(F.col("event_id") % 2 == 0, tags.IGNORED).otherwise(2)).alias("gold"))
    names = F.create_map(*(F.lit(x) for p in enumerate(("O", "B-X", "I-X")) for x in p))
    return events.select("event_id", F.array_join(tags.decoded(F.col("ids"), F.col("gold"), names), "|").alias("names"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'x' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'N/A' END AS alias FROM events")
def default_missing(spark, sf_dir):
    raw = _of("event_id", ['{"alias":"x"}', '{"alias":""}', '{"alias":null}', '{"other":1}'])
    return table(spark, sf_dir, "events").select("event_id", jsonx.default_if_missing(F.try_parse_json(raw), "$.alias", "N/A").alias("alias"))


@query("SELECT doc_id, md5(left(text, 500)) AS raw FROM documents")
def raw_payload(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.truncated(F.col("text"))).alias("raw"))


@query(f"""SELECT doc_id, md5({_strip("CASE doc_id % 4 WHEN 0 THEN text || chr(32) WHEN 1 THEN text WHEN 2 THEN text ELSE 'no sign: ' || text END")}) AS answer,
md5('Merge the chunks of this article into one clean text.' || chr(10) || chr(10) || 'TEXT TO CLEAN:' || chr(10) || replace(text, chr(10), ' ')) AS prompt FROM documents""")
def model_answers(spark, sf_dir):
    t = F.col("text")
    raw = _of("doc_id", [_j("q", jobs.MARKER, " no ", jobs.MARKER, t, " "), _j("TEXT TO CLEAN: q", jobs.HEADER, t), _j("p TEXT TO CLEAN:\nold TEXT TO CLEAN:\n", t), _j("no sign: ", t)])
    prompt = _j(jobs.CLEAN_PROMPT, text.join_chunks(F.split("text", "\n")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.answer(raw, jobs.MARKER, jobs.HEADER)).alias("answer"), F.md5(prompt).alias("prompt"))


@query("SELECT n_nationkey, 'Bearer ' || to_base64(encode('{\"secret_key\": \"k ' || n_name || '\"}')) AS header FROM nation")
def auth_header(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", text.credentials(_j("k ", F.col("n_name"))).alias("header"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '—' ELSE printf('%.1f', user_id / 3.0::DOUBLE) || 's' END AS took FROM events")
def shown_numbers(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.shown(F.when(F.col("event_id") % 4 != 0, F.col("user_id") / F.lit(3.0)), 1, "s").alias("took"))


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events")
def stamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.stamp(F.col("ts")).alias("stamp"))


@query(f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN {_K} WHEN 1 THEN 5 WHEN 2 THEN {_K} END AS k FROM events")
def json_document(spark, sf_dir):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    raw = _of("event_id", [F.col("props"), _j('{"k": ', k, ', "k": 5}'), _j('{"n": NaN, "k": ', k, "}"), _j('so {"k": ', k, "}")])
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(jsonx.parsed(raw), "$.k", "long").alias("k"))


@query("""SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 5) THEN 'ok' ELSE 'error' END AS status, CASE event_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 5 THEN 0 END AS n,
CASE event_id % 6 WHEN 2 THEN 'unexpected shape' WHEN 3 THEN 'unexpected shape' WHEN 4 THEN 'JSON parse failed' END AS error, CASE WHEN event_id % 6 = 4 THEN left('no ' || repeat(event_type, 200), 500) END AS raw FROM events""")
def extraction_status(spark, sf_dir):
    raw = _of("event_id", ['{"bacteria_relationships":[1,{"a":2}]}', '{"other":[1]}', '{"bacteria_relationships":null}', "[1]", _j("no ", F.repeat("event_type", 200)), 'so {"bacteria_relationships":[]}'])
    return table(spark, sf_dir, "events").select("event_id", jsonx.extraction(raw).alias("e")).select("event_id", "e.status", F.col("e.n").alias("n"), "e.error", "e.raw")


@query("SELECT event_id, CASE event_id % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE event_type END AS answer FROM events")
def provider_texts(spark, sf_dir):
    t = F.col("event_type")
    raw = _of("event_id", [_j('{"content":[{"text":"', t, '"}]}'), _j('{"choices":[{"message":{"content":"', t, '"}}]}'), _j('{"candidates":[{"content":{"parts":[{"text":"', t, '"}]}}]}'), '{"choices":[]}', "gateway timeout"])
    return table(spark, sf_dir, "events").select("event_id", jsonx.provider_text(raw).alias("answer"))


@query(r"""SELECT doc_id, md5(array_to_string(list_transform(string_split(text || ' 😀é', ''), lambda c: CASE WHEN unicode(c) < 128 THEN c WHEN unicode(c) < 65536 THEN '\u' || printf('%04x', unicode(c))
ELSE '\u' || printf('%04x', 55296 + (unicode(c) - 65536) // 1024) || '\u' || printf('%04x', 56320 + (unicode(c) - 65536) % 1024) END), '')) AS escaped FROM documents""")
def ascii_json(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(jsonx.ascii_only(_j(F.col("text"), " 😀é"))).alias("escaped"))


@query("""SELECT event_id, 0 AS pos, event_type AS taxon_name, CASE WHEN event_id % 2 = 0 THEN 'increased' END AS direction, '0.003' AS p_value FROM events
UNION ALL SELECT event_id, 1, 'b', NULL, NULL FROM events WHERE event_id % 3 > 0""")
def relation_rows(spark, sf_dir):
    first = _j('{"taxon_name":"', F.col("event_type"), '"', F.when(F.col("event_id") % 2 == 0, ',"direction":"increased"').otherwise(""), ',"p_value":"0.003"}')
    papers = table(spark, sf_dir, "events").select("event_id", _j('{"relationships":[', first, F.when(F.col("event_id") % 3 > 0, ',{"taxon_name":"b"}').otherwise(""), "]}").alias("j"))
    return extract.relations(papers, "j", "event_id").select("event_id", "pos", "taxon_name", "direction", "p_value")


_TAG = "CASE event_id % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'B-' || event_type ELSE 'I-' || event_type END"


@query(f"SELECT DISTINCT {_TAG} AS tag FROM events")
def tag_set(spark, sf_dir):
    return tags.tag_set(table(spark, sf_dir, "events").select(F.expr(_TAG).alias("tag")))


@query(f"WITH t AS (SELECT event_id, {_TAG} AS tag FROM events) SELECT event_id, tag, CAST(dense_rank() OVER (ORDER BY tag) - 1 AS INTEGER) AS label_id FROM t")
def label_lookup(spark, sf_dir):
    tokens_ = table(spark, sf_dir, "events").select("event_id", F.expr(_TAG).alias("tag"))
    return tags.with_ids(tokens_, tags.label_ids(tokens_))


@query("""SELECT event_id, '-100|' || (user_id % 7) || '|-100|' || (user_id % 5) || CASE WHEN event_id % 2 = 0 THEN '|-100' ELSE '|3' END AS labels FROM events""")
def piece_labels(spark, sf_dir):
    pieces = F.array(F.lit(None).cast("int"), F.lit(0), F.lit(0), F.lit(1), F.when(F.col("event_id") % 2 == 0, 1).otherwise(2), F.lit(None).cast("int"))
    labels = F.array(F.col("user_id") % 7, F.col("user_id") % 5, F.lit(3))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(tags.align_labels(pieces, labels, most=5), "|").alias("labels"))


@query(f"""WITH {_WORDS}, k AS (SELECT file, unnest(range(len(w))) AS k, unnest(w) AS token FROM w)
SELECT file, CAST(k // 2 AS INTEGER) AS sent_id, CAST(k % 2 AS INTEGER) AS pos, token, CASE WHEN k % 2 = 0 THEN 'O' ELSE 'B-X' END AS tag FROM k WHERE k // 2 % 3 <> 1""")
def zipped_files(spark, sf_dir):
    """Two words a line and two tags a line; every third line of words is blank."""
    lines = F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 2).cast("int"))
    both = words(spark, sf_dir).select("file", F.array_join(F.transform(lines, lambda s: F.when(s % 3 == 1, "").otherwise(F.concat_ws("  ", F.get("w", s * 2), F.get("w", s * 2 + 1)))), "\n").alias("a"), F.array_join(F.transform(lines, lambda s: F.lit("O\tB-X")), "\n").alias("b"))
    found = tags.zipped_lines(both.select("file", F.col("a").alias("value")), both.select("file", F.col("b").alias("value")))
    return found.select("file", "sent_id", F.posexplode("pairs").alias("pos", "p")).select("file", "sent_id", "pos", "p.token", "p.tag")


@query("SELECT count(*) FILTER (lang <> 'de') AS processed, count(*) FILTER (lang = 'de') AS failed, sum(n_chars) AS total_chunks, round(sum(n_chars) / count(*) FILTER (lang <> 'de'), 6) AS average FROM documents")
def run_stats(spark, sf_dir):
    found = rollup.run_stats(table(spark, sf_dir, "documents").withColumn("ok", F.col("lang") != "de"), "n_chars", "ok")
    return found.select("processed", "failed", "total_chunks", F.round("average_chunks", 6).alias("average"))


@query("""SELECT 'first' AS what, doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents QUALIFY n < 3
UNION ALL SELECT 'group', conv_id, turn FROM conversations WHERE conv_id = (SELECT conv_id FROM conversations ORDER BY turn, conv_id LIMIT 1)""")
def first_rows(spark, sf_dir):
    head = corpus.first_rows(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 3).withColumn("n", F.row_number().over(Window.orderBy("doc_id")) - 1)
    group = corpus.first_of_group(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return head.select(F.lit("first").alias("what"), F.col("doc_id").alias("id"), F.col("n").cast("long").alias("n")).unionByName(group.select(F.lit("group").alias("what"), F.col("conv_id").alias("id"), F.col("turn").cast("long").alias("n")))


# what Python's generator with seed 42 draws out of 40 rows, as published for its algorithm
#: The places by the number of rows, for tables of up to 500.
_PLACES = ", ".join(f"({n}, {p})" for n in range(1, 501) for p in extract.seeded_places(n))


@query(f"SELECT item_id FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS ord, count(*) OVER () AS rows FROM benchmark) JOIN (VALUES {_PLACES}) p(rows, ord) USING (rows, ord)")
def seeded_sample(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id")
    return corpus.ordinal(items, "item_id").where(F.col("ord").isin(extract.seeded_places(items.count()))).select("item_id")


_SITES = ("gut", "oral_subsite_tongue", "day_12", "followup_x", "day_x", "Gut", "uterine", "other")
_TIMES = ("baseline", "day_12", "followup_x", "day_x", "oral_subsite_tongue", "year_", "month_3")


@query(f"""WITH v AS (SELECT event_id, {list(_SITES)}[event_id % 8 + 1] AS s, {list(_TIMES)}[event_id % 7 + 1] AS t, ['genus', 'strain'][event_id % 2 + 1] AS l, CASE event_id % 5 WHEN 0 THEN 'temporal' WHEN 1 THEN 'dose' WHEN 2 THEN 'dose_response' WHEN 3 THEN 'other' END AS c FROM events)
SELECT event_id, concat_ws('|', CASE WHEN l = 'strain' THEN 'taxonomic_level' END, CASE WHEN c = 'dose' THEN 'change_context' END, CASE WHEN s IN ('day_12', 'followup_x', 'day_x', 'Gut') THEN 'sample_site' END,
CASE WHEN t IN ('day_x', 'oral_subsite_tongue', 'year_') THEN 'temporal_context' END) AS microbe,
concat_ws('|', CASE WHEN event_id % 3 = 1 THEN 'metabolite_class' END, CASE WHEN event_id % 4 = 3 THEN 'direction' END, CASE WHEN event_id % 2 = 1 THEN 'sample_type' END) AS metabolite FROM v""")
def domain_check(spark, sf_dir):
    """The fields of each entry that lie outside their domains."""
    rows = table(spark, sf_dir, "events").select("event_id", _of("event_id", list(_SITES)).alias("sample_site"), _of("event_id", list(_TIMES)).alias("temporal_context"), _of("event_id", ["genus", "strain"]).alias("taxonomic_level"), _of("event_id", ["temporal", "dose", "dose_response", "other", F.lit(None)]).alias("change_context"))
    made = rows.select("event_id", _of("event_id", ["SCFA", "scfa", "bile_acid"]).alias("metabolite_class"), _of("event_id", ["increased", "decreased", "unchanged", "unclear"]).alias("direction"), _of("event_id", ["saliva", "gut"]).alias("sample_type"))
    listed = lambda df, name: extract.violations(df, name).select("event_id", F.array_join("violations", "|").alias("v"))
    return listed(rows, "microbe_relationships").withColumnRenamed("v", "microbe").join(listed(made, "metabolites").withColumnRenamed("v", "metabolite"), "event_id")


@query("""SELECT event_id, event_type || ':' || CASE WHEN event_id % 2 = 0 THEN 'bacteria' ELSE 'fungi' END AS relationships, CASE WHEN event_id % 3 = 0 THEN 'Shannon index' ELSE '' END AS diversity FROM events""")
def migrated_rows(spark, sf_dir):
    entry = lambda name, domain: F.struct(name.alias("taxon_name"), domain.alias("domain"))
    none = F.lit(None).cast("string")
    first = entry(F.col("event_type"), F.when(F.col("event_id") % 2 == 1, "fungi"))
    old = F.when(F.col("event_id") % 3 == 0, F.array(first, entry(F.lit("Shannon index"), none))).otherwise(F.array(first))
    parts = table(spark, sf_dir, "events").select("event_id", extract.promoted(extract.migrated(old)).alias("p"))
    return parts.select("event_id", F.array_join(F.transform("p.relationships", lambda r: F.concat(r["taxon_name"], F.lit(":"), r["domain"])), "|").alias("relationships"), F.array_join(F.transform("p.diversity", lambda r: r["taxon_name"]), "|").alias("diversity"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'high' WHEN event_id % 2 = 0 THEN 'medium' ELSE 'low' END AS confidence FROM events")
def confidences(spark, sf_dir):
    p = F.when(F.col("event_id") % 4 == 0, "0.01").when(F.col("event_id") % 4 == 1, "not specified")
    return table(spark, sf_dir, "events").select("event_id", extract.confidence(p, F.col("event_id") % 2 == 0).alias("confidence"))


@query("""WITH r AS (SELECT user_id, event_type, props, CASE event_id % 3 WHEN 0 THEN 'increased' WHEN 1 THEN 'decreased' END AS d FROM events)
SELECT user_id, event_type, props, count(DISTINCT d) AS n FROM r GROUP BY 1, 2, 3 HAVING count(DISTINCT d) > 1""")
def contradictory(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("paper"), F.col("event_type").alias("taxon_name"), F.col("props").alias("primary_disease"), F.when(F.col("event_id") % 3 == 0, "increased").when(F.col("event_id") % 3 == 1, "decreased").alias("direction"))
    return extract.contradictions(rows, "paper").select(F.col("paper").alias("user_id"), F.col("taxon_name").alias("event_type"), F.col("primary_disease").alias("props"), "n")


def _papers(spark, sf_dir):
    listed = F.when(F.col("event_id") % 2 == 0, '{"taxon_name":"a"},{"taxon_name":"b"}').otherwise('{"taxon_name":"a"}')
    name = F.when(F.col("event_id") % 5 == 0, "bacteria_relationships").otherwise("microbe_relationships")
    return table(spark, sf_dir, "events").select("event_id", _j('{"', name, '":[', listed, '],"extraction_metadata":{"total_microbes_found":', F.col("event_id") % 3, ',"contradictions_found":["c', F.col("event_id") % 7, '"]}}').alias("j"))


@query("SELECT event_id, event_id % 3 AS stated, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS listed FROM events WHERE event_id % 3 <> CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END")
def incomplete(spark, sf_dir):
    return sections.incomplete(_papers(spark, sf_dir), "j", "event_id")


@query("SELECT event_id, 0 AS pos, 'c' || (event_id % 7) AS text FROM events")
def stated_contradictions(spark, sf_dir):
    return sections.contradictions(_papers(spark, sf_dir), "j", "event_id")


_M = "'m' || event_id % 13"


@query(f"""SELECT event_id, 'microbe_relationships' AS section, 0 AS pos, {_M} || CASE WHEN event_id % 2 = 0 THEN '/increased' ELSE '' END || '/bacteria' AS entry FROM events
UNION ALL SELECT event_id, 'microbe_relationships', 1, 'm/fungi' FROM events
UNION ALL SELECT event_id, 'diversity_metrics', 0, 'shannon/' || event_id % 7 FROM events
UNION ALL SELECT event_id, 'metabolites', 0, 'x' || event_id % 5 || '/' || {_M} || '/q' FROM events
UNION ALL SELECT event_id, 'immune_markers', 0, 'il' || event_id % 6 || '/cytokine/' || {_M} FROM events
UNION ALL SELECT event_id, 'virus_associations', 0, 'v' || event_id % 4 || '/0.0' || event_id % 9 FROM events WHERE event_id % 3 = 0
UNION ALL SELECT event_id, 'microbe_interactions', 0, {_M} || '/q' FROM events
UNION ALL SELECT event_id, 'mechanistic_pathways', i, 'p' || i || '/' || CASE i WHEN 0 THEN {_M} || '>o' ELSE '' END FROM events, range(2) r(i)
UNION ALL SELECT event_id, 'contradictions', i, 'c' || event_id % 7 || i FROM events, range(2) r(i)""")
def every_section(spark, sf_dir):
    """The entries of all eight sections of an extraction for each event."""
    m = _j('"m', F.col("event_id") % 13, '"')
    parts = [_j('{"microbe_relationships": [{"taxon_name": ', m, F.when(F.col("event_id") % 2 == 0, ', "direction": "increased"').otherwise(""), '}, {"taxon_name": "m", "domain": "fungi"}]')]
    parts += [_j(', "diversity_metrics": [{"metric_type": "shannon", "value": ', F.col("event_id") % 7, '}], "metabolites": [{"name": "x', F.col("event_id") % 5, '", "produced_by": [', m, ', "q"]}]')]
    parts += [_j(', "immune_markers": [{"name": "il', F.col("event_id") % 6, '", "marker_type": "cytokine", "associated_microbes": [', m, "]}]")]
    parts += [F.when(F.col("event_id") % 3 == 0, _j(', "virus_associations": [{"virus_name": "v', F.col("event_id") % 4, '", "quantitative_data": {"p": "0.0', F.col("event_id") % 9, '"}}]')).otherwise("")]
    parts += [_j(', "microbe_interactions": [{"microbe_1": ', m, ', "microbe_2": "q"}], "mechanistic_pathways": [{"description": "p0", "steps": [{"name": ', m, '}, {"name": "o"}]}, {"description": "p1"}]')]
    parts += [_j(', "extraction_metadata": {"contradictions_found": ["c', F.col("event_id") % 7, '0", "c', F.col("event_id") % 7, '1"]}}')]
    papers = table(spark, sf_dir, "events").select("event_id", F.concat(*parts).alias("j"))
    shown = {
        "microbe_relationships": ("taxon_name", "direction", "domain"),
        "diversity_metrics": ("metric_type", "value"),
        "metabolites": ("name", F.array_join("produced_by", "/")),
        "immune_markers": ("name", "marker_type", F.array_join("associated_microbes", "/")),
        "virus_associations": ("virus_name", F.col("quantitative_data")["p"]),
        "microbe_interactions": ("microbe_1", "microbe_2"),
        "mechanistic_pathways": ("description", F.array_join(F.transform(F.coalesce("steps", F.array()), lambda s: s["name"]), ">")),
    }
    found = sections.contradictions(papers, "j", "event_id").select("event_id", F.lit("contradictions").alias("section"), "pos", F.col("text").alias("entry"))
    for name, fields in shown.items():
        found = found.unionByName(sections.section(papers, "j", "event_id", name).select("event_id", F.lit(name).alias("section"), "pos", F.concat_ws("/", *fields).alias("entry")))
    return found


@query("""SELECT event_id, 0 AS pos, 'a' AS taxon_name, 'bacteria' AS domain FROM events UNION ALL SELECT event_id, 1, 'b', 'bacteria' FROM events WHERE event_id % 2 = 0""")
def section_rows(spark, sf_dir):
    return sections.section(_papers(spark, sf_dir), "j", "event_id", "microbe_relationships").select("event_id", "pos", "taxon_name", "domain")


@query("SELECT doc_id, doc_id % 4 IN (1, 3) OR regexp_matches(text, '(?i)\\b(not|no|without)\\b[^.]{0,40}\\b(associated|association|difference|change)') AS negated FROM documents")
def negations(spark, sf_dir):
    more = _of("doc_id", [" It was associated.", " It was NOT clearly associated.", " It was not. Associated.", " There was no difference."])
    # the text and what is put behind it are judged apart: a denial at the text's end must not reach into the sentence behind it
    return table(spark, sf_dir, "documents").select("doc_id", (extract.negated(F.col("text")) | extract.negated(more)).alias("negated"))


@query(f"SELECT doc_id, md5({_fallback('text')}) AS cleaned FROM documents")
def stream_cleaned(spark, sf_dir):
    source, path = table(spark, sf_dir, "documents").select("doc_id", "text"), scratch(spark, "stream")
    source.where("doc_id % 2 = 0").write.parquet(f"{path}/in")
    stream = streams.cleaned(spark.readStream.schema(source.schema).parquet(f"{path}/in"))
    streams.run_once(stream, f"{path}/out", f"{path}/checkpoint")
    source.where("doc_id % 2 <> 0").write.mode("append").parquet(f"{path}/in")
    streams.run_once(stream, f"{path}/out", f"{path}/checkpoint")  # takes in what is new
    return spark.read.parquet(f"{path}/out").select("doc_id", F.md5("cleaned_text").alias("cleaned"))


@query(f"SELECT CAST(item_id AS VARCHAR) AS article_id, row_number() OVER (ORDER BY item_id) - 1 AS pos, md5({_fallback('text')}) AS cleaned, count(*) OVER () AS processed FROM benchmark")
def clean_job(spark, sf_dir):
    path = scratch(spark, "job")
    files.write_object(table(spark, sf_dir, "benchmark"), "item_id", "text", "item_id", f"{path}/in.json")
    stats = jobs.clean_articles(spark, f"{path}/in.json", f"{path}/out", batches=2, drop_store=True)
    cleaned = files.article_corpus(spark, f"{path}/out/output")
    return cleaned.select("article_id", F.col("pos").cast("long").alias("pos"), F.md5(F.get("chunks", F.lit(0))).alias("cleaned"), F.lit(stats["processed_articles"]).cast("long").alias("processed"))


@query("SELECT item_id, row_number() OVER (ORDER BY r_name, item_id) - 1 AS place FROM benchmark JOIN region ON r_regionkey = item_id % 5")
def sentence_places(spark, sf_dir):
    """Sentences of several files, numbered over all of them, in the order of files, then of sentences."""
    items = table(spark, sf_dir, "benchmark").join(table(spark, sf_dir, "region"), F.col("item_id") % 5 == F.col("r_regionkey"))
    own = items.select("item_id", F.col("r_name").alias("file"), (F.row_number().over(Window.partitionBy("r_name").orderBy("item_id")) - 1).alias("sent_id"))
    return tags.numbered(own).select("item_id", F.col("place").cast("long").alias("place"))


@query(r"""WITH RECURSIVE own AS (SELECT list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents),
word AS (SELECT list_append(w, chr(10)) AS w, unnest(range(1, len(w) + 2)) AS i FROM own WHERE len(w) > 0),
gram AS (SELECT '' AS c, w[i] AS b FROM word UNION ALL SELECT w[i - 1], w[i] FROM word WHERE i > 1 UNION ALL SELECT w[i - 2] || ' ' || w[i - 1], w[i] FROM word WHERE i > 2),
pair AS (SELECT c, b, count(*) AS n FROM gram GROUP BY 1, 2),
known AS (SELECT c FROM pair GROUP BY c ORDER BY sum(n) DESC, c LIMIT 131072),
best AS (SELECT c, b FROM pair WHERE c IN (SELECT c FROM known) QUALIFY row_number() OVER (PARTITION BY c ORDER BY n DESC, b) = 1),
said(item_id, k, a, z, t) AS (
  SELECT item_id, 0, CASE WHEN len(w) > 1 THEN w[-2] END, CASE WHEN len(w) > 0 THEN w[-1] END, CAST([] AS VARCHAR[]) FROM (SELECT item_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM benchmark)
  UNION ALL SELECT item_id, k + 1, z, coalesce(two.b, one.b, none.b), list_append(t, coalesce(two.b, one.b, none.b)) FROM said JOIN best none ON none.c = '' LEFT JOIN best one ON one.c = z LEFT JOIN best two ON two.c = a || ' ' || z WHERE k < 12 AND coalesce(two.b, one.b, none.b) <> chr(10)
)
SELECT item_id, 'large' AS model, array_to_string(arg_max(t, k), ' ') AS raw, NULL AS error FROM said GROUP BY item_id
UNION ALL SELECT item_id, 'small', NULL, 'failed after 1 attempts: over 80 % of 1 MB are in use' FROM benchmark""")
def local_answers(spark, sf_dir):
    """A model of word n-grams, trained by all documents, goes on with each item in the worker itself; once under a bound of
    memory that is always reached."""
    prompts = table(spark, sf_dir, "benchmark").select(F.explode(F.array(F.lit("small"), F.lit("large"))).alias("model"), F.col("item_id").cast("string").alias("paper_id"), F.col("text").alias("prompt"))
    path = scratch(spark, "words")
    generate.train(table(spark, sf_dir, "documents"), scratch(spark, "word-counts")).write.parquet(path)
    sent = spark.sparkContext.broadcast(generate.loaded(spark.read.parquet(path)))
    own = extract.loaded(lambda: lambda prompt: generate.continued(sent.value, prompt, most=12))
    calls = {"small": extract.within_memory(own, 1), "large": extract.within_memory(own, 1 << 30)}
    said = extract.asked(prompts, lambda name, prompt: calls[name](name, prompt), tries=1)
    return said.select(F.col("paper_id").cast("long").alias("item_id"), "model", "raw", "error")


@query(None)
def prompt_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tokens.first_tokens(F.col("text"), 64)).alias("prompt"))
