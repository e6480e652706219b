"""Registered queries over the document operators, each with the SQL that it is checked against.

The tables hold few of the patterns that the cleaning chains act on, so some queries append the same deterministic noise
to the texts on both sides (`noisy`), keyed by doc_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litforge.functions import jsonx, tags, text
from litforge.operators import corpus, extract, rollup, sections

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
NOISE = (" [3].", " [2–5] b", " [1, 4] x", " ..", " aBc endStart e.g. this", "  two  sp , x", " [DOI] [PubMed] [PMC1]", " é@b.c c@d_x.org k.l@f-g.ne7")
LEAD = ("", "", "", "10.1234/x. ", "", "10.123/x. ", "a 10.1234/x. ", "")
MODELS = (("alpha", 0), ("beta", 1), ("gamma", 2))
STATS = r"p ?[<=] ?0\.[0-9]+|[0-9]+%"
_CASE = lambda values: "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(values)) + " END"
_NOISY = f"({_CASE(LEAD)} || text || {_CASE(NOISE)})"
_WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def _sub(pattern: str, to: str):
    return lambda x: f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


_collapse, _tight, _stop = _sub(f"{_WS}+", " "), _sub(f"{_WS}+([.,;:])", r"\1"), _sub(f"([.!?]){_WS}*([a-z])", r"\1 \2")
_cite = lambda x: _sub(rf"\[\p{{Nd}}+(?:,{_WS}*\p{{Nd}}+)*\]", "")(_sub(r"\[\p{Nd}+(?:[-–]\p{Nd}+)?\]", "")(x))
_strip, _camel, _dots = _sub(f"^{_WS}+|{_WS}+$", ""), _sub("([a-z])([A-Z][a-z])", r"\1. \2"), _sub(r"\.{2,}", ".")
_fallback = lambda x: _strip(_stop(_tight(_cite(_collapse(x)))))
_post = lambda x: _strip(_collapse(_dots(_camel(_cite(_stop(_tight(_collapse(x))))))))
_hits = lambda x, p: f"len(regexp_extract_all({x}, '{p}'))"
# the SQL has patterns of its own, so that an error in the library's shows
JUNK = {
    "short": lambda x: f"length({x}) < 30",
    "marks": lambda x: f"{_hits(x, r'\[DOI\]|\[PubMed\]|\[PMC')} >= 3",
    "doi": lambda x: f"regexp_matches({x}, '^10\\.\\p{{Nd}}{{4,}}/')",
    "mail": lambda x: f"{_hits(x, r'[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+')} >= 3",
}
_junk = lambda x: "(" + " OR ".join(f(_strip(x)) for f in JUNK.values()) + ")"
_KINDS = r"""CASE WHEN regexp_matches(chunk, '(?i)copyright|licen[cs]e|all rights reserved') THEN 'copyright_license'
WHEN regexp_matches(chunk, '(?i)\bdoi\b|10\.[0-9]{4,}/|published online|volume [0-9]+') THEN 'publication_metadata'
WHEN regexp_matches(chunk, '(?i)department of|university|[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}') THEN 'author_affiliation'
WHEN regexp_matches(chunk, '(?i)\bclick here\b|\bsign in\b|\bnext page\b|\| .* \|') THEN 'ui_navigation'
WHEN regexp_matches(chunk, '(?i)conflicts? of interest|acknowledge?ments?|supplementary') THEN 'academic_boilerplate' ELSE 'content' END"""
_LINES = "SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS chunk FROM (SELECT doc_id, string_split({}, chr(10)) AS l FROM documents)"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("doc_id") % 8).cast("int"))
    return table(spark, sf_dir, "documents").withColumn("text", F.concat(of(LEAD), "text", of(NOISE)))


def lines(spark, sf_dir, noise=False):
    return corpus.chunks(noisy(spark, sf_dir) if noise else table(spark, sf_dir, "documents"))


@query(f"""WITH c AS ({_LINES.format(_NOISY)}), k AS (SELECT * FROM c WHERE NOT {_junk('chunk')}),
d AS (SELECT doc_id, {_fallback("string_agg(chunk, ' ' ORDER BY pos)")} AS t, count(*) AS n FROM k GROUP BY doc_id)
SELECT lang, count(*) AS docs, sum(n) AS chunks, sum(length(t)) AS chars FROM documents JOIN d USING (doc_id) GROUP BY lang""")
def flagship(spark, sf_dir):
    kept = F.filter(F.split("text", "\n"), lambda c: ~text.is_junk(c))
    once = F.get(F.transform(F.array(kept), lambda k: F.struct(F.size(k).alias("n"), F.length(text.fallback_clean(text.join_chunks(k))).alias("chars"))), F.lit(0))
    docs = noisy(spark, sf_dir).select("lang", once.alias("d"))
    return docs.groupBy("lang").agg(F.count_if(F.col("d.n") > 0).alias("docs"), F.sum("d.n").alias("chunks"), F.sum("d.chars").alias("chars")).where("docs > 0")


@query(f"SELECT doc_id, pos, md5(chunk) AS chunk FROM ({_LINES.format('text')})")
def chunk_explode(spark, sf_dir):
    return lines(spark, sf_dir).withColumn("chunk", F.md5("chunk"))


@query(f"SELECT doc_id, pos, {_junk('chunk')} AS junk FROM ({_LINES.format(_NOISY)})")
def junk_filter(spark, sf_dir):
    return lines(spark, sf_dir, True).select("doc_id", "pos", text.is_junk(F.col("chunk")).alias("junk"))


@query(f"""WITH k AS (SELECT * FROM ({_LINES.format(_NOISY)}) WHERE NOT {_junk('chunk')}),
p AS (SELECT *, lag(chunk) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM k),
m AS (SELECT doc_id, string_agg(CASE WHEN before IS NULL THEN '' WHEN regexp_matches({_sub(f'{_WS}+$', '')('before')}, '[.!?]$') THEN ' ' ELSE '. ' END || chunk, '' ORDER BY pos) AS t FROM p GROUP BY doc_id)
SELECT doc_id, length(coalesce(left(t, 48000), '')) AS n, md5(coalesce(left(t, 48000), '')) AS merged FROM documents LEFT JOIN m USING (doc_id)""")
def merge_chunks(spark, sf_dir):
    merged = noisy(spark, sf_dir).select("doc_id", text.merge_chunks(F.split("text", "\n")).alias("t"))
    return merged.select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("merged"))


@query(f"SELECT doc_id, length({_fallback(_NOISY)}) AS n, md5({_fallback(_NOISY)}) AS cleaned FROM documents")
def clean_fallback(spark, sf_dir):
    t = text.fallback_clean(F.col("text"))
    return noisy(spark, sf_dir).select("doc_id", F.length(t).cast("long").alias("n"), F.md5(t).alias("cleaned"))


@query(f"SELECT doc_id, length({_post(_NOISY)}) AS n, md5({_post(_NOISY)}) AS cleaned FROM documents")
def clean_post(spark, sf_dir):
    t = text.post_process(F.col("text"))
    return noisy(spark, sf_dir).select("doc_id", F.length(t).cast("long").alias("n"), F.md5(t).alias("cleaned"))


@query(f"SELECT doc_id, length({_cite(_NOISY)}) AS n FROM documents")
def citation_strip(spark, sf_dir):
    return noisy(spark, sf_dir).select("doc_id", F.length(text.drop_citations(F.col("text"))).cast("long").alias("n"))


@query(f"""SELECT count(DISTINCT doc_id) AS docs, count(*) AS chunks, count(DISTINCT chunk) AS unique_chunks,
round(count(*) / count(DISTINCT doc_id), 6) AS average_chunks, round(1 - count(DISTINCT chunk) / count(*), 6) AS reduction FROM ({_LINES.format('text')})""")
def corpus_stats(spark, sf_dir):
    found = corpus.statistics(table(spark, sf_dir, "documents"))
    return found.select("docs", "chunks", "unique_chunks", F.round("average_chunks", 6).alias("average_chunks"), F.round("reduction", 6).alias("reduction"))


@query(f"SELECT doc_id, pos, md5(chunk) AS chunk FROM ({_LINES.format('text')}) QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY doc_id, pos) = 1")
def dedup_chunks(spark, sf_dir):
    return corpus.first_of_each(lines(spark, sf_dir), "chunk", ["doc_id", "pos"], "doc_id").select("doc_id", "pos", F.md5("chunk").alias("chunk"))


@query(f"SELECT {_KINDS} AS category, count(*) AS n FROM ({_LINES.format(_NOISY)}) GROUP BY 1")
def chunk_categories(spark, sf_dir):
    return lines(spark, sf_dir, True).groupBy(corpus.category(F.col("chunk")).alias("category")).agg(F.count("*").alias("n"))


_BOILERPLATE = ("copyright_license", "publication_metadata", "author_affiliation", "ui_navigation")


@query(f"""WITH c AS (SELECT doc_id, {_KINDS} AS category FROM ({_LINES.format(_NOISY)}))
SELECT NULL AS category, doc_id, count(*) AS n FROM c WHERE category NOT IN {_BOILERPLATE} GROUP BY doc_id
UNION ALL SELECT category, NULL, count(*) FROM c WHERE category IN {_BOILERPLATE} GROUP BY category""")
def category_removal(spark, sf_dir):
    """What is left of each text, and how many chunks of each category are removed."""
    left, gone = corpus.without_categories(lines(spark, sf_dir, True), _BOILERPLATE)
    none = lambda t: F.lit(None).cast(t)
    kept = left.groupBy("doc_id").agg(F.count("*").alias("n")).select(none("string").alias("category"), "doc_id", "n")
    return kept.unionByName(gone.select("category", none("long").alias("doc_id"), "n"))


@query(f"""WITH t AS (SELECT doc_id, {_hits('text', 'the|and|der|les')} AS a, {_hits(_post('text'), 'the|and|der|les')} AS b FROM documents)
SELECT doc_id, round(CASE WHEN a > 0 THEN b / a ELSE 1.0 END, 9) AS kept FROM t""")
def retention(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(corpus.retention(F.col("text"), text.post_process(F.col("text")), "the|and|der|les"), 9).alias("kept"))


@query(f"SELECT doc_id, md5(regexp_replace(text, '([.!?]){_WS}+', '\\1' || chr(1), 'g')) AS sentences FROM documents")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(text.sentences(F.col("text")), "\x01")).alias("sentences"))


@query("SELECT term, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM documents) WHERE term <> '' GROUP BY term ORDER BY n DESC, term LIMIT 50")
def term_freq_topk(spark, sf_dir):
    terms = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term")).where("term <> ''")
    return terms.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(50)


@query("SELECT conv_id, count(*) AS total, string_agg(coalesce(role, 'N/A'), '|' ORDER BY turn) AS roles, md5(string_agg(coalesce(text, 'N/A'), '|' ORDER BY turn)) AS texts FROM conversations GROUP BY conv_id")
def group_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("N/A")).alias("role"), F.coalesce("text", F.lit("N/A")).alias("text"))
    found = rollup.rollup(rows.withColumn("conv_id", F.col("conv_id").cast("string")), "conv_id", "turn", ["role", "text"])
    return found.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("total").cast("long").alias("total"), F.array_join("role", "|").alias("roles"), F.md5(F.array_join("text", "|")).alias("texts"))


@query("SELECT coalesce(source, 'Unknown') AS source, count(*) AS n, bool_and(length(text) > 0) AS all_text, sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS n_en FROM documents GROUP BY 1")
def source_summary(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.coalesce("source", F.lit("Unknown")).alias("source")).agg(F.count("*").alias("n"), F.bool_and(F.length("text") > 0).alias("all_text"), F.count_if(F.col("lang") == "en").alias("n_en"))


@query("SELECT doc_id, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_anti(spark, sf_dir):
    return rollup.pending(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ord FROM documents QUALIFY ord NOT IN (508, 554, 638, 979, 1025, 1597, 1776, 1946)")
def positional_exclude(spark, sf_dir):
    return corpus.without_places(corpus.ordinal(table(spark, sf_dir, "documents").select("doc_id"), "doc_id"), (508, 554, 638, 979, 1025, 1597, 1776, 1946))


@query("""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ord, count(*) OVER () AS n FROM documents)
SELECT doc_id, ord, CASE WHEN ord < floor(n * 0.7::DOUBLE) THEN 'train' WHEN ord < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM o""")
def positional_split(spark, sf_dir):
    return corpus.split_by_place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("SELECT event_type AS label, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS id FROM (SELECT DISTINCT event_type FROM events)")
def label_index(spark, sf_dir):
    return tags.label_ids(table(spark, sf_dir, "events"), "event_type")


@query("""WITH p AS (SELECT l.quality AS gold, CAST(NOT regexp_matches(text, '!!| \\| ') AS INTEGER) AS pred FROM documents JOIN labels l USING (doc_id)),
n AS (SELECT gold AS label, sum(CASE WHEN gold = pred THEN 1 ELSE 0 END) AS tp, count(*) AS n_gold, (SELECT count(*) FROM p q WHERE q.pred = p.gold) AS n_pred FROM p GROUP BY gold)
SELECT label, tp, n_gold, n_pred, round(tp / n_pred, 9) AS "precision", round(tp / n_gold, 9) AS recall FROM n""")
def label_metrics(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    both = docs.select("doc_id", (~F.col("text").rlike(r"!!| \| ")).cast("int").alias("pred")).join(labels, "doc_id")
    sides = both.groupBy("quality", "pred").agg(F.count("*").alias("n"))  # four rows at most
    each = sides.select(F.explode(F.array(F.struct(F.col("quality").alias("label"), F.col("n").alias("g"), F.lit(0).alias("p"), F.when(F.col("quality") == F.col("pred"), F.col("n")).otherwise(0).alias("t")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("g"), F.col("n").alias("p"), F.lit(0).alias("t")))).alias("e")).select("e.*")
    return each.groupBy("label").agg(F.sum("t").alias("tp"), F.sum("g").alias("n_gold"), F.sum("p").alias("n_pred")).select("label", "tp", "n_gold", "n_pred", F.round(F.col("tp") / F.nullif("n_pred", F.lit(0)), 9).alias("precision"), F.round(F.col("tp") / F.nullif("n_gold", F.lit(0)), 9).alias("recall"))


_BIO = "CASE WHEN event_id % 3 = 0 THEN 'O' WHEN event_id % 3 = 1 THEN 'B-' || event_type ELSE 'I-' || event_type END"


@query(f"""WITH t AS (SELECT user_id, event_id, {_BIO} AS tag FROM events),
b AS (SELECT *, lag(tag) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM t),
s AS (SELECT *, substr(tag, 3) AS kind, sum(CASE WHEN tag LIKE 'B-%' OR (tag LIKE 'I-%' AND (before IS NULL OR before = 'O' OR substr(before, 3) <> substr(tag, 3))) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM b)
SELECT user_id, kind AS type, min(event_id) AS start, max(event_id) AS "end" FROM s WHERE tag <> 'O' GROUP BY user_id, run, kind""")
def bio_spans(spark, sf_dir):
    tokens = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(_BIO).alias("tag"))
    return tags.bio_spans(tokens, ["user_id"], "event_id", "tag")


@query("""WITH r AS (SELECT m.model, item_id, length(text) AS n, (item_id + m.k) % 4 = 0 AS failed, round((item_id % 5) / 2.0, 1) AS s FROM benchmark, (VALUES ('alpha', 0), ('beta', 1), ('gamma', 2)) m(model, k))
SELECT model, round(avg(CASE WHEN NOT failed THEN n END), 6) AS mean_n, round(avg(CASE WHEN s <> 0 THEN s END), 6) AS mean_s, count(CASE WHEN failed THEN 1 END) AS errors FROM r GROUP BY model""")
def model_matrix(spark, sf_dir):
    models = spark.createDataFrame(MODELS, "model string, k int")
    cells = table(spark, sf_dir, "benchmark").crossJoin(F.broadcast(models))  # a row for each of the few registered models
    failed = (F.col("item_id") + F.col("k")) % 4 == 0
    results = cells.select("model", F.length("text").alias("n"), F.when(failed, "error").alias("error"), F.round((F.col("item_id") % 5) / 2.0, 1).alias("elapsed_s"))
    return rollup.model_summary(results).select("model", F.round("mean_n", 6).alias("mean_n"), F.round("mean_s", 6).alias("mean_s"), "errors")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


#: Answers around the JSON of an event, and the number that is read from each (null: none).
ANSWERS = (
    ("Here:\n```json\n{p}\n``` done", "k"),
    ("so {p} and {{x", "k"),
    ("{p}", "k"),
    ("{{broken", None),
    ("see {{x}} ```json prefix {p} ```", "k"),  # braces are looked for in the fence only
    ('{p} ```json {{bad ```', None),
    ("```\nno JSON\n``` {p}", None),
    ('{{"k": -1, "k": 7}}', "7"),  # the last of equal keys
    ('{{"n": NaN, "k": 8, "i": [-Infinity]}}', "8"),
    ("```{p}``` ```json\n{{\"k\": -5}}```", "k"),  # the first fence
    ('text {{"s": "}}", "k": 3}} {p}', None),  # braces in strings count, and only the first block is tried
    ('{p} {{"k": -5}}', "k"),
)
_K = "CAST(json_extract(props, '$.k') AS BIGINT)"


@query(f"SELECT event_id, CASE event_id % {len(ANSWERS)} {' '.join(f'WHEN {i} THEN {_K if k == "k" else k or "NULL"}' for i, (_, k) in enumerate(ANSWERS))} END AS k FROM events")
def tolerant_json(spark, sf_dir):
    found = table(spark, sf_dir, "events").withColumn("raw", answers("props"))
    return found.select("event_id", F.try_variant_get(jsonx.tolerant(F.col("raw")), "$.k", "long").alias("k"))


def answers(json_col: str):
    """An answer around each row's JSON, by event_id."""
    raw = F.lit(None).cast("string")
    for i, (form, _) in enumerate(ANSWERS):
        parts = [F.lit(p.replace("{{", "{").replace("}}", "}")) for p in form.split("{p}")]
        whole = parts[0] if len(parts) == 1 else F.concat(parts[0], F.col(json_col), parts[1])
        raw = F.when(F.col("event_id") % len(ANSWERS) == i, whole).otherwise(raw)
    return raw


@query(r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS body FROM pages""")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(corpus.plain_html(F.col("html"))).alias("body"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(q.e, v.embedding::DOUBLE[]), 6) AS similarity FROM q, embeddings v WHERE vec_id <> query_id)
SELECT query_id, vec_id, similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) <= 10""")
def nearest_k(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return extract.nearest(v.where("vec_id % 20 = 0"), v, 10).drop("r")


@query("SELECT doc_id, md5('Extract relations as JSON.' || chr(10) || left(text, 6000) || chr(10) || 'Answer:') AS prompt FROM documents")
def prompt_build(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.prompt("Extract relations as JSON.\n", text.truncated(F.col("text"), text.MAX_PROMPT), "\nAnswer:")).alias("prompt"))


_DIRECTION = "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'decreased' ELSE 'increased' END"
_LEVEL = "CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'genus' ELSE 'species' END"


@query(f"""WITH r AS (SELECT user_id, event_type, props, {_DIRECTION} AS direction, {_LEVEL} AS level FROM events)
SELECT user_id, (SELECT count(*) FROM (SELECT DISTINCT event_type, props, direction, level FROM r b WHERE b.user_id = a.user_id AND direction IS NOT NULL)) AS by_level,
(SELECT count(*) FROM (SELECT DISTINCT event_type, props, direction FROM r b WHERE b.user_id = a.user_id AND direction IS NOT NULL)) AS plain
FROM (SELECT DISTINCT user_id FROM r WHERE direction IS NOT NULL) a""")
def relation_uniqueness(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("paper"), F.col("event_type").alias("taxon_name"), F.col("props").alias("primary_disease"), F.expr(_DIRECTION).alias("direction"), F.expr(_LEVEL).alias("taxonomic_level"))
    count = lambda rows, name: rows.groupBy(F.col("paper").alias("user_id")).agg(F.count("*").alias(name))
    return count(extract.unique_relations(rows, "paper"), "by_level").join(count(extract.unique_relations(rows, "paper", with_level=False), "plain"), "user_id")


@query("SELECT event_type AS src, 'k' || CAST(json_extract(props, '$.k') AS BIGINT) AS dst, count(*) AS weight FROM events GROUP BY 1, 2")
def graph_edges(spark, sf_dir):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("taxon_name"), F.concat(F.lit("k"), k).alias("primary_disease"), F.lit("seen").alias("direction"))
    return extract.edges(rows).groupBy("src", "dst").agg(F.count("*").alias("weight"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_events(spark, sf_dir):
    """Not one of the reference's operators: the batch form of the windowed stream."""
    from litforge.streaming.events import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events")).select(F.col("window.start").alias("start"), "event_type", "n")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def group_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


LONG = {"the": "THE", "und": "UND", "les": "LES"}
STOP = ["a", "in", "of", "der", "die", "la", "el"]


@query(f"""SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, ' '), lambda w: CASE {' '.join(f"WHEN w = '{k}' THEN '{v}'" for k, v in LONG.items())} ELSE w END), lambda w: NOT list_contains({STOP}, lower(w))), ' ')) AS t FROM documents""")
def expand_and_stop(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(corpus.without_words(corpus.expand(F.col("text"), LONG), STOP)).alias("t"))


@query("SELECT doc_id, md5(array_to_string(regexp_extract_all(text, '[A-Z][a-z]+ [a-z]{3,}'), '|')) AS named FROM documents")
def entity_hits(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(corpus.named(F.col("text")), "|")).alias("named"))


@query(f"SELECT doc_id, {_hits('text', STATS)} = {_hits(_post('text'), STATS)} AS stats_kept FROM documents")
def statistics_kept(spark, sf_dir):
    n = lambda c: F.regexp_count(c, F.lit(STATS))
    return table(spark, sf_dir, "documents").select("doc_id", (n(F.col("text")) == n(text.post_process(F.col("text")))).alias("stats_kept"))


@query(f"""SELECT {_KINDS} AS category, count(*) AS n
FROM ({_LINES.format(_NOISY)}) WHERE {_junk('chunk')} GROUP BY 1""")
def lost_chunks(spark, sf_dir):
    before = lines(spark, sf_dir, True)
    gone = corpus.lost(before, before.where(~text.is_junk(F.col("chunk"))), ["doc_id", "pos"])
    return gone.groupBy(corpus.category(F.col("chunk")).alias("category")).agg(F.count("*").alias("n"))


@query("""SELECT b.item_id, m.model, coalesce(l.n, 0) AS n FROM benchmark b CROSS JOIN (VALUES ('alpha'), ('beta'), ('gamma')) m(model)
LEFT JOIN (SELECT item_id, 'alpha' AS model, length(text) AS n FROM benchmark WHERE item_id % 3 <> 0) l ON l.item_id = b.item_id AND l.model = m.model""")
def left_lookup(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    cells = items.select("item_id", F.explode(F.array(*(F.lit(m) for m, _ in MODELS))).alias("model"))
    found = items.where("item_id % 3 <> 0").select("item_id", F.lit("alpha").alias("model"), F.length("text").cast("long").alias("n"))
    return cells.join(found, ["item_id", "model"], "left").select("item_id", "model", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS best FROM embeddings")
def argmax_class(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", tags.argmax(F.col("embedding")).alias("best"))


@query("""WITH n AS (SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS r, q.label = v.label AS same
FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id), f AS (SELECT query_id, min(CASE WHEN same THEN r END) AS r FROM n GROUP BY query_id)
SELECT round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 6) AS at_1, round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0.0 END), 6) AS at_10 FROM f""")
def accuracy_at_k(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    near = extract.nearest(v.where("vec_id % 20 = 0"), v, 10)
    labels = lambda i, c: v.select(F.col("vec_id").alias(i), F.col("label").alias(c))
    of = near.join(labels("vec_id", "label"), "vec_id").join(labels("query_id", "gold"), "query_id")
    first = of.groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("gold"), F.col("r"))).alias("r"))
    return first.agg(F.round(sections.accuracy_at(F.col("r"), 1), 6).alias("at_1"), F.round(sections.accuracy_at(F.col("r"), 10), 6).alias("at_10"))


@query(f"""WITH l AS (SELECT doc_id, unnest(range(len(x))) AS line, unnest(x) AS raw FROM (SELECT doc_id, string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10)) AS x FROM documents)),
s AS (SELECT *, {_strip('raw')} AS s, sum(CASE WHEN {_strip('raw')} = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS block FROM l),
f AS (SELECT *, string_split_regex(s, '{_WS}+') AS f FROM s WHERE s <> '' AND NOT starts_with(s, '#'))
SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS sent_id, row_number() OVER (PARTITION BY doc_id, block ORDER BY line) - 1 AS pos, f[1] AS token, f[2] AS tag FROM f WHERE len(f) >= 2""")
def conll_tokens(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("value"))
    return tags.conll(texts).withColumnRenamed("file", "doc_id")


@query(f"""WITH w AS (SELECT item_id, unnest(range(len(x))) AS i, unnest(x) AS token FROM (SELECT item_id, string_split_regex(text, '{_WS}') AS x FROM benchmark)),
e AS (SELECT *, sum(length(token) + 1) OVER (PARTITION BY item_id ORDER BY i) - 1 AS hi FROM w),
s AS (SELECT *, CASE WHEN hi - length(token) < 20 AND hi > 3 THEN 'X' WHEN hi - length(token) < 60 AND hi > 40 THEN 'Y' END AS kind FROM e WHERE token <> ''),
b AS (SELECT *, lag(kind) OVER (PARTITION BY item_id ORDER BY i) AS before FROM s)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS pos, token, CASE WHEN kind IS NULL THEN 'O' WHEN kind = before THEN 'I-' || kind ELSE 'B-' || kind END AS tag FROM b""")
def span_tags(spark, sf_dir):
    spans = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(k).alias("label")) for a, b, k in ((3, 20, "X"), (40, 60, "Y"))))
    return tags.span_bio(table(spark, sf_dir, "benchmark").withColumn("spans", spans), "item_id", "text", "spans")


@query("""SELECT event_type AS microbe, 'm' || (user_id % 7) AS metabolite, 'o' || (event_id % 3) AS outcome, count(*) AS n FROM events GROUP BY 1, 2, 3""")
def section_chains(spark, sf_dir):
    by = F.concat(F.when(F.col("event_id") % 2 == 0, '"nothing else",').otherwise(""), F.lit('"'), "event_type", F.lit('"'))
    parts = ('{"microbe_relationships":[{"taxon_name":"', F.col("event_type"), '"}],"metabolites":[{"name":"m', F.col("user_id") % 7, '","associated_outcome":"o', F.col("event_id") % 3, '","produced_by":[', by, "]}]}")
    papers = table(spark, sf_dir, "events").select("event_id", F.concat(*(F.lit(p).cast("string") for p in parts)).alias("j"))
    made = sections.chains(*(sections.section(papers, "j", "event_id", s) for s in ("microbe_relationships", "metabolites")), "event_id")
    return made.groupBy("microbe", "metabolite", "outcome").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT DISTINCT 'u' || user_id AS src, event_type || CAST(json_extract(props, '$.k') AS BIGINT) AS dst FROM events)
SELECT node, sum(o) AS n_out, sum(i) AS n_in FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY node""")
def graph_degrees(spark, sf_dir):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    edges = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("src"), F.concat("event_type", k).alias("dst")).distinct()
    return sections.degrees(edges)


_GOLD = "CASE WHEN event_id % 3 = 0 THEN 'O' ELSE 'B-' || event_type END"
_GUESS = "CASE WHEN event_id % 5 = 0 THEN 'O' WHEN event_id % 7 = 0 THEN 'B-view' ELSE 'B-' || event_type END"


@query(f"""WITH g AS (SELECT event_id, substr({_GOLD}, 3) AS type FROM events WHERE {_GOLD} <> 'O'), p AS (SELECT event_id, substr({_GUESS}, 3) AS type FROM events WHERE {_GUESS} <> 'O'),
n AS (SELECT type, count(g.event_id) AS gold, count(p.event_id) AS pred, count(CASE WHEN g.event_id = p.event_id THEN 1 END) AS tp FROM g FULL JOIN p USING (event_id, type) GROUP BY type),
s AS (SELECT *, CASE WHEN pred > 0 THEN tp / pred ELSE 0 END AS a, CASE WHEN gold > 0 THEN tp / gold ELSE 0 END AS b FROM n),
f AS (SELECT *, CASE WHEN a + b > 0 THEN 2 * a * b / (a + b) ELSE 0 END AS c FROM s),
r AS (SELECT type, a, b, c, gold FROM f UNION ALL SELECT 'micro avg', sum(tp) / sum(pred), sum(tp) / sum(gold), 2 * sum(tp) / (sum(pred) + sum(gold)), sum(gold) FROM f
UNION ALL SELECT 'macro avg', avg(a), avg(b), avg(c), sum(gold) FROM f UNION ALL SELECT 'weighted avg', sum(a * gold) / sum(gold), sum(b * gold) / sum(gold), sum(c * gold) / sum(gold), sum(gold) FROM f)
SELECT type, round(a, 6) AS "precision", round(b, 6) AS recall, round(c, 6) AS f1, CAST(gold AS BIGINT) AS support FROM r""")
def class_report(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("one", F.col("event_id"))
    spans = lambda e: tags.bio_spans(events.withColumn("tag", F.expr(e)), ["one"], "event_id", "tag")
    found = tags.report(tags.span_scores(spans(_GOLD), spans(_GUESS), ["one"]))
    return found.select("type", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


_SEEN = " see PMC12345, doi:10.1234/ab-c (PMID: 77)"


@query(f"SELECT doc_id, md5(regexp_replace(text || '{_SEEN}', '(?i)pmc[0-9]{{4,}}|pmid:? ?[0-9]+|(?:doi:? ?)?10\\.[0-9]{{4,}}/[^ \\t\\n\\])}},;]+', '', 'g')) AS t FROM documents")
def strip_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.drop_ids(F.concat("text", F.lit(_SEEN)))).alias("t"))


_SCANNED = " bro-\nken ﬁne \u00adﬂow"


@query(f"""WITH j AS (SELECT doc_id, regexp_replace(text || '{_SCANNED}', '([a-z])-\n([a-z])', '\\1\\2', 'g') AS t FROM documents)
SELECT doc_id, md5(regexp_replace(replace(replace(t, 'ﬁ', 'fi'), 'ﬂ', 'fl'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f\\x{{ad}}]', '', 'g')) AS t FROM j""")
def strip_scan_marks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.drop_scan_marks(F.concat("text", F.lit(_SCANNED)))).alias("t"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_repair(spark, sf_dir):
    p, kind = F.col("props"), F.col("event_id") % 4
    cut = F.expr("substring(props, 1, length(props) - 1)")
    broken = F.when(kind == 0, p).when(kind == 1, F.concat(cut, F.lit(", }"))).when(kind == 2, F.replace(p, F.lit('"'), F.lit("'"))).otherwise(cut)
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(jsonx.repaired(broken), "$.k", "long").alias("k"))
