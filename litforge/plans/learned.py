"""Registered queries over operators that learn from the tables: taggers, sentence bounds, abbreviations, word corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from litforge.functions import repair, tags
from litforge.operators import corrections, entities, language, losses, pages, tagger
from litforge.plans.forms import _j, _of, scratch
from litforge.plans.queries import query, table


def _ruled(tokens):
    """Tags by rule: mail addresses, numbers, and capitalised words with the short word that follows."""
    kind = lambda c: F.when(c.contains("@"), "MAIL").when(c.rlike(r"^[0-9][0-9.,:%-]*$"), "NUM").when(c.rlike(r"^\p{Lu}\p{Ll}+"), "NAME").otherwise("O")
    before = lambda i: F.when(i > 0, kind(F.get(tokens, F.greatest(i - 1, F.lit(0))))).otherwise("O")
    follows = lambda c, i: (before(i) == "NAME") & c.rlike(r"^\p{Ll}{1,3}$")
    return F.transform(tokens, lambda c, i: F.when(follows(c, i), "I-NAME").when(kind(c) == "O", "O").otherwise(F.concat(F.lit("B-"), kind(c))))


@query(None)
def tagger_scores(spark, sf_dir):
    """A tagger, fitted on 5,000 sentences of the texts whose id does not hash to 2 of 4, by exact spans: on all sentences of
    these and of the texts held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), F.posexplode(F.split("text", r"(?<=[.!?])\s+|\n")).alias("sent", "s"))
    docs = docs.select("doc_id", "held_out", "sent", F.filter(F.split("s", r"\s+"), lambda t: t != "").alias("tokens"))
    docs = docs.withColumn("gold", _ruled(F.col("tokens")))
    model = tagger.train(docs.where(~F.col("held_out")), "tokens", "gold", scratch(spark, "tagger"), bits=14, steps=16, sentences=5000)
    model = tagger.load(spark, _stored(spark, model))
    both = tagger.tagged(docs.select("held_out", "tokens", "gold"), "tokens", model)  # once: a sentence's spans are told in its row
    return tags.list_scores(both, "gold", "tags", ["held_out"])


def _kept(spark, df, name: str):
    """A table that is worked out once and whose size Spark knows."""
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _stored(spark, model) -> str:
    path = scratch(spark, "tagger-model")
    tagger.save(spark, model, path)
    return path


#: What is put behind texts by id, so that they define and use short forms.
_FORMS = (" We use weighted wavelet matrices (WWM) here. WWM is", " the Greatly Narrowed Path (GNP) and GNP", " no such form (XYZ) here", " WWM and GNP alone", " a weighty Wide Meadow (WWM) . WWM", " plain")
_TEXTS = f"(SELECT doc_id, text || {list(_FORMS)}[doc_id % {len(_FORMS)} + 1] AS text FROM documents)"


def _with_forms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", _j(F.col("text"), _of("doc_id", list(_FORMS))).alias("text"))


@query(rf"""WITH hit AS (SELECT doc_id, generate_subscripts(h, 1) AS place, unnest(h) AS h FROM (SELECT doc_id, regexp_extract_all(text, '(?:[^\s()]+\s+){{1,20}}\([\p{{L}}\p{{N}}][\p{{L}}\p{{N}}-]{{1,9}}\)') AS h FROM {_TEXTS})),
form AS (SELECT doc_id, place, trim(regexp_replace(h, '\([^()]*\)$', '')) AS words, regexp_extract(h, '\(([^()]*)\)$', 1) AS short FROM hit),
word AS (SELECT *, string_split_regex(words, '\s+') AS w, lower(regexp_replace(short, '-', '', 'g')) AS s FROM form),
start AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM word),
fit AS (SELECT *, array_to_string(w[i:], ' ') AS rest, lower(array_to_string(w[i:], ' ')) AS low FROM start),
walked AS (SELECT *, list_reduce(list_prepend(1, list_transform(string_split(s, ''), lambda c: ascii(c))), lambda p, c: CASE WHEN p = 0 OR instr(low[p:], chr(CAST(c AS INTEGER))) = 0 THEN 0 ELSE p + instr(low[p:], chr(CAST(c AS INTEGER))) END) AS p FROM fit WHERE low[1] = s[1]),
best AS (SELECT * FROM walked WHERE p > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, place ORDER BY i DESC) = 1)
SELECT short, lower(rest) AS long, count(*) AS n FROM best WHERE length(rest) > length(short) AND len(w) - i + 1 <= least(length(s) + 5, 2 * length(s)) AND regexp_matches(short, '\p{{L}}') GROUP BY 1, 2""")
def short_forms(spark, sf_dir):
    """The short forms that texts define, with how often each long form is given."""
    return language.definitions(_with_forms(spark, sf_dir)).groupBy("short", F.lower("long").alias("long")).agg(F.count("*").alias("n"))


_SHORT_OF = "CASE doc_id % 6 WHEN 0 THEN 'weighted wavelet matrices' WHEN 4 THEN 'weighty wide meadow' WHEN 3 THEN 'weighted wavelet matrices' END"


@query(f"""SELECT doc_id, md5(array_to_string(list_transform(string_split(text, ' '), lambda w: CASE WHEN w = 'WWM' THEN coalesce({_SHORT_OF}, w) WHEN w = 'GNP' AND doc_id % 6 IN (1, 3) THEN 'greatly narrowed path' ELSE w END), ' ')) AS expanded FROM {_TEXTS}""")
def short_forms_expanded(spark, sf_dir):
    """Texts with short forms written out, by their own definitions, else by the corpus's."""
    docs = _with_forms(spark, sf_dir)
    found = _kept(spark, language.definitions(docs), "definitions")
    known = _kept(spark, language.dictionary(found, share=0.5), "dictionary")
    return language.expanded(docs, found, known).select("doc_id", F.md5("expanded").alias("expanded"))


_STOPS = (" as dr. Green and dr. Brown said.", " e.g. this one.", " It ends. And dr. Grey left!", " Is it so? Yes.")
_STOPPED = f"(SELECT doc_id, text || {list(_STOPS)}[doc_id % {len(_STOPS)} + 1] AS text FROM documents)"


def _with_stops(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", _j(F.col("text"), _of("doc_id", list(_STOPS))).alias("text"))


_ABBREVIATIONS = rf"""word AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS w, len(w) AS size FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM {_STOPPED})),
kind AS (SELECT lower(regexp_replace(w, '\.$', '')) AS kind, count(*) AS n, count(*) FILTER (w LIKE '%.') AS k FROM word WHERE regexp_matches(w, '\p{{L}}') GROUP BY 1),
rated AS (SELECT *, length(replace(kind, '.', '')) AS len, sum(k) OVER () / sum(n) OVER () AS p FROM kind),
score AS (SELECT kind, round(2 * (k * ln(0.99) + (n - k) * ln(0.01) - k * ln(p) - (n - k) * ln(1 - p)) * exp(-len) * (1 + length(kind) - len) * pow(len::DOUBLE, -(n - k)), 6) AS score FROM rated WHERE k > 0 AND len > 0),
known AS (SELECT * FROM score WHERE score >= 0.3)"""


@query(f"WITH {_ABBREVIATIONS} SELECT * FROM known")
def stop_abbreviations(spark, sf_dir):
    """Words that the texts show to be abbreviations."""
    return language.abbreviations(_with_stops(spark, sf_dir))


@query(rf"""WITH {_ABBREVIATIONS},
flag AS (SELECT *, i = size - 1 OR (regexp_matches(w, '[.!?]["''”’)\]]*$') AND NOT (w LIKE '%.' AND lower(regexp_replace(w, '\.$', '')) IN (SELECT kind FROM known))) AS fin FROM word),
run AS (SELECT *, coalesce(sum(fin::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM flag),
sentence AS (SELECT doc_id, s, string_agg(w, ' ' ORDER BY i) AS t FROM run GROUP BY 1, 2)
SELECT doc_id, count(*) AS n, md5(string_agg(t, '|' ORDER BY s)) AS sentences FROM sentence GROUP BY 1""")
def learned_sentences(spark, sf_dir):
    """Texts cut into sentences, but not behind abbreviations."""
    docs = _with_stops(spark, sf_dir)
    cut = language.sentences(docs, language.abbreviations(docs))
    return cut.select("doc_id", F.size("sentences").cast("long").alias("n"), F.md5(F.array_join("sentences", "|")).alias("sentences"))


_WORD = r"[\p{L}\p{N}]+(?:[-''’][\p{L}\p{N}]+)*"
#: Terms of 1 to 4 words, the first of each benchmark item.
_TERMS = f"term AS (SELECT item_id AS i, array_to_string(regexp_extract_all(lower(text), '{_WORD}')[1 : item_id % 4 + 1], ' ') AS t, item_id % 4 + 1 AS n FROM benchmark)"


@query(f"""WITH RECURSIVE {_TERMS},
word AS (SELECT doc_id, unnest(range(len(w))) AS i, w FROM (SELECT doc_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM documents)),
here AS (SELECT doc_id, word.i, max(n) AS n FROM word JOIN (SELECT DISTINCT n FROM term) s ON word.i + s.n <= len(w) WHERE array_to_string(w[word.i + 1 : word.i + s.n], ' ') IN (SELECT t FROM term) GROUP BY 1, 2),
taken(doc_id, i, n) AS (
  SELECT doc_id, min(i), arg_min(n, i) FROM here GROUP BY doc_id
  UNION ALL SELECT t.doc_id, x.i, x.n FROM taken t, LATERAL (SELECT min(h.i) AS i, arg_min(h.n, h.i) AS n FROM here h WHERE h.doc_id = t.doc_id AND h.i >= t.i + t.n) x WHERE x.i IS NOT NULL
)
SELECT d.doc_id, count(t.i) AS n, coalesce(sum(t.n), 0)::BIGINT AS n_words, coalesce(string_agg(t.i || ':' || t.n, ',' ORDER BY t.i), '') AS places FROM documents d LEFT JOIN taken t USING (doc_id) GROUP BY 1""")
def dictionary_entities(spark, sf_dir):
    """Terms out of the benchmark, found in all documents."""
    terms = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("term_id"), F.array_join(F.slice(entities.words(F.col("text")), 1, (F.col("item_id") % 4 + 1).cast("int")), " ").alias("term"))
    found = entities.matched(table(spark, sf_dir, "documents").select("doc_id", "text"), terms)
    listed = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["start"].cast("string"), e["size"].cast("string"))), ",")
    return found.select("doc_id", F.size("entities").cast("long").alias("n"), F.aggregate("entities", F.lit(0).cast("long"), lambda a, e: a + e["size"]).alias("n_words"), listed.alias("places"))


#: Broken lines by event, and how each ends up.
_BROKEN = ('{{"k": {0}}}', '{{"k": {0}', "{{'k': {0},}}", "{{k: {0}, s: tail", '{{"k" {0} "s": "open', "no json {0}", '{{"k": {0}}} and more', '[{{"k": {0}]', '{{"k": {0}, /* why */ "x": ,}}')
_HOW = ("0", "1 missing bracket", "2 single quotes|surplus comma", "4 bare word|bare word|bare word|missing bracket", "4 missing bracket|missing colon|missing comma|open string", "quarantined", "quarantined", "1 other bracket", "3 comment|missing value|surplus comma")


@query(f"""WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, {list(_HOW)}[event_id % {len(_HOW)} + 1] AS how FROM events)
SELECT event_id, CASE WHEN how <> 'quarantined' THEN k END AS k, regexp_replace(how, '^[0-9] ?', '') AS how FROM e""")
def json_mended(spark, sf_dir):
    """Broken lines mended, with their faults, and those that are put in quarantine."""
    k = F.get_json_object("props", "$.k")
    lines = table(spark, sf_dir, "events").select("event_id", _of("event_id", [F.concat(*[x for p in [b.replace("{{", "{").replace("}}", "}").split("{0}")] for x in (F.lit(p[0]), k, F.lit(p[1]))]) for b in _BROKEN]).alias("line"))
    fine, left = repair.repaired(lines, "line")
    read = F.coalesce(F.try_variant_get("value", "$.k", "long"), F.try_variant_get("value", "$[0].k", "long"))
    kinds = F.array_join(F.array_sort(F.transform("faults", lambda f: f["kind"])), "|")
    return fine.select("event_id", read.alias("k"), kinds.alias("how")).unionByName(left.select("event_id", F.lit(None).cast("long").alias("k"), F.lit("quarantined").alias("how")))


_PLANTED = "list_transform(string_split(text, ' '), lambda w, i: CASE WHEN (doc_id + i) % 97 = 0 AND length(w) > 5 AND regexp_matches(w, '^[a-z]*o[a-z]*$') THEN regexp_replace(w, 'o', '0') ELSE w END)"


def _planted(spark, sf_dir):
    """Texts in which the first o of some words is a 0."""
    swap = lambda w, i: F.when(((F.col("doc_id") + i + 1) % 97 == 0) & (F.length(w) > 5) & w.rlike("^[a-z]*o[a-z]*$"), F.regexp_replace(w, "^([a-np-z]*)o", "$10")).otherwise(w)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split("text", " "), swap), " ").alias("text"))


#: DuckDB counts edits by bytes, so that each sign beyond ASCII becomes one of one byte.
_BYTE = "translate({}, 'éêèçäüößóñáíúàâîôûùëïœæﬁﬂ', 'ABCDEFGHIJKLMNOPQRSTUVWXY')"
_FOLD = "replace(replace(replace(replace(replace(replace(replace(replace({}, 'rn', 'm'), 'cl', 'd'), 'vv', 'w'), '0', 'o'), '1', 'l'), '5', 's'), 'ﬁ', 'fi'), 'ﬂ', 'fl')"


@query(f"""WITH word AS (SELECT unnest(string_split_regex(array_to_string({_PLANTED}, ' '), '\\s+')) AS word FROM documents),
counted AS (SELECT word, count(*) AS n FROM word WHERE regexp_matches(word, '^[\\p{{Ll}}0-9ﬁﬂ]{{4,40}}$') AND regexp_matches(word, '\\p{{Ll}}') GROUP BY 1),
pair AS (SELECT a.word, a.n, b.word AS correct, b.n AS of, {_FOLD.format('a.word')} = {_FOLD.format('b.word')} AS alike FROM counted a, counted b WHERE a.n <= 2 AND b.n >= 20 AND abs(length(a.word) - length(b.word)) <= 2),
weighed AS (SELECT word, correct, round(of * CASE WHEN alike THEN 100.0 ELSE 1.0 END / n, 6)::DOUBLE AS weight FROM pair WHERE alike OR levenshtein({_BYTE.format('word')}, {_BYTE.format('correct')}) = 1)
SELECT * FROM weighed WHERE weight >= 10 QUALIFY row_number() OVER (PARTITION BY word ORDER BY weight DESC, correct) = 1""")
def scan_corrections(spark, sf_dir):
    """Rare words of garbled texts, and the frequent words that they stand for."""
    return corrections.corrections(corrections.vocabulary(_planted(spark, sf_dir)))


_NAMES = "MAP {" + ", ".join("'{}': '{}'".format(k, v.replace("'", "''")) for k, v in pages.NAMES.items()) + "}"
_ATTRIBUTES = """(?:[^>"'']|"[^"]*"|''[^'']*'')*"""
_MARKUP = f"(?is)(?:<!--.*?(?:-->|\\z)|<script(?:[\\s/]{_ATTRIBUTES})?>.*?(?:</script[^>]*>|\\z)|<style(?:[\\s/]{_ATTRIBUTES})?>.*?(?:</style[^>]*>|\\z)|<[!?][^>]*>)|(</?[a-z]{_ATTRIBUTES}>)"
_A, _B, _C, _D, _E = (f"chr({ord(c)})" for c in (pages.MARKUP, pages.TEXT, pages.CUT, pages.LINK, pages.UNLINK))
_READ = f"""CASE WHEN i = 1 THEN p WHEN regexp_matches(p, '^#[0-9]{{1,7}};') THEN chr(CAST(regexp_extract(p, '^#([0-9]+)', 1) AS INTEGER)) || p[strpos(p, ';') + 1 :]
WHEN regexp_matches(p, '^[a-zA-Z][a-zA-Z0-9]*;') AND {_NAMES}[regexp_extract(p, '^([a-zA-Z0-9]+);', 1)] IS NOT NULL THEN {_NAMES}[regexp_extract(p, '^([a-zA-Z0-9]+);', 1)] || p[strpos(p, ';') + 1 :] ELSE '&' || p END"""


@query(f"""WITH page AS (SELECT page_id, unnest(t) AS t, generate_subscripts(t, 1) AS i FROM (SELECT page_id, string_split(regexp_replace(html, '{_MARKUP}', {_A} || '\\1' || {_B}, 'g'), {_A}) AS t FROM pages)),
token AS (SELECT page_id, i, CASE WHEN i = 1 THEN '' ELSE string_split(t, {_B})[1] END AS tag, CASE WHEN i = 1 THEN t ELSE t[strpos(t, {_B}) + 1 :] END AS s FROM page),
part AS (SELECT page_id, i AS n, tag, unnest(string_split(s, '&')) AS p, generate_subscripts(string_split(s, '&'), 1) AS i FROM token),
text AS (SELECT page_id, n, tag, string_agg({_READ}, '' ORDER BY i) AS s FROM part GROUP BY 1, 2, 3),
named AS (SELECT *, lower(regexp_extract(tag, '^</?([a-zA-Z][^\\s/>]*)', 1)) AS name FROM text),
whole AS (SELECT page_id, string_agg(CASE WHEN name IN {pages.BLOCKS} THEN {_C} WHEN name = 'br' THEN ' ' WHEN name = 'a' AND tag LIKE '</%' THEN {_E} WHEN name = 'a' THEN {_D} ELSE '' END || s, '' ORDER BY n) AS s FROM named GROUP BY 1),
cut AS (SELECT page_id, unnest(string_split(s, {_C})) AS b, generate_subscripts(string_split(s, {_C}), 1) AS i FROM whole),
sized AS (SELECT page_id, i, trim(regexp_replace(replace(replace(b, {_D}, ''), {_E}, ''), '[\\s\\x{{a0}}]+', ' ', 'g')) AS s,
  replace(array_to_string(regexp_extract_all(b, {_D} || '([^' || {_E} || ']*)', 1), ' '), {_D}, '') AS linked FROM cut),
block AS (SELECT page_id, i, s, len(string_split(s, ' ')) AS w, len(list_filter(string_split_regex(linked, '[\\s\\x{{a0}}]+'), lambda x: x <> '')) AS l FROM sized WHERE s <> ''),
beside AS (SELECT *, coalesce(lag(w) OVER x, 0) AS wb, coalesce(lag(l / w) OVER x, 0) AS lb, coalesce(lead(w) OVER x, 0) AS wa FROM block WINDOW x AS (PARTITION BY page_id ORDER BY i)),
judged AS (SELECT *, CASE WHEN l / w > 1.0 / 3 THEN false WHEN lb * 9 <= 5 THEN w > 16 OR wa > 15 OR wb > 4 ELSE w > 40 OR wa > 17 END AS stays FROM beside)
SELECT page_id, count(*) AS n, count(*) FILTER (stays) AS kept, md5(string_agg(s, chr(10) ORDER BY i)) AS blocks, md5(coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (stays), '')) AS body FROM judged GROUP BY page_id""")
def page_text(spark, sf_dir):
    """The blocks of pages, and the text that is no boilerplate."""
    found = pages.extracted(table(spark, sf_dir, "pages"))
    lines = F.when(F.col("body") == "", 0).otherwise(F.size(F.split("body", "\n")))
    return found.where("size(blocks) > 0").select("page_id", F.size("blocks").cast("long").alias("n"), lines.cast("long").alias("kept"), F.md5(F.array_join("blocks", "\n")).alias("blocks"), F.md5("body").alias("body"))


@query("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, least(doc_id % 7, len(w)) AS start, 3 AS words, 'zq' || doc_id || ' zqa zqb' AS lost FROM w""")
def aligned_losses(spark, sf_dir):
    """Words that a text has lost, found by alignment: before, each text held three more at a place by its id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("w"))
    at = (F.col("doc_id") % 7).cast("int")
    planted = F.array(F.concat(F.lit("zq"), F.col("doc_id").cast("string")), F.lit("zqa"), F.lit("zqb"))
    before = F.array_join(F.concat(F.slice("w", F.lit(1), at), planted, F.slice("w", at + 1, F.greatest(F.size("w") - at, F.lit(0)))), " ")
    found = losses.lost_spans(docs.select("doc_id", "text", before.alias("before")), "before", "text")
    return found.select("doc_id", F.explode("lost").alias("l")).select("doc_id", F.col("l.start").alias("start"), F.col("l.words").cast("int").alias("words"), F.col("l.text").alias("lost"))


_DENIED = (". There was no green fever, but grey cough was there", ". Not only green fever but grey cough", ". Without any sign of it or of green fever. Grey cough", ". It lacked nothing; green fever and grey cough were ruled out")
_SAID = ("1,0", "0,0", "0,0", "0,0")


@query(f"SELECT doc_id, {list(_SAID)}[doc_id % {len(_SAID)} + 1] AS negated FROM documents")
def negated_entities(spark, sf_dir):
    """Entities in texts, each with whether it is denied; the scope of six words ends before the third text's entity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _j(F.col("text"), _of("doc_id", list(_DENIED))).alias("text"))
    terms = spark.createDataFrame([(1, "green fever"), (2, "grey cough")], "term_id long, term string")
    found = entities.negated(entities.matched(docs, terms))
    return found.select("doc_id", F.array_join(F.transform("negated", lambda x: x.cast("int").cast("string")), ",").alias("negated"))
