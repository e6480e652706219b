"""Token tags: cleaning, CoNLL text, label ids, spans and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litforge.functions.text import WS, strip

IGNORED = -100


def clean_tags(cell: Column) -> Column:
    return F.filter(F.transform(F.split(F.translate(cell, "[]\"'", ""), ","), strip), lambda x: x != "")


def clean_tokens(cells: Column) -> Column:
    return F.filter(F.transform(cells, lambda x: strip(F.translate(x, "\"'", ""))), lambda x: x != "")


def aligned(tokens: Column, tags: Column) -> Column:
    """Pairs, cut to the shorter list."""
    n = F.least(F.size(tokens), F.size(tags))
    return F.zip_with(F.slice(tokens, 1, n), F.slice(tags, 1, n), lambda a, b: F.struct(a.alias("token"), b.alias("tag")))


def wide_bio(rows: DataFrame) -> DataFrame:
    """file, sent_id and pairs from (file, pos, cells): a token row, its tag row, blank rows, and so on, in each file.

    Rows are paired two by two from the first of each run of rows that aren't blank; an odd row at a run's end has no tags
    and is dropped, as if it took the blank row for its pair. Only where a file begins with one blank row does the next row
    count as that row's tags. Windows over a file, and over its runs."""
    by_file = Window.partitionBy("file").orderBy("pos")
    blank = F.forall("cells", lambda c: strip(F.coalesce(c, F.lit(""))) == "")
    runs = rows.withColumn("_blank", blank).withColumn("_run", F.sum(F.col("_blank").cast("int")).over(by_file))
    some = runs.where(~F.col("_blank") & ~((F.col("pos") == 1) & (F.col("_run") == 1)))
    by_run = Window.partitionBy("file", "_run").orderBy("pos")
    paired = some.withColumn("_place", F.row_number().over(by_run) - 1).withColumn("_tags", F.lead("cells").over(by_run)).where((F.col("_place") % 2 == 0) & F.col("_tags").isNotNull())
    joined = F.array_join(F.transform("_tags", lambda c: F.coalesce(c, F.lit(""))), "")
    pairs = paired.select("file", "pos", aligned(clean_tokens("cells"), clean_tags(joined)).alias("pairs")).where("size(pairs) > 0")
    return pairs.select("file", (F.row_number().over(by_file) - 1).cast("long").alias("sent_id"), "pairs")


def numbered(sentences: DataFrame, name: str = "place") -> DataFrame:
    """Sentences of all files with their place among all, by file, then sent_id. The sizes of the files, which are listed
    on the driver anyway, are summed up in one task."""
    sizes = sentences.groupBy("file").agg(F.count("*").alias("_n"))
    before = sizes.select("file", (F.sum("_n").over(Window.orderBy("file")) - F.col("_n")).alias("_before"))
    return sentences.join(before, "file").withColumn(name, F.col("_before") + F.col("sent_id")).drop("_before")


def conll(files: DataFrame) -> DataFrame:
    """file, sent_id, pos, token, tag from (file, value): a line a token, blank lines between sentences; comments and
    lines of fewer than two fields are left out, empty sentences have no number."""
    lines = files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "raw")).withColumn("s", strip(F.col("raw")))
    by = Window.partitionBy("file").orderBy("line")
    fields = F.split("s", f"{WS}+")
    tokens = lines.withColumn("block", F.sum((F.col("s") == "").cast("int")).over(by)).withColumn("f", fields).where(~F.col("s").startswith("#") & (F.size("f") >= 2) & (F.col("s") != ""))
    return tokens.select("file", (F.dense_rank().over(Window.partitionBy("file").orderBy("block")) - 1).alias("sent_id"), (F.row_number().over(Window.partitionBy("file", "block").orderBy("line")) - 1).alias("pos"), F.get("f", F.lit(0)).alias("token"), F.get("f", F.lit(1)).alias("tag"))


def conll_text(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat_ws("\t", p["token"], p["tag"])), "\n")


def label_ids(tags: DataFrame, column: str = "tag") -> DataFrame:
    """label, id: ids in the order of code points. The distinct labels are few, so one task numbers them."""
    return tags.select(F.col(column).alias("label")).where("label is not null").distinct().withColumn("id", F.row_number().over(Window.orderBy("label")) - 1)


def align_labels(word_ids: Column, labels: Column, most: int = 512) -> Column:
    """A label id for each word piece: the first piece of a word has its word's, all others are ignored. Pieces beyond the
    first `most` are cut off."""
    word_ids = F.slice(word_ids, 1, most)
    first = lambda w, i: (i == 0) | ~w.eqNullSafe(F.get(word_ids, i - 1))
    return F.transform(word_ids, lambda w, i: F.when(w.isNull(), IGNORED).when(first(w, i), F.get(labels, w)).otherwise(IGNORED))


def argmax(scores: Column) -> Column:
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def decoded(ids: Column, gold: Column, names: Column) -> Column:
    """Names of the ids whose gold label isn't ignored."""
    pairs = F.filter(F.arrays_zip(ids.alias("i"), gold.alias("g")), lambda p: p["g"] != IGNORED)
    return F.transform(pairs, lambda p: F.element_at(names, p["i"]))


def bio_spans(tokens: DataFrame, keys: list[str], order: str, tag: str) -> DataFrame:
    """keys, type, start, end (inclusive): a span starts at B-, or at I- after O or another type."""
    by = Window.partitionBy(*keys).orderBy(order)
    kind, before = F.substring(tag, 3, 1000), F.lag(tag).over(by)
    marked = tokens.withColumn("kind", kind).withColumn("before", before)
    starts = F.col(tag).startswith("B-") | (F.col(tag).startswith("I-") & (F.col("before").isNull() | (F.col("before") == "O") | (F.substring("before", 3, 1000) != F.col("kind"))))
    runs = marked.withColumn("run", F.sum(starts.cast("int")).over(by)).where(F.col(tag) != "O")
    return runs.groupBy(*keys, "run", "kind").agg(F.min(order).alias("start"), F.max(order).alias("end")).select(*keys, F.col("kind").alias("type"), "start", "end")


def span_scores(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """type, tp, n_gold, n_pred, precision, recall, f1 by type; exact spans only, 0 where nothing is to divide by."""
    on = [*keys, "type", "start", "end"]
    both = gold.select(*on).withColumn("g", F.lit(1)).join(predicted.select(*on).withColumn("p", F.lit(1)), on, "full")
    n = both.groupBy("type").agg(F.count(F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1)).alias("tp"), F.count("g").alias("n_gold"), F.count("p").alias("n_pred"))
    return _scored(n)


def spans(tags: Column) -> Column:
    """The spans of a list of tags, as bio_spans has them, each as "start end type"."""
    kind = lambda t: F.substring(t, 3, 1000)
    near = lambda i: F.get(tags, F.greatest(i, F.lit(0)))
    starts = lambda t, i: t.startswith("B-") | (t.startswith("I-") & ((i == 0) | (near(i - 1) == "O") | (kind(near(i - 1)) != kind(t))))
    ends = lambda t, i: (t != "O") & ((i == F.size(tags) - 1) | (near(i + 1) == "O") | starts(near(i + 1), i + 1))
    places = lambda test: F.filter(F.transform(tags, lambda t, i: F.when(test(t, i), F.struct(i.alias("i"), kind(t).alias("type")))), lambda x: x.isNotNull())
    return F.zip_with(places(starts), places(ends), lambda a, b: F.concat_ws(" ", a["i"].cast("string"), b["i"].cast("string"), a["type"]))


def list_scores(rows: DataFrame, gold: str, predicted: str, by: list[str]) -> DataFrame:
    """by, type and what span_scores tells, of two lists of tags in each row: no token is shuffled, only counts."""
    own = rows.select(*by, spans(F.col(gold)).alias("g"), spans(F.col(predicted)).alias("p"))
    of = lambda c, i: F.transform(c, lambda s: F.struct(F.regexp_extract(s, r"^\d+ \d+ (.*)$", 1).alias("type"), F.lit(i).alias("what")))
    each = own.select(*by, F.explode(F.concat(of(F.array_intersect("g", "p"), 0), of(F.col("g"), 1), of(F.col("p"), 2))).alias("s")).select(*by, "s.*")
    n = each.groupBy(*by, "type").agg(*(F.count_if(F.col("what") == i).alias(c) for i, c in enumerate(("tp", "n_gold", "n_pred"))))
    return _scored(n)


def _scored(n: DataFrame) -> DataFrame:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    scored = n.withColumn("precision", share("tp", "n_pred")).withColumn("recall", share("tp", "n_gold"))
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def tag_set(pairs: DataFrame, column: str = "tag") -> DataFrame:
    return pairs.select(column).distinct().orderBy(column)


def with_ids(tokens: DataFrame, ids: DataFrame, tag: str = "tag") -> DataFrame:
    """tokens with label_id; a tag that has no id ends the job when it is read."""
    found = tokens.join(ids.select(F.col("label").alias(tag), F.col("id").alias("label_id")), tag, "left")
    return found.withColumn("label_id", F.coalesce("label_id", F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(tag, F.lit("null")))).cast("int")))


def span_bio(docs: DataFrame, id_col: str, text_col: str, spans: str) -> DataFrame:
    """id, pos, token, tag from texts with spans (start, end exclusive, label), split at white space. A token takes the
    first listed span that it overlaps: B- on the span's first token, I- on the rest."""
    words = docs.select(id_col, F.col(spans).alias("_spans"), F.posexplode(F.split(text_col, WS)).alias("_i", "token"))
    by = Window.partitionBy(id_col).orderBy("_i")
    placed = words.withColumn("_end", F.sum(F.length("token") + 1).over(by) - 1).withColumn("_start", F.col("_end") - F.length("token")).where("token <> ''")
    hit = F.get(F.filter("_spans", lambda s: (s["start"] < F.col("_end")) & (s["end"] > F.col("_start"))), F.lit(0))
    tagged = placed.withColumn("_s", hit).withColumn("_before", F.lag("_s").over(by))
    tag = F.when(F.col("_s").isNull(), "O").otherwise(F.concat(F.when(F.col("_s").eqNullSafe(F.col("_before")), "I-").otherwise("B-"), F.col("_s.label")))
    return tagged.select(id_col, (F.row_number().over(by) - 1).alias("pos"), "token", tag.alias("tag"))


def zipped_lines(tokens: DataFrame, tags: DataFrame) -> DataFrame:
    """file, sent_id, pairs from two tables (file, value) whose lines belong together."""
    lines = lambda d, n: d.select("file", F.posexplode(F.split("value", "\r?\n")).alias("sent_id", n))
    cells = lambda c: F.filter(F.split(strip(F.col(c)), f"{WS}+"), lambda x: x != "")
    return lines(tokens, "a").join(lines(tags, "b"), ["file", "sent_id"]).select("file", "sent_id", aligned(cells("a"), cells("b")).alias("pairs")).where("size(pairs) > 0")


def report(scores: DataFrame) -> DataFrame:
    """type, precision, recall, f1, support of span_scores by type, with micro, macro and weighted averages."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, gold, pred = (F.sum(c) for c in ("tp", "n_gold", "n_pred"))
    p, r = share(tp, pred), share(tp, gold)
    names = ("precision", "recall", "f1")
    row = lambda kind, values: F.struct(F.lit(kind).alias("type"), *(v.alias(n) for n, v in zip(names, values)), gold.alias("support"))
    means = scores.agg(F.array(
        row("micro avg", (p, r, share(2 * p * r, p + r))),
        row("macro avg", tuple(F.avg(n) for n in names)),
        row("weighted avg", tuple(share(F.sum(F.col(n) * F.col("n_gold")), gold) for n in names)),
    ).alias("m"))
    return scores.select("type", *names, F.col("n_gold").alias("support")).unionByName(means.select(F.explode("m").alias("m")).select("m.*"))
