"""The jobs that the library is made for, from files to files. A job that was stopped goes on with what is not done."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litforge.functions import jsonx, tags, text
from litforge.operators import corpus, extract, rollup
from litforge.sources import files, service

#: What parts a model's answer from its prompt.
MARKER, HEADER = "Here is the cleaned and merged text:", "<|start_header_id|>assistant<|end_header_id|>"
CLEAN_PROMPT = "Merge the chunks of this article into one clean text.\n\nTEXT TO CLEAN:\n"


def log_to(path: str, name: str = "litforge", level: int = logging.INFO) -> logging.Logger:
    """The driver's log, to a file and to the console."""
    log = logging.getLogger(name)
    log.setLevel(level)
    for handler in (logging.FileHandler(path, encoding="utf-8"), logging.StreamHandler()):
        handler.setFormatter(logging.Formatter("%(asctime)s - %(levelname)s - %(message)s"))
        log.addHandler(handler)
    return log


def clean_articles(spark: SparkSession, source: str, target: str, model: Callable[[str, str], str] | None = None, batches: int = 1, drop_store: bool = False) -> dict:
    """Cleans each article of a corpus file once: target/cleaned (article_id, pos, cleaned_text, n_chunks), target/output
    (one JSON object, one file) and target/output.stats.json. The chain stands in where there is no model or the model
    has failed. Each batch is one commit; a later run takes up the articles that target/cleaned lacks. With drop_store,
    target/cleaned is deleted at the end."""
    began, store = time.time(), f"{target}/cleaned"
    articles = files.article_corpus(spark, source).select("article_id", "pos", F.coalesce("chunks", F.array().cast("array<string>")).alias("chunks"))
    before = files.if_there(spark, store)
    old = before.count() if before is not None else 0
    for b in range(batches):
        todo = articles.where(F.pmod(F.xxhash64("article_id"), F.lit(batches)) == b)
        done = files.if_there(spark, store)
        if done is not None:
            todo = rollup.pending(todo, done, "article_id")
        plain = text.fallback_clean(text.join_chunks(F.col("chunks")))
        if model is None:
            cleaned = todo.withColumn("cleaned_text", plain)
        else:
            prompts = todo.select(F.lit("cleaner").alias("model"), F.col("article_id").alias("paper_id"), F.concat(F.lit(CLEAN_PROMPT), text.join_chunks(F.col("chunks"))).alias("prompt"))
            said = extract.asked(prompts, model, tries=1).select(F.col("paper_id").alias("article_id"), "raw")
            cleaned = todo.join(said, "article_id", "left").withColumn("cleaned_text", F.coalesce(text.post_process(text.answer(F.col("raw"), MARKER, HEADER)), plain))
        cleaned.select("article_id", "pos", "cleaned_text", F.size("chunks").alias("n_chunks")).write.mode("append").parquet(store)
    out = spark.read.parquet(store)
    n, total = out.count(), articles.count()
    fresh = out if before is None else rollup.pending(out, before, "article_id")
    chunks = fresh.agg(F.sum("n_chunks")).first()[0] or 0
    files.write_object(out, "article_id", "cleaned_text", "pos", f"{target}/output")
    stats = {"total_articles": total, "processed_articles": n, "resumed_articles": old, "failed_articles": total - n, "total_time": round(time.time() - began, 1), "total_chunks_processed": chunks, "average_chunks_per_article": chunks / n if n else 0.0}
    files.write_file(spark, f"{target}/output.stats.json", spark.createDataFrame([(json.dumps(stats, indent=2),)], "text string"))
    if drop_store:
        files.drop(spark, store)
    return stats


def extraction_matrix(papers: DataFrame, models: list[str], call: Callable[[str, str], str], prefix: str, suffix: str, excluded: tuple[int, ...] = (), sample: int | None = 4, seed: int = 42, parallel: int = 4, pause: float = 0.0, wait: float = 10.0) -> DataFrame:
    """model, paper_id, status, n, error, raw, elapsed_s for each model and drawn paper, from (id, pos, chunks). Papers
    without a text after cleaning take no part. `sample` None takes all papers; else so many are drawn by their place."""
    left = corpus.without_places(papers, excluded, "pos") if excluded else papers
    ready = left.select("id", "pos", text.merge_chunks(F.col("chunks")).alias("t")).where("t <> ''")
    if sample is not None:
        drawn = extract.seeded_places(ready.count(), sample, seed)
        ready = corpus.ordinal(ready, "pos").where(F.col("ord").isin(drawn)).drop("ord")
    each = ready.withColumn("model", F.explode(F.array(*map(F.lit, models))))
    said = extract.asked(each.select("model", F.col("id").alias("paper_id"), text.prompt(prefix, F.col("t"), suffix).alias("prompt")), call, parallel, pause, wait=wait)
    read = said.withColumn("e", jsonx.extraction(F.col("raw")))
    failed = F.col("error").isNotNull()
    return read.select("model", "paper_id", F.when(failed, "error").otherwise(F.col("e.status")).alias("status"), F.when(~failed, F.col("e.n")).alias("n"), F.coalesce("error", "e.error").alias("error"), F.col("e.raw").alias("raw"), "elapsed_s")


def write_results(results: DataFrame, papers: list[str], path: str) -> None:
    """One file with one JSON object: the papers drawn, each model's times by paper, and each model's results by paper (an
    extraction, or an error with the raw answer), in order. One task writes the file, entry by entry, sorting on disk if
    need be; no row holds more than an entry. Of several results of a model for a paper a good one stays, then the first in
    order of text; a null model or paper is called "null"."""
    entry = F.when(F.col("status") == "ok", F.coalesce("extraction", F.lit("null"))).otherwise(F.to_json(F.struct("error", "raw")))
    named = results.select(F.coalesce("model", F.lit("null")).alias("model"), F.coalesce("paper_id", F.lit("null")).alias("paper_id"), F.struct((F.col("status") != "ok").alias("failed"), entry.alias("entry"), "elapsed_s").alias("r"))
    each = named.groupBy("model", "paper_id").agg(F.min("r").alias("r"))
    first, last = each.agg(F.min("model"), F.max("model")).first()
    head = '{\n  "papers_sampled": ' + json.dumps(papers, ensure_ascii=False) + ',\n  "timings": {'
    if first is None:
        lines = results.sparkSession.createDataFrame([(head + '},\n  "results": {}\n}',)], "line string")
    else:
        quoted = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
        ends = each.groupBy("model").agg(F.min("paper_id").alias("from"), F.max("paper_id").alias("to"))
        took = F.coalesce(F.col("r.elapsed_s").cast("string"), F.lit("null"))
        parts = each.join(ends, "model").select("*", F.explode(F.array(F.struct(F.lit(1).alias("part"), took.alias("value")), F.struct(F.lit(2).alias("part"), F.col("r.entry").alias("value")))).alias("e")).select("*", "e.part", "e.value")
        opens, closes = F.col("paper_id") == F.col("from"), F.col("paper_id") == F.col("to")
        before = F.when(opens & (F.col("model") == first), F.when(F.col("part") == 1, head + "\n").otherwise('  "results": {\n')).otherwise("")
        before = F.concat(before, F.when(opens, F.concat(F.lit("    "), quoted("model"), F.lit(": {\n"))).otherwise(""))
        after = F.when(~closes, ",").when(F.col("model") != last, "\n    },").when(F.col("part") == 1, "\n    }\n  },").otherwise("\n    }\n  }\n}")
        lines = parts.select("part", "model", "paper_id", F.concat(before, F.lit("      "), quoted("paper_id"), F.lit(": "), F.col("value"), after).alias("line"))
        lines = lines.repartition(1).sortWithinPartitions("part", "model", "paper_id").select("line")
    files.write_file(results.sparkSession, path, lines)


def paper_summary(results: DataFrame, models: list[str]) -> DataFrame:
    """A row a paper with each model's number of relations; no result counts as 0, an error as null."""
    found = results.groupBy("paper_id").pivot("model", models).agg(F.first(F.struct("status", "n")))
    return found.select("paper_id", *(F.when(F.col(m).isNull(), 0).when(F.col(f"{m}.status") == "ok", F.col(f"{m}.n")).alias(m) for m in models))


def study_rollups(spark: SparkSession, catalogue: str, column: str, fetch: Callable[[dict[str, str]], str], target: str) -> tuple[DataFrame, DataFrame]:
    """Asks for each study of a catalogue (repeated codes again), writes a file of JSON a study, and returns the
    rollups (study_accession, total_samples_found, alias, title) and the failed studies. The catalogue's codes are read
    on the driver, which makes a request of each."""
    codes = [r[0] for r in files.table(spark, catalogue).select(column).where(F.col(column).isNotNull()).collect()]
    bodies = spark.read.format(service.register(spark, fetch)).option("studies", ",".join(codes)).load()
    stored = f"{target}/bodies"
    bodies.write.mode("overwrite").parquet(stored)  # each study is asked once
    found, failed = files.samples(spark.read.parquet(stored))
    rows = found.select(F.coalesce("study_accession", F.lit("Unknown")).alias("study_accession"), "sample_accession", F.coalesce("sample_alias", F.lit("N/A")).alias("alias"), F.coalesce("sample_title", F.lit("N/A")).alias("title"))
    grouped = rollup.rollup(rows, "study_accession", "sample_accession", ["alias", "title"], "total_samples_found")
    files.write_group_files(grouped, "study_accession", f"{target}/studies")
    return grouped, failed


def tagged_to_conll(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Turns a wide table of tokens and tags into target/train, val and test as CoNLL text, 70, 15 and 15 per cent by
    place, with target/labels; returns the tag set."""
    sentences = tags.wide_bio(files.wide_rows(spark, source))
    placed = corpus.split_by_place(tags.numbered(sentences), "place")
    for split in ("train", "val", "test"):
        files.write_conll(placed.where(F.col("split") == split).select(F.col("place").alias("sent_id"), tags.conll_text(F.col("pairs")).alias("text")), f"{target}/{split}")
    train = placed.where("split = 'train'").select(F.explode("pairs").alias("p")).select("p.tag")
    files.label_map(tags.label_ids(train)).write.mode("overwrite").text(f"{target}/labels")
    return tags.tag_set(sentences.select(F.explode("pairs").alias("p")).select("p.tag"))
