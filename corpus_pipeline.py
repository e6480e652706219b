"""The stages from raw documents to a training mix. Each works on all that the one before has kept; what it reads and
returns has the columns of documents, but for the last, which adds what the mix says of each copy.

Rows, for every stage: an empty table gives an empty table; texts are read whole, however long; columns beside doc_id,
text, source and n_chars come through as they are, whatever their names, but for `rate`, `copy` and `place`, which the
last stage sets. Each stage says what it makes of nulls, empty texts, ties and rows that repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litforge.llm._io import drop_since, mark, written
from litforge.llm.op1_mix import mix
from litforge.llm.op3_decontaminate import contaminated
from litforge.llm.op5_jaccard_join import representatives
from litforge.llm.op6_secret_scan import redact
from litforge.llm.op7_quality import keep_resampled


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose importance weight speaks against them. A null text, or one of under 3 bytes, has weight 1 and
    stays, subject to the noise; documents that tie go by id, and rows that repeat stay or go together."""
    return keep_resampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one of smallest id, and where several texts of the group have
    that id, the one of smallest hash; of rows alike in id and text, one, the least in its other columns' hash. Texts
    without a word, or null, are a group each by themselves: one row for each id and text. A null id is an id."""
    stays = written(representatives(docs), "stays").withColumnsRenamed({"doc_id": "of_id", "h": "of_h"})
    of_text = F.xxhash64(docs["text"])
    kept = docs.join(stays.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(stays["of_id"]) & (of_text == stays["of_h"]), "left_semi")
    if not stays.where("n > 1").limit(1).count():
        return kept
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    if not rest:
        return kept.distinct().select(*docs.columns)
    one = kept.groupBy("doc_id", "text").agg(F.min_by(F.struct(*rest), F.xxhash64(F.to_json(F.struct(*rest)))).alias("_rest"))
    return one.select("doc_id", "text", "_rest.*").select(*(F.col(f"`{c}`") for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that cover a benchmark item. Null and empty texts cover none and stay; rows that repeat stay or go
    together; items that tie make no difference."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=docs.columns, prefix=prefix)
    return found.where(F.col(f"{prefix}n_items") == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets and counts characters anew; the documents stay, also those of null or empty text (null: n_chars is
    null). Rows that repeat are masked alike; spans that overlap become one mark."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents to the sources' target weights (square roots of their sizes), in a global random order. A null
    source is a source; a source without a character has no copies; rows that repeat an id draw the same count."""
    return mix(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("mixture", mixture)]
#: SQL can't express the stages; tests/llm/test_pipeline.py holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = mark()
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_since(before - (name != STAGES[0][0]), but=1)  # the stage's own tables, and its predecessor's rows
    return docs
