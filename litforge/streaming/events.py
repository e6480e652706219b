"""The cleaning chain and windowed counts as streams, and grouped results that are kept up to date as rows arrive; the
batch operators' expressions are used as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litforge.functions.text import fallback_clean
from litforge.operators import corpus


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))


def cleaned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumn("cleaned_text", fallback_clean(F.col(text_col)))


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Takes in what is there and stops; a later run goes on where this one stopped."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def first_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """chunk_md5, place (id and number of the chunk that comes first) and n of each different chunk, of a stream or a table."""
    each = corpus.chunks(docs, id_col, text_col)
    return each.groupBy(F.md5("chunk").alias("chunk_md5")).agg(F.min(F.struct(F.col(id_col).alias("id"), "pos")).alias("place"), F.count("*").alias("n"))


def keep(groups: DataFrame, path: str, checkpoint: str) -> None:
    """Takes in what is there of a grouped stream and stops; a later run, also one after a crash, goes on where this one
    stopped. The groups' sums are in the state store; each micro-batch writes the groups that it changed to a folder of
    its own number, so that a batch that is run again after a crash replaces what it wrote before."""

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    groups.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The state of each group as of its last change. All batches' rows of a group are reduced to its newest by a partial
    aggregate, so a group that changes in every batch sends a row a task."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return newest.select(*keys, "last.*")


def compact(spark: SparkSession, path: str, to: str, keys: list[str]) -> None:
    """Writes the latest state as batch -1 of another folder, which then stands for all batches so far: what later runs of
    keep() write there replaces it group by group."""
    latest(spark, path, keys).write.mode("overwrite").parquet(f"{to}/batch=-1")
