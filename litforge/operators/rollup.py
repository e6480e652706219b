"""Groups of records with their counts and parallel lists, and runs that go on where they stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(rows: DataFrame, key: str, order: str, lists: list[str], count: str = "total", unknown: str = "Unknown") -> DataFrame:
    """key, count and a list for each column, all in the same order; structs are collected, so nulls keep their place.
    A group becomes one row of output, so its size is bounded by what a row can hold."""
    items = F.array_sort(F.collect_list(F.struct(order, *lists)))
    grouped = rows.withColumn(key, F.coalesce(key, F.lit(unknown))).groupBy(key).agg(items.alias("_items"))
    return grouped.select(key, F.size("_items").alias(count), *(F.col("_items").getField(c).alias(c) for c in lists))


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that a former run has not done."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def run_stats(rows: DataFrame, chunks: str, ok: str) -> DataFrame:
    """One row: processed, failed, chunks, and chunks an article (0 if there are none)."""
    n = F.count_if(F.col(ok))
    return rows.agg(n.alias("processed"), F.count_if(~F.col(ok)).alias("failed"), F.sum(chunks).alias("total_chunks"), F.coalesce(F.sum(chunks) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("average_chunks"))


def model_summary(results: DataFrame) -> DataFrame:
    """By model: mean number of relations where there was no error, mean of times that aren't 0 or null, errors."""
    return results.groupBy("model").agg(F.avg(F.when(F.col("error").isNull(), F.col("n"))).alias("mean_n"), F.avg(F.when(F.col("elapsed_s") != 0, F.col("elapsed_s"))).alias("mean_s"), F.count("error").alias("errors"))
