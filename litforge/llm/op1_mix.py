"""Operator 1: mixing sources to target weights by Poisson replication.

A source's rate is the mean number of copies of its documents: target weight times budget over the source's size. Each
document draws its count by inverting the Poisson distribution at a number from 0 to 1 that is hashed out of seed, id and
text, is repeated that often, and every copy goes to a place of a global order that is hashed out of these and the copy.

Sizes are summed before the shuffle, a row a task and source. The table of sources is broadcast only if it has at most
`broadcast_sources` rows and `broadcast_numbers` numbers in all; beyond that its rows are replicated over `salt` slices
and joined by shuffle, so that a source with a third of all rows spreads over as many partitions. The copies are dealt
out by their place, not by their source.

Rows: a null source is a source of its own; a null id or text counts as empty. A source of size 0 has rate 0: its
documents have no copies. Rows that repeat an id with another text draw each for itself. So do rows that repeat id and
text, or share with such rows one of SLOTS hash values: the row's place in df counts in their draws too, so that
a text in a third of all rows keeps its weight and spreads over all places; which of them are drawn then depends on how
df is stored. Columns of df are kept, whatever their names;
`rate`, `copy` and `place` are added, replacing columns of these names. Sources that weights doesn't name have weight 0.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litforge.llm._io import collected_bounded

UNIT = float(1 << 52)
SLOTS = 1 << 16


def hashed(*parts: Column) -> Column:
    """A number from 0 to 1, alike in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(UNIT)


def _thresholds(batches):
    """Adds P(X <= 0), P(X <= 1), ... of the Poisson distribution, up to where they reach 1 for any number of 52 bits."""
    for batch in batches:
        tables = []
        for rate in batch.column("_rate").to_pylist():
            k = np.arange(1, math.ceil(rate + 10 * math.sqrt(rate) + 20) + 1)
            tables.append(np.cumsum(np.exp(np.concatenate(([0.0], np.cumsum(math.log(rate) - np.log(k)))) - rate)) if rate > 0 else np.ones(1))
        yield batch.append_column("_cdf", pa.array(tables, type=pa.list_(pa.float64())))


def rates(df: DataFrame, source_col: str, size: Column, weights: dict[str, float] | None, power: float, budget: float | None) -> DataFrame:
    """_source, _rate and _cdf: with weights as given, or else sizes to the power (1: as they are, 0: all alike)."""
    sums = df.groupBy(F.col(source_col).alias("_source")).agg(F.sum(size).cast("double").alias("_size"))
    if weights is None:
        weight = F.when(F.col("_size") > 0, F.pow("_size", F.lit(power))).otherwise(0.0)
    else:
        weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])[F.col("_source")] if weights else F.lit(0.0), F.lit(0.0))
        weight = F.when(F.col("_size") > 0, weight).otherwise(0.0)
    all_sums = sums.withColumn("_weight", weight).agg(F.sum("_weight").alias("_w"), F.sum("_size").alias("_s"))
    total = F.lit(float(budget)) if budget is not None else F.col("_s")
    rate = F.when((F.col("_size") > 0) & (F.col("_w") > 0), F.col("_weight") / F.col("_w") * total / F.col("_size")).otherwise(0.0)
    return sums.withColumn("_weight", weight).join(F.broadcast(all_sums)).select("_source", rate.alias("_rate"))  # all_sums has one row


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: dict[str, float] | None = None, power: float = 0.5, budget: float | None = None, seed: int = 1, broadcast_sources: int = 10_000, broadcast_numbers: int = 1 << 20, salt: int = 64) -> DataFrame:
    """The copies of all documents, dealt out and ordered by `place`, a random number: each partition is a random share of
    all copies in random order, and ordering by place gives one random order of all. Sizes and budget
    count characters; the budget is the size of df unless given."""
    spark = df.sparkSession
    kept = [c for c in df.columns if c.lower() not in ("copy", "rate", "place")]
    # the columns travel as one, so that none of them meets a name that is used here
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.length(text).alias("size"), F.md5(text).alias("h"), F.monotonically_increasing_id().alias("nth"))
    docs = _keyed(docs)
    per_source = rates(docs, "source", F.col("size"), weights, power, budget).mapInArrow(_thresholds, T.StructType([T.StructField("_source", docs.schema["source"].dataType), T.StructField("_rate", T.DoubleType()), T.StructField("_cdf", T.ArrayType(T.DoubleType()))]))
    n, numbers = per_source.agg(F.count("*"), F.sum(F.size("_cdf"))).first()
    if n <= broadcast_sources and (numbers or 0) <= broadcast_numbers:
        known = spark.createDataFrame(per_source.collect(), per_source.schema)
        joined = docs.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("_source")))
    else:
        spread = per_source.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        salted = docs.withColumn("_slice", F.pmod(F.xxhash64("key", "source"), F.lit(salt)).cast("int"))
        joined = salted.join(spread, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_slice") == F.col("_salt")))
    u = hashed(F.lit(str(seed)), F.col("key"))
    count = F.when(u < F.element_at("_cdf", 1), 0).otherwise(F.size(F.filter("_cdf", lambda c: c <= u)))
    copies = joined.withColumn("_n", count).where("_n > 0").select("row", "key", F.col("_rate").alias("rate"), F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"))
    placed = copies.withColumn("place", hashed(F.lit(str(seed)), F.col("key"), F.col("copy").cast("string")))
    return placed.repartition("place").sortWithinPartitions("place", "key", "copy").select("row.*", "rate", "copy", "place")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with key, the words that are hashed: id and hash of the text, and the row's place where these may repeat."""
    slot = F.pmod(F.xxhash64("id", "h"), F.lit(SLOTS)).cast("int")
    again = docs.groupBy("id", "h").agg(F.count("*").alias("n")).where("n > 1").select(slot.alias("slot")).distinct()
    found = collected_bounded(again, SLOTS, "the hash values of rows that repeat")
    parts = [F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("h")]
    if not found:
        return docs.withColumn("key", F.concat_ws(":", *parts))
    slots = docs.sparkSession.createDataFrame(found, "slot int").withColumn("many", F.lit(True))
    flagged = docs.withColumn("slot", slot).join(F.broadcast(slots), "slot", "left")
    return flagged.withColumn("key", F.concat_ws(":", *parts, F.when(F.col("many"), F.col("nth").cast("string")))).drop("slot", "many")


def expected_copies(rate: float, u: float) -> int:
    """The inverse of the Poisson distribution at u, plainly: the test's reference."""
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u and k < 10_000:
        k += 1
        p *= rate / k
        total += p
    return k


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "copy", F.round("rate", 9).alias("rate"), "place", "text")


OP1_SQL = """
WITH RECURSIVE size AS (
  SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS s FROM documents GROUP BY source
), rate AS (
  SELECT source, CASE WHEN s > 0 THEN sqrt(s) / sum(CASE WHEN s > 0 THEN sqrt(s) ELSE 0 END) OVER () * sum(s) OVER () / s ELSE 0 END AS rate FROM size
), cdf(source, rate, k, p, c) AS (
  SELECT source, rate, 0, -rate, exp(-rate) FROM rate
  UNION ALL
  SELECT source, rate, k + 1, p + ln(rate / (k + 1)), c + exp(p + ln(rate / (k + 1))) FROM cdf WHERE rate > 0 AND k < ceil(rate + 10 * sqrt(rate) + 20)
), drawn AS (
  SELECT doc_id, d.source, text, r.rate, CAST('0x' || substr(md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM documents d JOIN rate r ON d.source IS NOT DISTINCT FROM r.source
), n AS (
  SELECT doc_id, source, text, rate, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM drawn.source AND cdf.c <= drawn.u) AS n FROM drawn
)
SELECT doc_id, source, CAST(copy AS INTEGER) AS copy, round(rate, 9) AS rate,
  CAST('0x' || substr(md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) || ':' || copy), 1, 13) AS BIGINT) / 4503599627370496.0 AS place, text
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM n)
"""
