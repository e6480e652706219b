"""Operator 7: quality classifier by importance resampling.

Generative models over hashed n-grams (trigrams of bytes and bigrams of lower-case words), one of target text (labelled
good) and one of all raw text, give each document its importance weight, the ratio of its likelihoods. Raw counts run over
all documents; the target's over those of at most `target_rows` labelled rows, chosen by a hash of id, whose ids are what
is broadcast. The target's model is mixed with the raw one: by a share of 0.05, and for bigrams, of which most are rare, by
`prior` bigrams of raw text if that is more, so that few labels say little. The k documents of the highest log weight +
Gumbel noise are a sample without replacement by weight; unless given, k is the number of documents whose log weight is
`least` or more. N-grams that overlap repeat what they say, so their log ratios are divided by n; a document of over PASSAGE
n-grams weighs as its average passage does, else a small difference in the mix of languages between the labelled sample
and the corpus would add up over thousands of them. The noise is scaled by `temperature`: at 0 the k likeliest documents
are taken.

The k-th key is found by histograms over the written scores, bins of one range at a time, until at most `bin_rows` rows
are left to look at; where more rows share one key, their ids are told apart sign by sign in the same way. So there is
no sort of all rows and no unbounded collect. Texts are read twice and never shuffled.

Rows: a null text, or one of under 3 bytes, has weight 1; a null id is hashed as empty; documents that tie in key go by
id, and rows that tie in both stay or go together; without labelled rows all weights are 1. Other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litforge.llm import _hashing as H
from litforge.llm._io import written

#: Of trigrams and of bigrams: n, the bits of their hashes, and where their buckets begin.
N, BITS, FIRST = (3, 2), (14, 16), (0, 1 << 14)
BUCKETS = sum(1 << b for b in BITS)
#: A longer document weighs as much as an average passage of so many n-grams of it.
PASSAGE = 100
UNIT = float(1 << 52)


def buckets(data: np.ndarray) -> np.ndarray:
    """The hashed trigram at each byte but the last two."""
    x = data.astype(np.uint32)
    return ((x[:-2] | (x[1:-1] << 8) | (x[2:] << 16)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS[0])


def _grams(column):
    """For runs of rows: which n-grams, the first and the last row, the bucket at each place, and where each row's own
    places begin and end."""
    data, offsets = H.utf8(column)
    for i, j in H.pieces(offsets):
        begin = offsets[i : j + 1] - offsets[i]
        cut = data[offsets[i] : offsets[j]]
        gram = buckets(cut).astype(np.int64) if len(cut) >= N[0] else np.zeros(0, dtype=np.int64)
        first = np.minimum(begin[:-1], len(gram))  # short texts at the end have no place
        yield 0, i, j, gram, first, np.maximum(begin[1:] - N[0] + 1, first)
    data, offsets = H.utf8(H.lowered(column))
    for i, j in H.pieces(offsets):
        hashes, first = H.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        pairs, begin = H.shingles(hashes, first, N[1], short=False)
        yield 1, i, j, (pairs >> np.uint64(64 - BITS[1])).astype(np.int64) + FIRST[1], begin[:-1], begin[1:]


def _inside(begin: np.ndarray, end: np.ndarray, rows: np.ndarray, places: int) -> np.ndarray:
    """Which places are some row's own."""
    step = np.zeros(places + 1, dtype=np.int64)
    np.add.at(step, begin[rows], 1)
    np.add.at(step, end[rows], -1)
    return np.cumsum(step)[:-1] > 0


def _counted(target: np.ndarray):
    def run(batches):
        raw, good = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            ids = pc.fill_null(batch.column("id"), -(1 << 62)).to_numpy(zero_copy_only=False)
            own = np.isin(ids, target)
            for _, i, j, gram, begin, end in _grams(batch.column("text")):
                some = end > begin
                raw += np.bincount(gram[_inside(begin, end, some, len(gram))], minlength=BUCKETS)
                if own[i:j].any():
                    good += np.bincount(gram[_inside(begin, end, some & own[i:j], len(gram))], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(good[some])], names=["bucket", "raw", "good"])

    return run


def _weighed(ratio: np.ndarray, text_col: str, keep_text: bool):
    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for f, i, j, gram, begin, end in _grams(batch.column(text_col)):
                sums = np.concatenate(([0.0], np.cumsum(ratio[gram])))
                out[i:j] += (sums[end] - sums[begin]) / N[f] * np.minimum(1.0, PASSAGE / np.maximum(end - begin, 1))
            if not keep_text:
                batch = batch.drop_columns([text_col])
            yield batch.append_column("log_weight", pa.array(np.round(out, 6)))

    return run


def _keyed(df: DataFrame, ratio: np.ndarray, id_col: str, text_col: str, temperature: float, seed: int, keep_text: bool) -> DataFrame:
    """df (without the text unless kept) with log_weight and key."""
    schema = T.StructType([f for f in df.schema.fields if keep_text or f.name != text_col]).add("log_weight", "double")
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), _word(id_col))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(UNIT)
    return df.mapInArrow(_weighed(ratio, text_col, keep_text), schema).withColumn("key", F.round(F.col("log_weight") - F.log(-F.log(u)) * F.lit(float(temperature)), 9))


def log_ratio(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, good: Column, target_rows: int = 20_000, background: float = 0.05, prior: float = 1e6) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw), for trigrams and for bigrams; the target's models are mixed with the raw
    ones, those of bigrams by a share that falls as labelled text grows."""
    ids = labels.where(good & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id")).distinct()
    some = ids.orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(target_rows)
    target = np.array(sorted(r["id"] for r in some.collect()), dtype=np.int64)
    counted = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_counted(target), "bucket int, raw long, good long")
    raw, aim = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect():  # at most BUCKETS rows
        raw[r["bucket"]], aim[r["bucket"]] = r["raw"], r["good"]
    out = np.zeros(BUCKETS)
    for f, first in enumerate(FIRST):
        own = slice(first, first + (1 << BITS[f]))
        r, a = raw[own], aim[own]
        if a.sum():
            mixed = background if f == 0 else max(background, prior / (prior + a.sum()))
            seen = r > 0
            out[own][seen] = np.log(mixed + (1 - mixed) * (a[seen] / a.sum()) / (r[seen] / r.sum()))
    return out


def kth(scores: DataFrame, k: int, bins: int = 1024, bin_rows: int = 10_000) -> tuple[float, str] | None:
    """The key and id of the k-th row by falling key, then rising id (as text); None if there are no k rows."""
    low, high = scores.agg(F.min("key"), F.max("key")).first()
    if k < 1 or low is None:
        return None
    above = 0
    while True:
        inside = scores.where((F.col("key") >= low) & (F.col("key") <= high))
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            if high > low:  # neighbouring doubles: the higher one first
                n = inside.where(F.col("key") == high).count()
                above, low, high = (above, high, high) if above + n >= k else (above + n, *inside.where(F.col("key") < high).agg(F.min("key"), F.max("key")).first())
                if low is None:
                    return None
                continue
            place = _nth_id(inside.select(_word("id").alias("id")), k - above, bin_rows)
            return None if place is None else (low, place)
        spot = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        counts = {r["b"]: (r["n"], r["lo"], r["hi"]) for r in inside.groupBy(spot.alias("b")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}
        for b in sorted(counts, reverse=True):
            if above + counts[b][0] >= k:
                break
            above += counts[b][0]
        else:
            return None
        n, low, high = counts[b]
        if n <= bin_rows:
            break
    rows = scores.where((F.col("key") >= low) & (F.col("key") <= high)).select("key", _word("id").alias("id")).collect()
    rows = sorted(((-r["key"], r["id"]) for r in rows))
    return (-rows[k - above - 1][0], rows[k - above - 1][1]) if len(rows) >= k - above else None


def _word(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _nth_id(ids: DataFrame, n: int, rows: int) -> str | None:
    """The n-th of the ids in order, by the number of ids under each next sign after the signs found so far."""
    known = ""
    while True:
        inside = ids.where(F.startswith("id", F.lit(known)))
        if inside.limit(rows + 1).count() <= rows:
            left = sorted(r["id"] for r in inside.collect())
            return left[n - 1] if len(left) >= n else None
        counts = {r["c"]: r["n"] for r in inside.groupBy(F.substring("id", len(known) + 1, 1).alias("c")).agg(F.count("*").alias("n")).collect()}
        for c in sorted(counts):
            if counts[c] >= n:
                break
            n -= counts[c]
        else:
            return None
        if not c:  # the rows whose whole id is known; they repeat each other
            return known
        known += c


def resample(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good: Column | None = None, k: int | None = None, temperature: float = 1.0, seed: int = 7, target_rows: int = 20_000, least: float = -6.0, prior: float = 1e6) -> DataFrame:
    """id, log_weight, key (log weight + noise) and kept (one of the k highest keys) of every row. Unless given, k is the
    number of documents whose log weight is at least `least`, that is, whose evidence against them isn't decisive."""
    good = F.col("quality") == 1 if good is None else good
    ratio = log_ratio(df, labels, id_col, text_col, good, target_rows, prior=prior)
    scores, kept = _scored(df, ratio, id_col, text_col, k, temperature, seed, least)
    return scores.select(F.col("id").alias(id_col), "log_weight", "key", kept.alias("kept"))


def _scored(df, ratio, id_col, text_col, k, temperature, seed, least):
    """The written scores, and which of them are among the k highest keys."""
    plain = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scores = written(_keyed(plain, ratio, "id", "text", temperature, seed, False), "importance")
    if k is None:
        k = scores.where(F.col("log_weight") >= least).count()
    last = kth(scores, k)
    if last is None:
        return scores, F.lit(k > 0)
    return scores, (F.col("key") > last[0]) | ((F.col("key") == last[0]) & (_word("id") <= last[1]))


def keep_resampled(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", temperature: float = 1.0, seed: int = 7, target_rows: int = 20_000, least: float = -6.0, prior: float = 1e6) -> DataFrame:
    """The rows of df that resample() keeps: their keys are worked out again as the texts stream by, without a join."""
    ratio = log_ratio(df, labels, id_col, text_col, F.col("quality") == 1, target_rows, prior=prior)
    _, kept = _scored(df, ratio, id_col, text_col, None, temperature, seed, least)
    own = df.select(F.col(id_col).alias("id"), F.struct(*df.columns).alias("row"), F.col(text_col).alias("text"))
    return _keyed(own, ratio, "id", "text", temperature, seed, False).where(kept).select("row.*")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
