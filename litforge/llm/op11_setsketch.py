"""Operator 11: near duplicates by SetSketch registers.

A text's set of word shingles is sketched in registers: register i keeps the least of one exponentially distributed hash of
each shingle, on a scale of powers of `base`, cut to 0 .. LIMIT + 1. Less hash is a higher register, so the sketch of a
union is the registers' greater values (`merged`), and sets of Jaccard similarity j have a register in common with a
chance of about j. Registers are banded: texts that share all registers of a band meet in its bucket. There the similarity
of each pair is estimated from how many registers are higher, lower and alike and from the known sizes of both sets, as the
one of greatest likelihood; pairs whose estimate is over `sigmas` standard deviations under the threshold are dropped, the
others are verified on their full sets. What follows, from buckets to linked groups, is that of operator 5, whatever the
size of a bucket.

The log likelihood is concave in the similarity, so whether its peak lies under a value is told by its slope there
(`likely`); `estimated` finds the peak.

Texts are lower-cased in A-Z only, words are what white space separates, and a text of fewer than k words is one shingle.
Links are exact: 100 * shared >= 85 * all, on sets of 64-bit hashes of shingles. Links that no band finds are lost: at the
threshold one in a thousand, `recall`, and fewer above it.

Result of near_duplicates, a row for each row: id, n_shingles, component_id (the smallest id that links lead to) and kept
(whether it is the row's own). Rows: a text that is null or without words has no shingle and no link. Texts with the same
shingles are linked. A null id names no group; a row whose group has no id at all has a null component_id and is kept.
Rows that repeat an id are each linked by their own text. Other columns are left aside.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litforge.llm import _hashing as H
from litforge.llm.op5_jaccard_join import Scheme, banded, joined, minima, plan

BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2


def _factors(m: int) -> np.ndarray:
    return H.mix(np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def sketched(sets: list[np.ndarray], m: int) -> np.ndarray:
    """m registers of each set of 64-bit hashes; none of the sets is empty."""
    # the least hash of a register is that of the least of its uniform numbers
    low = minima(sets, _factors(m)).astype(np.float64) + 0.5
    least = -np.log1p(-np.minimum(low / 2.0**64, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(least) / math.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def cardinality(registers: np.ndarray) -> np.ndarray:
    """How many elements the sketched sets have, by their registers alone."""
    m = registers.shape[-1]
    return m * (1 - 1 / BASE) / (RATE * math.log(BASE) * np.sum(BASE ** -registers.astype(np.float64), axis=-1))


def _slope(j, share_a, share_b, higher, lower, alike):
    """The derivative of the log likelihood at similarity j; share_a and share_b are the sizes over their sum."""
    c = (BASE - 1) / BASE
    tiny = 1e-12
    xa, xb = np.maximum(share_a - share_b * j, tiny), np.maximum(share_b - share_a * j, tiny)
    pa, pb = -np.log1p(-c * xa) / math.log(BASE), -np.log1p(-c * xb) / math.log(BASE)
    da, db = (-share_b * c / (1 - c * xa) / math.log(BASE), -share_a * c / (1 - c * xb) / math.log(BASE))
    return higher * da / pa + lower * db / pb - alike * (da + db) / np.maximum(1 - pa - pb, tiny)


def compared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many registers of each row of a are higher, and lower, than those of each row of b."""
    higher, lower = (np.zeros((len(a), len(b)), dtype=np.float32) for _ in range(2))
    for i in range(a.shape[1]):
        x, y = a[:, i][:, None], b[:, i][None, :]
        higher += x > y
        lower += x < y
    return higher, lower


def estimated(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The most likely Jaccard similarity of each row's set of a with each of b."""
    higher, lower = compared(a, b)
    alike = a.shape[1] - higher - lower
    share = size_a[:, None] / (size_a[:, None] + size_b[None, :])
    low, high = np.zeros(share.shape), np.minimum(share / (1 - share), (1 - share) / share)
    for _ in range(40):
        mid = (low + high) / 2
        up = _slope(mid, share, 1 - share, higher, lower, alike) > 0
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return (low + high) / 2


def _rows(sets: list[np.ndarray], registers: np.ndarray) -> list[bytes]:
    return [len(s).to_bytes(8, "little") + r.tobytes() for s, r in zip(sets, registers, strict=True)]


def _read(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = np.ascontiguousarray(rows)
    return rows[:, :8].copy().view(np.int64)[:, 0], rows[:, 8:].copy().view(np.uint16)


def by_setsketch(k: int, threshold: float, recall: float, sigmas: float = 5.0) -> Scheme:
    bands, rows = plan(threshold, recall)
    m = bands * rows
    least = max(0.05, threshold - sigmas * math.sqrt(threshold * (1 - threshold) / m))

    def sign(sets: list[np.ndarray]):
        registers = sketched(sets, m)
        return banded(registers, bands), _rows(sets, registers)

    def likely(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        (size_a, a), (size_b, b) = _read(a), _read(b)
        near = np.minimum(size_a[:, None], size_b[None, :]) >= threshold * np.maximum(size_a[:, None], size_b[None, :]) - 1e-6
        rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if not len(rows):
            return near
        higher, lower = compared(a[rows], b[columns])
        share = size_a[rows][:, None] / (size_a[rows][:, None] + size_b[columns][None, :])
        with np.errstate(divide="ignore", invalid="ignore"):
            near[np.ix_(rows, columns)] &= _slope(least, share, 1 - share, higher, lower, m - higher - lower) >= 0
        return near

    return Scheme(k, threshold, bands, sign, marked_words, likely)


def marked_words(data: np.ndarray, offsets: np.ndarray):
    return H.words(H.LOWER[data], offsets, H.MARKED)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.85, recall: float = 0.999, bucket: int = 256, block: int = 1024, block_bytes: int = 64 << 20) -> DataFrame:
    found = joined(df, id_col, text_col, by_setsketch(k, threshold, recall), bucket, block, block_bytes)
    return found.select(F.col("id").alias(id_col), F.col("n_shingles").cast("long").alias("n_shingles"), F.col("class_id").alias("component_id"), F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def op11_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM cut)
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM shingle x JOIN shingle y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM shared JOIN size s ON s.doc_id = a JOIN size t ON t.doc_id = b WHERE 100 * m >= 85 * (s.n + t.n - m)
), edge AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other
), least_of AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN least_of USING (doc_id) LEFT JOIN size USING (doc_id)
"""
