"""Operator 9: token counts by section, attributed through offsets.

A document is encoded once, as a whole; the tokens' byte lengths add up to their spans, which are joined as intervals to
the sections' spans (both are sorted, so a binary search for each token). A token that crosses a boundary is allocated
by the rule:

- `first`: to the section of its first byte (counts are whole numbers);
- `last`: to that of its last byte;
- `split`: to every section by its share of the token's bytes (counts are fractions).

Sections are lines, each with its line end, or given as a column of array<struct<start, end>> in code points, sorted
and disjoint; tokens in no section count under section -1, if there are any. One pass without a shuffle; a task holds
one document's tokens at a time besides its Arrow batch.

Rows: a null or empty text has one section of no tokens; rows that repeat are counted each; other columns are left
aside. The vocabulary (a file of base64 tokens and ranks) must lie at `vocabulary` on every executor.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("first", "last", "split")
_loaded: dict = {}


def encoder(vocabulary: str = VOCABULARY):
    """The encoding and the byte length of each token, loaded once a process."""
    if vocabulary not in _loaded:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _loaded[vocabulary] = tiktoken.Encoding("litforge", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes
    return _loaded[vocabulary]


def attribute(starts: np.ndarray, ends: np.ndarray, begin: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Tokens [starts, ends) to sections [begin, end): counts, tokens that cross a section's bounds, and what lies in none."""
    n = len(begin)
    if not len(starts) or not n:
        return np.zeros(n), np.zeros(n, dtype=np.int64), float(len(starts))
    by = starts if rule != "last" else ends - 1
    at = np.searchsorted(begin, by, side="right") - 1
    own = (at >= 0) & (by < end[np.maximum(at, 0)])
    crosses = own & ((starts < begin[np.maximum(at, 0)]) | (ends > end[np.maximum(at, 0)]))
    crossing = np.bincount(at[crosses], minlength=n)
    if rule != "split":
        return np.bincount(at[own], minlength=n).astype(float), crossing, float((~own).sum())
    # the running number of tokens at any byte, whole and in part
    edges, total = np.concatenate((starts, ends[-1:])), np.arange(len(starts) + 1, dtype=float)
    counts = np.interp(end, edges, total) - np.interp(begin, edges, total)
    return counts, crossing, max(0.0, len(starts) - float(counts.sum()))


def _byte_bounds(raw: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Byte offsets of code points."""
    leads = np.concatenate((np.flatnonzero((raw & 0xC0) != 0x80), [len(raw)]))
    return leads[np.minimum(points, len(leads) - 1)]


def _counted(rule: str, vocabulary: str, given: bool):
    def run(batches):
        encoding, sizes = encoder(vocabulary)
        for batch in batches:
            rows, names = [], []
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py() or ""
                raw = np.frombuffer(text.encode(), dtype=np.uint8)
                ends = np.cumsum(sizes[encoding.encode_to_numpy(text)]) if text else np.zeros(0, dtype=np.int64)
                starts = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else ends
                if given:
                    spans = batch.column("sections")[i].as_py() or []
                    points = np.array([[s["start"], s["end"]] for s in spans], dtype=np.int64).reshape(-1, 2)
                    begin, end = _byte_bounds(raw, points[:, 0]), _byte_bounds(raw, points[:, 1])
                else:
                    breaks = np.flatnonzero(raw == 10) + 1
                    begin = np.concatenate(([0], breaks[breaks < len(raw)])).astype(np.int64)
                    end = np.concatenate((begin[1:], [len(raw)]))
                    inner = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                    points = np.stack((inner[begin], inner[end]), axis=1)
                counts, crossing, outside = attribute(starts, ends, begin, end, rule)
                section = np.arange(len(counts))
                if outside > 1e-9:
                    section, counts, crossing, points = np.append(section, -1), np.append(counts, outside), np.append(crossing, 0), np.vstack((points, [[0, 0]]))
                rows.append((section, points, counts, crossing))
                names.append(np.full(len(section), i))
            if names:
                section, points, counts, crossing = (np.concatenate(x) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(np.concatenate(names))), pa.array(section.astype(np.int32)), pa.array(points[:, 0]), pa.array(points[:, 1]), pa.array(np.round(counts, 9)), pa.array(crossing.astype(np.int32))], names=["id", "section", "start", "end", "n_tokens", "n_crossing"])

    return run


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, rule: str = "first", vocabulary: str = VOCABULARY) -> DataFrame:
    """A row for each section of each row of df: id, section (from 0), start, end, n_tokens, n_crossing."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    columns = [F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.col(sections_col).alias("sections")] if sections_col else [])]
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(*columns).mapInArrow(_counted(rule, vocabulary, bool(sections_col)), f"id {kind}, section int, start long, end long, n_tokens double, n_crossing int").withColumnRenamed("id", id_col)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("n_tokens", F.col("n_tokens").cast("long"))
