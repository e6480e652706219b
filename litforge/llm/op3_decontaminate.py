"""Operator 3: benchmark decontamination by greedy string tiling.

Texts are runs of lower-case words (ASCII letters and digits, and any non-ASCII character). Documents meet benchmark
items by their shared seeds, runs of `minimum` words; an item goes on only if its words under shared seeds reach the
threshold, which no tiling can exceed. Then the item is tiled: the longest matches that overlap nothing marked so far
are found by running Karp-Rabin with falling lengths and marked, until none of `minimum` words is left. The share of
the item's words under tiles is its coverage; order plays no part, so reordered passages count in full.

The benchmark is the stated set that goes out to all documents in blocks of about `block_bytes` of text; documents
are read once a block. With one block they are not shuffled. With several, what a block finds is written, two hashes
and a verdict for each text that covers an item, before the next one is read, so the driver and a task hold one block. A task also holds the hashes of one piece of text (512 KB, or one longer document).

Rows: a null or empty text has no match; items of fewer than `minimum` words take no part; of items that tie in
coverage, the smallest item_id is named; rows that repeat get the same verdict each; other columns stay as they are,
but for those that are named as the verdict's (`prefix` gives the verdict's columns other names).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litforge.llm import _hashing as H
from litforge.llm._io import written

SALTS = 16
NAMES = ("n_items", "item_id", "coverage", "n_tiles")


def _windows(words: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and running hashes of the windows of size words that hold no marked word."""
    if len(words) < size:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    open_words = np.concatenate(([0], np.cumsum(free)))
    at = np.flatnonzero(open_words[size:] - open_words[:-size] == size)
    return at, H.mix(H.Rolling(words).of(at, at + size))


def tile(item: np.ndarray, text: np.ndarray, minimum: int) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in text, length): greedily the longest, none overlapping another in item or text."""
    free_item, free_text = np.ones(len(item), dtype=bool), np.ones(len(text), dtype=bool)
    tiles: list[tuple[int, int, int]] = []
    size = max(minimum, len(item))
    while True:
        at_text, of_text = _windows(text, free_text, size)
        at_item, of_item = _windows(item, free_item, size)
        shared = np.isin(of_text, of_item) if len(of_item) else np.zeros(0, dtype=bool)
        found = []
        if shared.any():
            places: dict[int, list[int]] = {}
            for p, h in zip(at_item.tolist(), of_item.tolist(), strict=True):
                places.setdefault(h, []).append(p)
            for t, h in zip(at_text[shared].tolist(), of_text[shared].tolist(), strict=True):
                for p in places[h]:
                    if (item[p : p + size] != text[t : t + size]).any():
                        continue
                    n = size
                    while p + n < len(item) and t + n < len(text) and free_item[p + n] and free_text[t + n] and item[p + n] == text[t + n]:
                        n += 1
                    found.append((-n, p, t))
        for n, p, t in sorted(found):
            if free_item[p : p - n].all() and free_text[t : t - n].all():
                free_item[p : p - n] = False
                free_text[t : t - n] = False
                tiles.append((p, t, -n))
        if size == minimum:
            # a longer match that lost part of itself to another may have left a rest to tile
            if not found:
                return tiles
            continue
        size = max(minimum, size // 2)


class Benchmark:
    """A block of items, with the seeds of all."""

    def __init__(self, items: list[tuple[int, str]], minimum: int, threshold: float):
        data, offsets = H.utf8(H.lowered(pa.array([t for _, t in items], type=pa.large_string())))
        words, first = H.words(data, offsets)
        self.ids, self.minimum, self.threshold = [i for i, _ in items], minimum, threshold
        self.words = [words[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        seeds, begin = H.shingles(words, first, minimum, short=False)
        owner = np.repeat(np.arange(len(items)), np.diff(begin))
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner, self.place = seeds[order], owner[order], (np.arange(len(seeds)) - begin[owner])[order]

    def verdict(self, words: np.ndarray, seeds: np.ndarray) -> tuple[int, int | None, float, int]:
        """Of one document whose seeds are all shared ones: items over the threshold, and the best one."""
        seeds = np.unique(seeds)
        a, b = np.searchsorted(self.seeds, seeds, side="left"), np.searchsorted(self.seeds, seeds, side="right")
        at = np.repeat(a, b - a) + np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
        count, best = 0, None
        for i in np.unique(self.owner[at]).tolist():
            item = self.words[i]
            under = np.zeros(len(item) + 1, dtype=np.int64)
            place = self.place[at[self.owner[at] == i]]
            under[place] += 1
            np.subtract.at(under, place + self.minimum, 1)
            if (np.cumsum(under)[:-1] > 0).sum() < self.threshold * len(item):
                continue
            tiles = tile(item, words, self.minimum)
            coverage = sum(n for _, _, n in tiles) / len(item)
            if coverage >= self.threshold:
                count += 1
                best = min(best or (0, 0, 0), (-coverage, self.ids[i], len(tiles)))
        return (count, best[1], -best[0], best[2]) if best else (0, None, 0.0, 0)


def _found(benchmark: Benchmark, rest: list[str], text_col: str, names: list[str]):
    def run(batches):
        for batch in batches:
            data, offsets = H.utf8(H.lowered(batch.column(text_col)))
            out = [(0, None, 0.0, 0)] * batch.num_rows
            for i, j in H.pieces(offsets):
                words, first = H.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                seeds, begin = H.shingles(words, first, benchmark.minimum, short=False)
                spot = np.minimum(np.searchsorted(benchmark.seeds, seeds), max(0, len(benchmark.seeds) - 1))
                hits = np.flatnonzero(benchmark.seeds[spot] == seeds) if len(benchmark.seeds) else np.zeros(0, dtype=np.int64)
                row = np.searchsorted(begin, hits, side="right") - 1
                for r in np.unique(row).tolist():
                    out[i + r] = benchmark.verdict(words[first[r] : first[r + 1]], seeds[hits[row == r]])
            n, item, coverage, tiles = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(n, type=pa.int32()), pa.array(item, type=pa.int64()), pa.array(coverage, type=pa.float64()), pa.array(tiles, type=pa.int32())], names=[*rest, *names])

    return run


def contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: list[str] | None = None, minimum: int = 5, threshold: float = 0.5, block_bytes: int = 16 << 20, prefix: str = "") -> DataFrame:
    """The columns keep of df (all but text unless given) with the number of items that the text covers to the threshold
    or more, and the best covered one, its coverage and its number of tiles. One block of items is one pass. Of several,
    each reads the texts and writes the verdicts of those that it finds, by two hashes of the text (of which two
    texts share both with a chance of about 2**-128); the verdicts are merged and joined to the rows, hot texts spread by a salt."""
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    names = [f"{prefix}{n}" for n in NAMES]
    own = [c for c in keep if c.lower() not in {n.lower() for n in names}]
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("item_id is not null and text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    docs = df.select(*own, *([text_col] if text_col not in own else []))
    verdict = list(zip(names, (T.IntegerType(), T.LongType(), T.DoubleType(), T.IntegerType()), strict=True))
    fields = [T.StructField(n, t) for n, t in verdict]
    block = lambda b: Benchmark(sorted((r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()), minimum, threshold)
    if blocks == 1:
        return docs.mapInArrow(_found(block(0), own, text_col, names), T.StructType([*(docs.schema[c] for c in own), *fields]))
    keys = [F.xxhash64(text_col).alias("_h"), F.xxhash64(F.lit(3), text_col).alias("_g")]
    texts = docs.select(*keys, F.col(text_col).alias("_text"))
    hits = None
    for b in range(blocks):
        found = texts.mapInArrow(_found(block(b), ["_h", "_g"], "_text", names), T.StructType([texts.schema["_h"], texts.schema["_g"], *fields]))
        found = written(found.where(F.col(names[0]) > 0).dropDuplicates(["_h", "_g"]), f"verdicts-{b}")
        hits = found if hits is None else hits.unionByName(found)
    n, item, coverage, tiles = names
    best = hits.groupBy("_h", "_g").agg(F.sum(n).cast("int").alias("_n"), F.min_by(F.struct(item, coverage, tiles), F.struct(-F.col(coverage), F.col(item))).alias("_best"))
    spread = best.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # the columns travel as one, so that none of them meets a name that is used here
    rows = docs.select(F.struct(*own).alias("_row"), *keys, F.pmod(F.xxhash64(F.lit(5), F.monotonically_increasing_id()), F.lit(SALTS)).cast("int").alias("_salt"))
    joined = rows.join(spread, ["_h", "_g", "_salt"], "left")
    values = [F.coalesce("_n", F.lit(0)).cast("int").alias(n), F.col("_best")[item].alias(item), F.coalesce(F.col("_best")[coverage], F.lit(0.0)).alias(coverage), F.coalesce(F.col("_best")[tiles], F.lit(0)).cast("int").alias(tiles)]
    return joined.select("_row.*", *values)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = contaminated(docs, items, keep=["doc_id"])
    return found.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), "n_items", "item_id", "coverage", "n_tiles")
