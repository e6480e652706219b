"""Operator 8: exact top-k search by MaxScore over the dimensions of integer vectors.

A query's terms are its non-zero dimensions. In each shard a term's contribution lies between two bounds; shifted by
the lower one it is at least 0 and at most the term's span. Terms go by falling span: those at the end whose spans
together can't lift a vector over the k-th best score so far are non-essential. Essential terms are summed over all
vectors of a block, the others are probed, a few at a time, only for vectors that can still reach that score; ties are
never dropped by a bound. Shards keep k + 1 hits for each query, and the hits are merged by score and id.

Queries go out in blocks of `block` rows, so what a task and the driver hold is bounded; candidates stream past each
block in Arrow batches, without a shuffle. Vectors are quantised in doubles, which hold floor(scale * x) exactly. Sums
are made in doubles or 64-bit integers where these hold them exactly, and in Python's integers for other vectors.

Rows: vectors that are null, or hold a null or a non-finite component, take no part, nor do rows without an id. Every
other row counts, also one that repeats another: a query meets all candidates but one row equal to it in id and vector,
its own. A shorter vector counts as filled up with zeros; an empty one scores 0. Scores beyond 64 bits are ranked as
they are and shown as the nearest 64-bit integer. Other columns are left aside.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litforge.llm._io import written

#: query: number of the query within its block; over: orders the scores that score itself can't hold.
HITS = "query_id long, block int, query int, vec_id long, score long, over string, own boolean"
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def fine(column: Column | str) -> Column:
    """Whether a vector takes part."""
    return F.forall(column, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(math.inf), F.lit(False)))


def _matrix(column, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of Arrow lists of doubles, as doubles; of Python's integers where scale * x is no double."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        whole = np.floor(flat * scale)
    if not np.isfinite(whole).all():
        whole = np.array([int(w) if math.isfinite(w) else int(x) * scale for w, x in zip(whole, flat)], dtype=object)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))), dtype=whole.dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = whole
    return out


def _tiers(x: np.ndarray) -> np.ndarray:
    """Of each row, how its products are summed: 0 in doubles, 1 in 64-bit integers, 2 in Python's integers."""
    width = 4 * max(1, x.shape[1])
    top = np.abs(x).max(axis=1, initial=0)
    return (top >= math.isqrt((1 << 53) // width)).astype(int) + (top >= math.isqrt((1 << 62) // width)).astype(int)


def _as(x: np.ndarray, tier: int) -> np.ndarray:
    if tier < 2:
        return x.astype((np.float64, np.int64)[tier])
    return np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)


def _best(ids: np.ndarray, scores: np.ndarray, own: np.ndarray, k: int):
    """The k best hits by falling score, then rising id. Scores are 64-bit integers, or Python's if one needs it."""
    if scores.dtype == object:
        order = np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)
    else:
        order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order], own[order]


NONE = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool))


def max_score(query: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray, bar: int | None):
    """Rows and scores of those of a block x, whose columns lie between low and high, that reach the bar (None: all)."""
    a, b = query * low, query * high
    floor, span = np.minimum(a, b), np.abs(b - a)
    order = np.argsort(-span, kind="stable")
    order = order[query[order] != 0]
    rest = np.concatenate((np.cumsum(span[order][::-1])[::-1], [0]))
    base = floor[order].sum()
    need = None if bar is None else bar - base
    essential = len(order) if need is None or not (rest < need).any() else int(np.argmax(rest < need))
    terms, part = order[:essential], np.zeros_like(query)
    part[terms] = query[terms]  # whole rows by a masked query are faster than a copy of the terms' columns
    sums = x @ part - floor[terms].sum()
    rows = np.arange(len(x))
    for i in range(essential, len(order), 8):
        alive = sums + rest[i] >= need
        rows, sums = rows[alive], sums[alive]
        if not len(rows):
            break
        some = order[i : i + 8]
        sums = sums + x[np.ix_(rows, some)] @ query[some] - floor[some].sum()
    if need is not None:
        reach = sums >= need
        rows, sums = rows[reach], sums[reach]
    return rows, sums + base


def _searched(block: int, owners: np.ndarray, table: np.ndarray, k: int, scale: int, rows: int = 8192):
    """Shards' hits for a block of queries (quantised rows of table)."""
    tiers, known = _tiers(table).tolist(), {}

    def asked(n: int, tier: int, width: int) -> np.ndarray:
        if (n, tier, width) not in known:
            q = _as(table[n : n + 1], tier)[0]
            known[n, tier, width] = np.concatenate((q, np.zeros(width - len(q), dtype=q.dtype)))
        return known[n, tier, width]

    def searched(ids: np.ndarray, x: np.ndarray, tier: int, best: list) -> None:
        """Takes in candidates that are summed alike."""
        cast = {}
        for n, owner in enumerate(owners.tolist()):
            t = max(tier, tiers[n])
            if t not in cast:
                y = _as(x, t)
                cast[t] = y, y.min(axis=0), y.max(axis=0)
            have, (y, low, high) = best[n], cast[t]
            q = asked(n, t, y.shape[1])
            bar = int(have[1][-1]) if len(have[0]) > k else None
            if bar is not None and t < 2 and abs(bar) >= 1 << (52, 62)[t]:
                if bar > 0:  # no such sum reaches it
                    continue
                bar = None  # all of them do
            at, scores = max_score(q, y, low, high, bar)
            if not len(at):
                continue
            found = ids[at]
            own = found == owner
            own[own] = (y[at[own]] == q).all(axis=1)
            scores = scores.astype(np.int64) if t < 2 else scores
            if scores.dtype != have[1].dtype:
                scores = np.array([*map(int, have[1]), *map(int, scores)], dtype=object)
            else:
                scores = np.concatenate((have[1], scores))
            best[n] = _best(np.concatenate((have[0], found)), scores, np.concatenate((have[2], own)), k + 1)

    def run(batches):
        best = [NONE] * len(owners)
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                cut = batch.slice(i, rows)
                ids, x = cut.column("vec_id").to_numpy(zero_copy_only=False), _matrix(cut.column("v"), table.shape[1], scale)
                of = _tiers(x)
                for tier in np.unique(of).tolist():
                    searched(ids[of == tier], x[of == tier], tier, best)
        n = [len(b[0]) for b in best]
        if sum(n):
            scores = [int(s) for b in best for s in b[1]]
            number = np.repeat(np.arange(len(owners)), n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(owners[number]), pa.array(np.full(len(number), block, dtype=np.int32)), pa.array(number.astype(np.int32)), pa.array(np.concatenate([b[0] for b in best])), pa.array([min(max(s, LOW), HIGH) for s in scores], type=pa.int64()), pa.array(list(map(_over, scores))), pa.array(np.concatenate([b[2] for b in best]))],
                names=["query_id", "block", "query", "vec_id", "score", "over", "own"],
            )

    return run


def _over(score: int) -> str:
    """Text in the order of the scores that score itself can't hold."""
    if LOW <= score <= HIGH:
        return "5"
    digits = str(abs(score))
    text = f"{len(digits):04d}{digits}"
    return f"9{text}" if score > 0 else "1" + "".join(str(9 - int(c)) for c in text)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query's quantised vector, ties to smaller ids."""
    prepared = lambda df: df.where(fine(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    asked, against = prepared(queries), prepared(candidates)
    blocks = max(1, -(-asked.count() // block))
    hits = None
    for b in range(blocks):
        # rows that repeat each other land in one block, where each has a number of its own
        rows = asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == b).toArrow().combine_chunks()
        if rows.num_rows:
            owners, v = rows.column("vec_id").to_numpy(), rows.column("v").combine_chunks()
            found = against.mapInArrow(_searched(b, owners, _matrix(v, 0, scale), k, scale), HITS)
            found = written(found, "hits") if blocks > 1 else found  # the driver holds one block of queries at a time
            hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = queries.sparkSession.createDataFrame([], HITS)
    order = [F.col("score").desc(), F.col("over").desc(), F.col("vec_id")]
    by = Window.partitionBy("query_id", "block", "query")
    rest = hits.withColumn("r", F.row_number().over(by.orderBy(*order))).where(F.col("r") <= k + 1)
    first = F.row_number().over(Window.partitionBy("query_id", "block", "query", "own").orderBy("r"))
    rest = rest.withColumn("nth", first).where(~F.col("own") | (F.col("nth") > 1))  # without its own row
    return rest.withColumn("rank", F.row_number().over(by.orderBy("r"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors.where("vec_id % 100 = 0"), vectors)


OP8_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.place, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.place <> c.place WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
