"""Operator 12: ranked lexical search by a hierarchical max tree over document ranges, best first.

Terms are the longest runs of ASCII letters, digits and non-ASCII characters, of which only A-Z are lower-cased. A term of
a document has an impact, (10**9 * tf) div (1000 * tf + 20 * m), and a weight, floor(1000 * ln((2N + 2) / (2df + 1))); a
document's score for a query is the sum of weight times impact over the query's different terms.

1. One pass over the texts gives each document's length and its counts of the queries' terms, which are written: a short
   table, from which number, length and document frequencies are summed. Queries of over `vocabulary` different terms
   in all have all terms of all texts written instead.
2. Queries go in blocks of up to `block_terms` different terms (one with more goes alone), as they stream to the driver,
   which holds one block and one partition of them. Each task takes the table in shards of up to `shard` documents and
   builds the tree over each: for each term of the block the greatest impact in each leaf of LEAF documents, in each node
   of ARITY leaves, and so on. For each query it opens nodes in falling order of their summed bounds; a leaf's documents
   are scored exactly. It stops where no node's bound reaches the k-th best score so far; nodes of an equal bound are
   opened, for a tie goes to the smaller id. What a task has found in one shard bounds the next.
3. Each task gives k documents a query; they are merged by hashed parts, then over all.

Terms are told apart by 64-bit hashes, of which two different ones are alike with a chance of about 2**-64 a pair.

Result: the query's id, rank from 1, the document's id and score, for scores above 0. Rows: a null text or one without a
term isn't counted and never found; a query without one has no rows. Documents that repeat an id or a text are ranked
each; equal scores go by ascending id, null ids last. Queries that repeat an id, or have none, are answered each by
itself. Other columns are left aside. Without documents or queries the result is empty.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litforge.llm import _hashing as H
from litforge.llm._io import written

LEAF, ARITY = 32, 16
#: Numbers of the tree's lowest level that a task holds.
CELLS = 1 << 24
POSTINGS = 1 << 22
COUNTED = "id long, n long, terms array<long>, tfs array<int>"


def _counted(vocabulary: np.ndarray | None):
    """Each text's number of terms, and its different terms (of the sorted vocabulary, or all) with their counts."""

    def run(batches):
        for batch in batches:
            data, offsets = H.utf8(batch.column("text"))
            for i, j in H.pieces(offsets):
                words, first = H.words(H.LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i])
                row = np.repeat(np.arange(j - i), np.diff(first))
                if vocabulary is not None:
                    spot = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
                    own = vocabulary[spot] == words
                    words, row = words[own], row[own]
                order = np.lexsort((words, row))
                words, row = words[order], row[order]
                new = np.flatnonzero(np.concatenate(([True], (words[1:] != words[:-1]) | (row[1:] != row[:-1])))) if len(words) else np.zeros(0, dtype=np.int64)
                tfs = np.diff(np.concatenate((new, [len(words)])))
                bounds = pa.array(np.searchsorted(row[new], np.arange(j - i + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, j - i), pa.array(np.diff(first)), pa.ListArray.from_arrays(bounds, pa.array(words[new].view(np.int64))), pa.ListArray.from_arrays(bounds, pa.array(tfs.astype(np.int32)))],
                    names=["id", "n", "terms", "tfs"],
                )

    return run


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """The impact of terms that occur tf times in documents of n terms, among so many documents of so many terms in all."""
    n = n.astype(object) if 50 * int(n.max(initial=0)) * docs >= 1 << 63 else n.astype(np.int64)
    m = (50 + 50 * n * docs // max(1, length)).astype(np.int64)
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class MaxTree:
    """The greatest impacts of each term over ranges of documents, and the documents' postings. Documents are in order of
    their ids; ptr tells where each one's postings begin."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, ptr: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int):
        self.ids, self.known, self.ptr, self.term, self.impact = ids, known, ptr, term, impact
        leaves = -(-len(ids) // LEAF)
        leaf = np.repeat(np.arange(len(ids)) // LEAF, np.diff(ptr))
        level = np.zeros((terms, leaves), dtype=np.int32)
        np.maximum.at(level.reshape(-1), term * leaves + leaf, impact.astype(np.int32))
        self.levels = [level]
        while level.shape[1] > ARITY:
            level = np.maximum.reduceat(level, np.arange(0, level.shape[1], ARITY), axis=1)
            self.levels.append(level)

    def search(self, terms: np.ndarray, weights: np.ndarray, every: np.ndarray, best: list, k: int) -> int:
        """Adds to best, a heap of the k best (score, known, -id) so far. every holds the query's weight of each term of the
        block, else 0. Returns how many leaves were opened."""
        own, opened = [level[terms] for level in self.levels], 0
        top = len(own) - 1
        heap: list[tuple[int, int, int]] = []

        def push(level: int, first: int, last: int) -> None:
            bounds = weights @ own[level][:, first:last].astype(np.int64)
            least = best[0][0] if len(best) == k else 1
            for i in np.flatnonzero(bounds >= max(1, least)).tolist():
                heapq.heappush(heap, (-int(bounds[i]), level, first + i))

        push(top, 0, own[top].shape[1])
        while heap:
            bound, level, node = heapq.heappop(heap)
            if len(best) == k and -bound < best[0][0]:
                break
            if level:
                push(level - 1, node * ARITY, min((node + 1) * ARITY, own[level - 1].shape[1]))
                continue
            opened += 1
            first, last = node * LEAF, min((node + 1) * LEAF, len(self.ids))
            a, b = self.ptr[first], self.ptr[last]
            sums = np.concatenate(([0], np.cumsum(every[self.term[a:b]] * self.impact[a:b])))
            scores = sums[self.ptr[first + 1 : last + 1] - a] - sums[self.ptr[first:last] - a]
            for i in np.flatnonzero(scores >= (best[0][0] if len(best) == k else 1)).tolist():
                entry = (int(scores[i]), int(self.known[first + i]), -int(self.ids[first + i]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return opened


def _shards(batches, terms: np.ndarray, shard: int, docs: int, length: int):
    """Trees over runs of documents that hold some term of the block (sorted hashes)."""
    shard = max(LEAF, min(shard, CELLS // max(1, len(terms)) * LEAF))
    held, rows, postings = [], 0, 0

    def tree():
        ids, known, n, count, term, tf = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((ids, ~known))
        begin = np.concatenate(([0], np.cumsum(count)))
        ptr = np.concatenate(([0], np.cumsum(count[order])))
        at = np.arange(ptr[-1]) - np.repeat(ptr[:-1] - begin[order], count[order])
        n_of = np.repeat(n[order], count[order])
        return MaxTree(ids[order], known[order], ptr, term[at], impacts(tf[at], n_of, docs, length), len(terms))

    for whole in batches:
        for i in range(0, whole.num_rows, LEAF * ARITY):
            batch = whole.slice(i, LEAF * ARITY)
            flat = batch.column("terms").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), batch.column("terms").value_lengths().to_numpy(zero_copy_only=False))
            spot = np.minimum(np.searchsorted(terms, flat), len(terms) - 1)
            own = terms[spot] == flat
            count = np.bincount(row[own], minlength=batch.num_rows)
            some = count > 0
            ids = batch.column("id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            held.append((ids[some], known[some], batch.column("n").to_numpy(zero_copy_only=False)[some], count[some], spot[own], tf[own]))
            rows += int(some.sum())
            postings += int(own.sum())
            if rows >= shard or postings >= POSTINGS:
                yield tree()
                held, rows, postings = [], 0, 0
    if rows:
        yield tree()


def _searched(items: list[tuple[int | None, np.ndarray]], terms: np.ndarray, weights: np.ndarray, k: int, shard: int, docs: int, length: int):
    """items: each query's id and places of its terms among those of the block."""

    def run(batches):
        best: list[list] = [[] for _ in items]
        every = np.zeros(len(terms), dtype=np.int64)
        for tree in _shards(batches, terms, shard, docs, length):
            for (_, own), top in zip(items, best, strict=True):
                if len(own):
                    every[own] = weights[own]
                    tree.search(own, weights[own], every, top, k)
                    every[own] = 0
        rows = [(q, items[q][0], -i if known else None, score) for q, top in enumerate(best) for score, known, i in top]
        for i in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in zip(*rows[i : i + 50_000], strict=True)], names=["query", "query_id", "id", "score"])

    return run


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query: first of each hashed part, then of all."""
    order = [F.desc("score"), F.asc_nulls_last("id")]
    parts = found.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(32)))
    some = parts.withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def _blocks(queries: DataFrame, most: int):
    block, terms = [], set()
    for r in queries.toLocalIterator():
        own = {t % (1 << 64) for t in r["terms"]}
        if block and len(terms | own) > most:
            yield block, terms
            block, terms = [], set()
        block.append((r["id"], own))
        terms |= own
    if block:
        yield block, terms


def search(df: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "item_id", query_col: str = "text", k: int = 50, shard: int = 1 << 16, block_terms: int = 8192, vocabulary: int = 1_000_000) -> DataFrame:
    """query_id_col, rank, id_col and score of the k best documents of each query."""
    spark = df.sparkSession
    asked = written(queries.select(F.col(query_id_col).cast("long").alias("id"), F.col(query_col).alias("text")).mapInArrow(_counted(None), COUNTED).where("n > 0"), "queries")
    some = asked.select(F.explode("terms").alias("t")).distinct().limit(vocabulary + 1).collect()
    known = np.unique(np.array([r["t"] for r in some], dtype=np.int64).view(np.uint64)) if 0 < len(some) <= vocabulary else None
    found = spark.createDataFrame([], "query_id long, rank int, id long, score long")
    if some:
        counted = written(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_counted(known), COUNTED), "terms")
        docs, length = counted.where("n > 0").agg(F.count("*"), F.sum("n")).first()
        frequencies = counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
        tops = []
        for block, own in _blocks(asked, block_terms):
            if len(tops) == 1:  # there are several blocks: count once, and cut the lineage of each
                frequencies, tops[0] = written(frequencies, "frequencies"), written(tops[0], "tops")
            own = np.array(sorted(own), dtype=np.uint64)
            of_block = spark.createDataFrame(pa.table({"t": pa.array(own.view(np.int64))}))
            df_of = {r["t"] % (1 << 64): r["df"] for r in frequencies.join(F.broadcast(of_block), "t").collect()}  # no more rows than the block has terms
            weights = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * df_of[t] + 1))) if t in df_of else 0 for t in own.tolist()], dtype=np.int64)
            items = [(i, np.array([p for p in np.searchsorted(own, np.array(sorted(ts), dtype=np.uint64)).tolist() if weights[p]], dtype=np.int64)) for i, ts in block]
            top = _merged(counted.where(F.size("terms") > 0).mapInArrow(_searched(items, own, weights, k, shard, docs, length or 0), "query long, query_id long, id long, score long"), k).select("query_id", "rank", "id", "score")
            tops.append(written(top, "tops") if tops else top)
        for top in tops:
            found = found.unionByName(top)
    return found.select(F.col("query_id").alias(query_id_col), "rank", F.col("id").alias(id_col), "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(docs, items)


OP12_SQL = r"""
WITH term_of AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents
), asked AS (
  SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)
), size AS (
  SELECT doc_id, count(*) AS n FROM term_of GROUP BY doc_id
), total AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM size
), tf AS (
  SELECT doc_id, t, count(*) AS tf FROM term_of WHERE t IN (SELECT t FROM asked) GROUP BY ALL
), weight AS (
  SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY t, docs
), impact AS (
  SELECT doc_id, t, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // len))) AS i FROM tf JOIN size USING (doc_id), total
), score AS (
  SELECT item_id, doc_id, CAST(sum(w * i) AS BIGINT) AS score FROM asked JOIN weight USING (t) JOIN impact USING (t) GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM score
WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""
