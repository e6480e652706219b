"""Nearest vectors by an inverted file: cells around centroids, of which a query looks into a few.

The centroids are fitted by k-means (cosine) on a sample of at most `sample` vectors, the ones of least hash, on the
driver; every vector is assigned to the cell of its nearest centroid. A query is sent to its `probes` nearest cells: as
many as `asks` vectors of the sample need to find a share `recall` of their k nearest of the sample, which lie farther off
than those of the whole table. Vectors without clusters need many: then the index saves little, and loses nothing. Cells
are cut into slices of about `slice_rows` vectors, so a crowded cell is searched by several tasks; a task holds one
slice, past which the queries of its cell stream. Cosines are exact, so what is found is ranked exactly; a neighbour in a
cell that isn't looked into is missed. One shuffle of the vectors, one of the queries' hits, for any number of queries.

Rows: vectors that are null, empty or all zero, or hold a null or non-finite component, take no part, nor do null ids.
Equal cosines go by smaller id. Rows that repeat an id are found each; a query doesn't find rows of its own id.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _units(column) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v of the vectors that take part."""
    fine = lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))
    whole = F.forall(vector_col, fine) & F.exists(vector_col, lambda x: x != 0)
    return df.where(whole & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


class Cells(NamedTuple):
    centroids: np.ndarray
    probes: int


def fit(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cells: int = 64, sample: int = 20_000, rounds: int = 20, k: int = 10, recall: float = 0.95, asks: int = 500) -> Cells:
    """At most `cells` centroids, unit vectors, and how many cells a query looks into."""
    some = usable(df, id_col, vector_col).orderBy(F.xxhash64(F.lit(9), "id"), "id").limit(sample).toArrow()
    if not some.num_rows:
        return Cells(np.zeros((0, 1)), 0)
    x = _units(some.column("v").combine_chunks())
    rng = np.random.default_rng(9)
    c = np.unique(x[rng.permutation(len(x))[:cells]], axis=0)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        new = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
        if np.allclose(new, c):
            break
        c = new
    own = (x @ c.T).argmax(axis=1)
    asked = x[:asks] @ x.T
    asked[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near = np.argsort(-asked, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-(x[:asks] @ c.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1 if len(needed) else len(c)
    return Cells(c, probes)


def _celled(c: np.ndarray, probes: int):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                near = _units(part.column("v")) @ c.T
                best = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.ListArray.from_arrays(pa.array((np.arange(len(best) + 1) * best.shape[1]).astype(np.int32)), pa.array(best.ravel().astype(np.int32)))], names=["id", "v", "cells"])

    return run


def assigned(df: DataFrame, cells: Cells, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, v, cell of every vector that takes part: the index, which may be stored, by cell or not."""
    return usable(df, id_col, vector_col).mapInArrow(_celled(cells.centroids, 1), "id long, v array<double>, cells array<int>").select("id", "v", F.col("cells")[0].alias("cell"))


def _met(k: int):
    """Searches each slice; rows come sorted by cell and slice, a slice's vectors before its queries."""

    def run(batches):
        held, ids, vectors, at = [], None, None, None
        for whole in batches:
            key = np.stack([whole.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "slice", "asks")], axis=1)
            cuts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)])) if len(key) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = whole.slice(a, b - a)
                if at != tuple(key[a][:2]):
                    held, vectors, at = [], None, tuple(key[a][:2])
                if not key[a][2]:
                    held.append(part)
                    continue
                if vectors is None and held:
                    table = pa.Table.from_batches(held).combine_chunks()
                    ids, vectors = table.column("id").to_numpy(), _units(table.column("v").combine_chunks())
                    order = np.argsort(ids, kind="stable")
                    ids, vectors = ids[order], vectors[order]
                if not held:
                    continue
                for i in range(0, part.num_rows, 512):
                    asked = part.slice(i, 512)
                    q = asked.column("id").to_numpy()
                    near = np.round(_units(asked.column("v")) @ vectors.T, 6) + 0.0
                    near[q[:, None] == ids[None, :]] = -np.inf
                    best = np.argsort(-near, axis=1, kind="stable")[:, :k]
                    row = np.repeat(np.arange(len(q)), best.shape[1])
                    found = near[row, best.ravel()]
                    some = np.isfinite(found)
                    yield pa.RecordBatch.from_arrays([pa.array(q[row][some]), pa.array(ids[best.ravel()][some]), pa.array(found[some])], names=["query_id", "vec_id", "similarity"])

    return run


def search(queries: DataFrame, index: DataFrame, cells: Cells, k: int = 10, slice_rows: int = 20_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, vec_id, similarity (cosine to 6 places), r: the k nearest vectors that the probed cells hold."""
    spark = queries.sparkSession
    none = spark.createDataFrame([], "query_id long, vec_id long, similarity double, r int")
    if not cells.probes:
        return none
    counts = index.groupBy("cell").agg(F.ceil(F.count("*") / slice_rows).cast("int").alias("slices")).collect()  # a row for each centroid
    if not counts:
        return none
    slices = F.broadcast(spark.createDataFrame(counts, "cell int, slices int"))
    own = index.join(slices, "cell").select("id", "v", "cell", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"), F.lit(0).alias("asks"))
    asked = usable(queries, id_col, vector_col).mapInArrow(_celled(*cells), "id long, v array<double>, cells array<int>").select("id", "v", F.explode("cells").alias("cell"))
    sent = asked.join(slices, "cell").select("id", "v", "cell", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(1).alias("asks"))
    hits = own.unionByName(sent).repartition("cell", "slice").sortWithinPartitions("cell", "slice", "asks").mapInArrow(_met(k), "query_id long, vec_id long, similarity double")
    by = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return hits.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k)
