"""Operator 13: dominance counting. Each row has a slot (its place in order), a level and a weight; a row is above another
if its slot is smaller or equal and its level strictly larger. The result is, for each row, how many rows are above it and
what they weigh.

Rows of one slot and level are one cell, summed before the shuffle. In the order of slots, within a slot from the highest
level down, what is above a cell lies before it; among ranks by level, within a level by slot, it has a higher rank. So a
cell asks for the weight of the ranks greater than its own in a prefix of the slot order, and all positions and ranks are
different. A weighted wavelet matrix answers that: a bit plane for each bit of the ranks, from the highest down, and for
each plane prefix sums of the cells whose bit is one. It is dealt out over shards:

1. By slot: cells are cut in slot order into `shards` ranges, which may cut through a slot. Each shard builds its matrix
   and answers its cells' prefixes within itself.
2. Below the upper planes, the cells of a range of ranks are together and still in slot order. Such a range, or chunk, is a
   shard too: each cell is routed to the chunk of its own rank, which answers for the slot shards before its own.
3. The upper planes are the prefix sums over slot shards of each chunk's weight, `shards` for each chunk: summed over the
   higher chunks they answer for the rest.

A shard is a task: it holds a `shards`-th of the cells in arrays, and no task, the driver or broadcast gets more. Both
cuts are Spark's range partitioning, which looks at a bounded sample of each partition. The table of upper planes has the
square of `shards` rows, whatever the input; its windows run over a chunk or a shard at a time. Rows get their cell's answer
by a join in which a cell that many rows share is split by a hash of the rows' columns.

Rows: a null slot or level makes a row above none, and its own counts null. A null weight counts as 0. Rows that repeat
count each and get the same counts. An empty table gives an empty table. The columns of df come through, whatever their
names; `n_above` and `w_above` replace columns of these names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litforge.llm._io import written

SALTS = 64
CELL = "slot long, level long, n long, w long, shard int, n_above long, w_above long"


class WaveletMatrix:
    """Ranks in an order of positions, with weights: how much weight a prefix has at ranks greater than a given one."""

    def __init__(self, ranks: np.ndarray, weights: list[np.ndarray]):
        self.n = len(ranks)
        self.planes = []
        for k in range(max(1, int(ranks.max()).bit_length() if self.n else 1) - 1, -1, -1):
            ones = (ranks >> k) & 1
            zeros = np.concatenate(([0], np.cumsum(1 - ones)))
            sums = [np.concatenate(([0], np.cumsum(w * ones))) for w in weights]
            self.planes.append((k, zeros, sums))
            order = np.argsort(ones, kind="stable")
            ranks, weights = ranks[order], [w[order] for w in weights]

    def above(self, prefix: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
        """For each query, each weight's sum over the positions before prefix whose rank is greater than rank."""
        low, high = np.zeros(len(prefix), dtype=np.int64), prefix.astype(np.int64)
        found = [np.zeros(len(prefix), dtype=np.int64) for _ in self.planes[0][2]]
        for k, zeros, sums in self.planes:
            one = ((rank >> k) & 1).astype(bool)
            for out, s in zip(found, sums, strict=True):
                out += np.where(one, 0, s[high] - s[low])
            low, high = (np.where(one, zeros[-1] + x - zeros[x], zeros[x]) for x in (low, high))
        return found


def _cells(batches) -> dict[str, np.ndarray]:
    """All rows of a partition, in slot order."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return {}
    table = pa.Table.from_batches(found).combine_chunks()
    cells = {c: table.column(c).to_numpy() for c in table.column_names}
    order = np.lexsort((-cells["level"], cells["slot"]))
    return {c: x[order] for c, x in cells.items()}


def _ranks(cells: dict[str, np.ndarray]) -> np.ndarray:
    ranks = np.empty(len(cells["slot"]), dtype=np.int64)
    ranks[np.lexsort((cells["slot"], cells["level"]))] = np.arange(len(ranks))
    return ranks


def _given(cells: dict[str, np.ndarray], extra: dict[str, np.ndarray], rows: int = 100_000):
    columns = cells | extra
    for i in range(0, len(cells["slot"]), rows):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + rows]) for x in columns.values()], names=list(columns))


def _within(batches):
    """A shard of slots: what is above each cell within it."""
    cells = _cells(batches)
    if cells:
        ranks = _ranks(cells)
        n, w = WaveletMatrix(ranks, [cells["n"], cells["w"]]).above(np.arange(len(ranks)), ranks)
        yield from _given(cells, {"shard": np.full(len(ranks), TaskContext.get().partitionId(), dtype=np.int32), "n_above": n, "w_above": w})


def _before(batches):
    """A chunk of ranks: what is above each cell in the slot shards before its own."""
    cells = _cells(batches)
    if cells:
        ranks, shard = _ranks(cells), cells["shard"]
        n, w = WaveletMatrix(ranks, [cells["n"], cells["w"]]).above(np.searchsorted(shard, shard), ranks)
        chunk = np.full(len(ranks), TaskContext.get().partitionId(), dtype=np.int32)
        yield from _given(cells | {"n_above": cells["n_above"] + n, "w_above": cells["w_above"] + w}, {"chunk": chunk})


def _upper(cells: DataFrame) -> DataFrame:
    """shard, chunk, n_upper, w_upper: what lies in earlier shards at higher chunks."""
    grid = cells.groupBy("chunk", "shard").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    last = grid.agg(F.max("shard")).first()[0] or 0
    every = grid.select("chunk").distinct().select("chunk", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("shard"))
    whole = every.join(grid, ["chunk", "shard"], "left").fillna(0, ["n", "w"])
    earlier = Window.partitionBy("chunk").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    higher = Window.partitionBy("shard").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda names, over: [F.coalesce(F.sum(c).over(over), F.lit(0)).alias(a) for c, a in names]
    return whole.select("chunk", "shard", *sums((("n", "n"), ("w", "w")), earlier)).select("chunk", "shard", *sums((("n", "n_upper"), ("w", "w_upper")), higher))


def _answers(cells: DataFrame, shards: int) -> DataFrame:
    """slot, level, n_above, w_above of cells (slot, level, n, w), of which each slot and level has one."""
    by_slot = cells.repartitionByRange(shards, F.asc("slot"), F.desc("level")).mapInArrow(_within, CELL)
    by_rank = written(by_slot, "slot-shards").repartitionByRange(shards, F.asc("level"), F.asc("slot")).mapInArrow(_before, CELL + ", chunk int")
    routed = written(by_rank, "rank-chunks")
    found = routed.join(_upper(routed), ["chunk", "shard"])
    return found.select("slot", "level", (F.col("n_above") + F.col("n_upper")).alias("n_above"), (F.col("w_above") + F.col("w_upper")).alias("w_above"))


def _hashable(field: T.StructField) -> bool:
    return not any(x in field.dataType.simpleString() for x in ("map<", "variant"))


def dominance(df: DataFrame, slot: Column, level: Column, weight: Column, shards: int | None = None) -> DataFrame:
    """df with n_above and w_above: how many rows are above each row, and the sum of their weights. slot, level and weight
    are whole numbers. shards is the session's number of shuffle partitions unless given; a task holds that share of the
    different pairs of slot and level."""
    shards = shards or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = [F.col(f"`{f.name}`") for f in df.schema if f.name.lower() not in ("n_above", "w_above")]
    split = F.pmod(F.xxhash64(F.lit(13), *(F.col(f"`{f.name}`") for f in df.schema if _hashable(f))), F.lit(SALTS)).cast("int")
    rows = df.select(F.struct(*kept).alias("row"), slot.cast("long").alias("slot"), level.cast("long").alias("level"), F.coalesce(weight.cast("long"), F.lit(0)).alias("w"), split.alias("salt"))
    parts = rows.where("slot is not null and level is not null").groupBy("slot", "level", "salt").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    cells = parts.groupBy("slot", "level").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    answers = parts.select("slot", "level", "salt").join(_answers(cells, shards), ["slot", "level"])
    return rows.join(answers, ["slot", "level", "salt"], "left").select("row.*", "n_above", "w_above")


def slot_of(df: DataFrame, column: str) -> Column:
    """Days since 1970 of a time, which counts as UTC where it has no zone."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.unix_date(F.col(column).cast("date")).cast("long")
    return F.floor(F.unix_seconds(F.col(column).cast("timestamp")) / F.lit(86_400))


def op13_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = spark.read.parquet(f"{sf_dir}/sales.parquet")
    level = F.floor(F.floor(F.lit(100.0) * F.col("total") + F.lit(0.5)) / F.lit(1000.0))
    weight = 1 + F.crc32(F.col("sale_id").cast("string")) % 3
    placed = sales.select("sale_id", slot_of(sales, "sold_at").alias("slot"), level.alias("level"), weight.alias("weight"))
    found = dominance(placed, F.col("slot"), F.col("level"), F.col("weight"))
    return found.select("sale_id", "slot", "level", F.col("n_above").alias("n_sales"), F.col("w_above").alias("n_rows"))


OP13_SQL = """
WITH table_of AS (
  SELECT list(list_reduce(list_prepend(v, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY v) AS t
  FROM (SELECT unnest(range(256)) AS v)
), sale AS (
  SELECT sale_id, CAST(floor(floor(epoch(sold_at)) / 86400) AS BIGINT) AS slot, CAST(floor(floor(100 * total + 0.5) / 1000) AS BIGINT) AS level,
    1 + xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 AS weight
  FROM sales, table_of
), cell AS (
  SELECT slot, level, count(*) AS n, sum(weight) AS w FROM sale WHERE slot IS NOT NULL AND level IS NOT NULL GROUP BY ALL
), above AS (
  SELECT x.slot, x.level, sum(y.n) AS n_sales, sum(y.w) AS n_rows FROM cell x JOIN cell y ON y.slot <= x.slot AND y.level > x.level GROUP BY ALL
)
SELECT sale_id, s.slot, s.level, CAST(CASE WHEN s.slot IS NOT NULL AND s.level IS NOT NULL THEN coalesce(n_sales, 0) END AS BIGINT) AS n_sales,
  CAST(CASE WHEN s.slot IS NOT NULL AND s.level IS NOT NULL THEN coalesce(n_rows, 0) END AS BIGINT) AS n_rows
FROM sale s LEFT JOIN above a ON s.slot = a.slot AND s.level = a.level
"""
