"""Tables between the steps of an operator."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where it is unset and all run in one process,
    the session's warehouse stands in; on a cluster there is no telling whether that is shared, so it is a fault."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: a lost executor costs no recomputing of what is before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/litforge/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _made:
        atexit.register(clean)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many tables there are; drop_since(mark()) takes out those that are made from then on."""
    return len(_made)


def drop_since(place: int, but: int = 0) -> None:
    """Deletes the tables made since a mark, but for the last few; nothing may read the deleted ones any more."""
    end = len(_made) - but
    for spark, path in _made[place:end]:
        _delete(spark, path)
    del _made[place:end]


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffles, broadcasts and plans of steps that are done: it learns of them only when the
    driver's memory is collected, which else waits until the heap is full."""
    spark._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def clean() -> None:
    """Deletes the tables that written() made; results that still read them can't be read any more."""
    while _made:
        spark, path = _made.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: whoever owns the folder cleans it
            return


def collected_bounded(df: DataFrame, rows: int, what: str) -> list:
    """The rows of a table that is proven to have no more than that many."""
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"{what} has over {rows} rows")
    return found
