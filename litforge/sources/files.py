"""Readers and writers of the formats that the data come in. Readers give each record its place."""

from __future__ import annotations

import csv
import io
import json

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The columns that the study service is asked for.
FIELDS = ("sample_accession", "secondary_sample_accession", "sample_alias", "sample_title", "description", "scientific_name", "study_accession")


def article_corpus(spark: SparkSession, path: str) -> DataFrame:
    """article_id, pos, name, url, chunks from an object {id: {chunks} | [chunk] | anything}; of repeated ids the last stays."""
    return articles(spark.read.text(path, wholetext=True)).drop("file")


def articles(raw: DataFrame) -> DataFrame:
    """The articles of each document in (file?, value)."""
    raw = raw if "file" in raw.columns else raw.withColumn("file", F.lit(None).cast("string"))
    each = raw.select("file", F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("pos", "e"))
    v = F.try_parse_json("e.value")
    strings = F.coalesce(F.try_variant_get(v, "$.chunks", "array<string>"), F.try_variant_get(v, "$", "array<string>"), F.array(F.col("e.value")))
    return each.select("file", F.col("e.key").alias("article_id"), "pos", F.try_variant_get(v, "$.name", "string").alias("name"), F.try_variant_get(v, "$.url", "string").alias("url"), strings.alias("chunks"))


def paper_list(spark: SparkSession, path: str) -> DataFrame:
    """id, pos, title, text from an array of {id?, name?, chunks?, text?}; chunks win over text, the JSON stands in for neither."""
    return papers(spark.read.text(path, wholetext=True)).drop("file")


def papers(raw: DataFrame) -> DataFrame:
    """The papers of each document in (file?, value): an array of them, or an object {id: paper}; anything else ends the job."""
    raw = raw if "file" in raw.columns else raw.withColumn("file", F.lit(None).cast("string"))
    kind = F.substring(F.ltrim("value"), 1, 1)
    values = F.transform(F.map_entries(F.from_json("value", "map<string,string>")), lambda e: e["value"])
    wrong = F.raise_error(F.lit("neither a list nor an object")).cast("array<string>")
    every = F.when(kind == "[", F.from_json("value", "array<string>")).when(kind == "{", values).otherwise(wrong)
    each = raw.select("file", F.posexplode(every).alias("pos", "e"))
    v = F.try_parse_json("e")
    get = lambda p, t: F.try_variant_get(v, p, t)
    return each.select("file", F.coalesce(get("$.id", "string"), F.concat(F.lit("paper_"), F.col("pos") + 1)).alias("id"), "pos", F.coalesce(get("$.name", "string"), F.lit("Untitled")).alias("title"), F.coalesce(F.array_join(get("$.chunks", "array<string>"), " "), get("$.text", "string"), F.col("e")).alias("text"))


def table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV with all columns as text; quotes are doubled, cells may hold line ends."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', sep=sep, inferSchema=False)


def query(study: str, fields: tuple[str, ...] = FIELDS, form: str = "json") -> dict[str, str]:
    """What the search service is asked: the predicate and the columns go to the source. Its parameters are fixed values."""
    return {"result": "sample", "query": f'study_accession="{study}"', "fields": ",".join(fields), "format": form, "limit": "0"}


def samples(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sample records and failed studies from (study_accession, body, error)."""
    schema = "array<struct<" + ",".join(f"{f}:string" for f in FIELDS) + ">>"
    fine = bodies.where("error is null").select(F.explode(F.from_json("body", schema)).alias("s")).select("s.*")
    return fine, bodies.where("error is not null").select("study_accession", "error")


def tabbed_samples(bodies: DataFrame) -> DataFrame:
    """study_accession, pos and the fields of each line of bodies in tab-separated form, whose first line names the columns;
    a column that isn't there is null."""
    lines = F.filter(F.split("body", "\r?\n"), lambda x: x != "")
    cut = bodies.where("error is null").select("study_accession", F.split(F.get(lines, F.lit(0)), "\t").alias("_names"), F.posexplode(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("pos", "_line"))
    cells = cut.withColumn("_cells", F.split("_line", "\t"))
    field = lambda f: F.get("_cells", F.when(F.array_contains("_names", f), F.array_position("_names", f).cast("int") - 1))
    return cells.select(F.col("study_accession").alias("asked_for"), "pos", *(field(f).alias(f) for f in FIELDS))


def write_groups(df: DataFrame, key: str, path: str) -> None:
    """A folder of JSON lines for each group: the form for many or large groups."""
    df.withColumn("_group", F.col(key)).write.mode("overwrite").partitionBy("_group").json(path)


def write_group_files(df: DataFrame, key: str, path: str, suffix: str = "_metadata.json") -> None:
    """One file <group><suffix> for each group, with its rows as indented JSON of ASCII signs: an object if there is one row,
    else a list. A group is what one task writes; the driver only gives the files their names."""
    spark = df.sparkSession
    own = f"{path}/_writing"
    by_group = df.groupBy(F.col(key).alias("_name")).agg(F.collect_list(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).alias("_rows"))
    by_group.select(F.col("_name").alias("_group"), _indented("_rows").alias("value")).write.mode("overwrite").partitionBy("_group").text(own)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs.Path
    fs = hadoop(own).getFileSystem(conf)
    for folder in fs.listStatus(hadoop(own)):
        name = folder.getPath().getName()
        if name.startswith("_group="):
            for i, part in enumerate(f for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")):
                group = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name[len("_group=") :])
                to = hadoop(f"{path}/{group}{'' if i == 0 else f'_{i}'}{suffix}")
                fs.delete(to, False)
                fs.mkdirs(to.getParent())
                fs.rename(part.getPath(), to)
    fs.delete(hadoop(own), True)


@F.pandas_udf(StringType())
def _indented(rows: pd.Series) -> pd.Series:
    def one(texts):
        values = [json.loads(t) for t in texts]
        return json.dumps(values[0] if len(values) == 1 else values, indent=2)

    return rows.map(one)


def write_file(spark: SparkSession, path: str, lines: DataFrame) -> None:
    """One text file at the path itself, from the rows (text) of a table in its order, which one task writes."""
    own = f"{path}._writing"
    lines.coalesce(1).write.mode("overwrite").text(own)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(own).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(hadoop(own)) if f.getPath().getName().startswith("part-"))
    fs.delete(hadoop(path), True)
    fs.rename(part, hadoop(path))
    fs.delete(hadoop(own), True)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes what is at a path, such as the store of a run that has come to its end."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop(path), True)


def write_conll(sentences: DataFrame, path: str) -> None:
    """Sentences (sent_id, text) in order; files are ranges of sent_id, so that no task holds all."""
    sentences.repartitionByRange("sent_id").sortWithinPartitions("sent_id").select("text").write.mode("overwrite").option("lineSep", "\n\n").text(path)


def if_there(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame | None:
    """What is stored at a path; None if nothing is."""
    try:
        return spark.read.format(form).load(path)
    except AnalysisException as fault:
        if fault.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def wide_rows(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """file, pos, cells of CSVs whose rows differ in length; line ends in cells make one unsplittable, so one task reads a
    file."""
    return wide_rows_of(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"), header)


def wide_rows_of(raw: DataFrame, header: bool = True) -> DataFrame:
    """The rows of each CSV in (file, value)."""

    def run(batches):
        for batch in batches:
            for file, value in zip(batch["file"], batch["value"], strict=True):
                rows = list(csv.reader(io.StringIO(value, newline="")))[1 if header else 0 :]
                yield pd.DataFrame({"file": [file] * len(rows), "pos": range(len(rows)), "cells": rows})

    return raw.select("file", "value").mapInPandas(run, f"file {raw.schema['file'].dataType.simpleString()}, pos long, cells array<string>")


def write_object(rows: DataFrame, key: str, value: str, order: str, path: str) -> None:
    """One file with one JSON object {key: value, ...} in order, indented by two blanks. An object is one file, so one task
    writes it, sorting on disk if need be; `write.json` is the form for large tables."""
    first, last = rows.agg(F.min(order), F.max(order)).first()
    text = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    entry = F.concat(F.when(F.col(order) == first, "{\n  ").otherwise("  "), text(f"CAST(`{key}` AS STRING)"), F.lit(": "), F.coalesce(text(f"`{value}`"), F.lit("null")), F.when(F.col(order) == last, "\n}").otherwise(","))
    lines = rows.select(F.col(order).cast("long").alias("_o"), entry.alias("line"))
    if first is None:
        lines = rows.sparkSession.createDataFrame([(0, "{}")], "_o long, line string")
    write_file(rows.sparkSession, path, lines.repartition(1).sortWithinPartitions("_o").select("line"))


def label_map(labels: DataFrame) -> DataFrame:
    """One row of JSON from (label, id): both directions; the distinct labels of a tag set are few."""
    pairs = F.array_sort(F.collect_list(F.struct("id", "label")))
    to_id = F.map_from_entries(F.transform("p", lambda s: F.struct(s["label"], s["id"])))
    to_label = F.map_from_entries(F.transform("p", lambda s: F.struct(s["id"].cast("string"), s["label"])))
    return labels.agg(pairs.alias("p")).select(F.to_json(F.struct(to_id.alias("label_to_id"), to_label.alias("id_to_label"))).alias("value"))


def write_csv(parts: list[DataFrame], path: str) -> None:
    """One CSV of several tables, with all their columns."""
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more, allowMissingColumns=True)
    whole.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
