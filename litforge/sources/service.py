"""A study service as a data source: a partition a study, the predicate on the study sent to the service, faults as rows.

`register(spark, fetch)` names the source for a function fetch(params) -> body; `http(url)` is such a function over a
service, `folder(path)` one over files, for work without a network."""

from __future__ import annotations

import os
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from litforge.sources.files import FIELDS, query

SCHEMA = "study_accession string, body string, error string"


def folder(path: str) -> Callable[[dict[str, str]], str]:
    """Bodies from files <study>.json in a folder that all executors see."""

    def fetch(params: dict[str, str]) -> str:
        study = params["query"].split('"')[1]
        with open(os.path.join(path, f"{study}.json"), encoding="utf-8") as f:
            return f.read()

    return fetch


def http(url: str, timeout: float = 30.0) -> Callable[[dict[str, str]], str]:
    """Bodies from a search service: the parameters go into the address; an answer beyond 2xx is a fault."""

    def fetch(params: dict[str, str]) -> str:
        with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(params)}", timeout=timeout) as said:
            return said.read().decode(said.headers.get_content_charset() or "utf-8")

    return fetch


class Study(InputPartition):
    def __init__(self, code: str):
        self.code = code


class Reader(DataSourceReader):
    def __init__(self, codes: list[str], fetch: Callable[[dict[str, str]], str], fields: tuple[str, ...]):
        self.codes, self.fetch, self.fields = codes, fetch, fields

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("study_accession",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.codes = [c for c in self.codes if c in wanted]
            else:
                yield f

    def partitions(self) -> list[Study]:
        return [Study(c) for c in self.codes]

    def read(self, partition: Study):
        if not isinstance(partition, Study):  # no study is asked for
            return
        try:
            yield partition.code, self.fetch(query(partition.code, self.fields)), None
        except Exception as fault:
            yield partition.code, None, f"{type(fault).__name__}: {fault}"


def register(spark: SparkSession, fetch: Callable[[dict[str, str]], str], name: str = "studies") -> str:
    """Options of the source: `studies`, comma-joined codes (repeated codes are asked for again), and `fields`."""

    class Studies(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> Reader:
            codes = [c.strip() for c in self.options.get("studies", "").split(",") if c.strip()]
            return Reader(codes, fetch, tuple(self.options.get("fields", ",".join(FIELDS)).split(",")))

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # a reader that takes predicates needs it
    spark.dataSource.register(Studies)
    return name
