"""A Python data source for paged APIs: each page is an input partition, records are JSON text.

    spark.dataSource.register(PagedSource)
    spark.read.format("paged").option("fetch", "package.module:function").option("endpoint", "resources").load()

The function takes (endpoint, page, page_size) and returns (records, last_page). A failing page ends
the scan there, as far as results go, and says so: `complete` is false from that page on."""

from __future__ import annotations

import importlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerloom.lineage import cut


class Page(InputPartition):
    def __init__(self, number: int, last: int):
        self.number, self.last = number, last


def fetcher(name: str):
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.name, self.endpoint = options["fetch"], options.get("endpoint", "")
        self.size, self.strict = int(options.get("page_size", "100")), options.get("mode", "FAILFAST").upper() == "FAILFAST"

    def partitions(self):
        _, last = fetcher(self.name)(self.endpoint, 1, self.size)
        return [Page(k, last) for k in range(1, max(1, last) + 1)]

    def read(self, partition):
        try:
            records, _ = fetcher(self.name)(self.endpoint, partition.number, self.size)
        except Exception:
            if self.strict:
                raise
            yield (partition.number, None, False)
            return
        for r in records:
            yield (partition.number, json.dumps(r, ensure_ascii=False), True)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, record string, complete boolean"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def read_pages(spark: SparkSession, fetch: str, endpoint: str, page_size: int = 100, strict: bool = False) -> tuple[DataFrame, bool]:
    """Records up to the first failing page, and whether there was none. Every page is fetched once."""
    spark.dataSource.register(PagedSource)
    rows = spark.read.format("paged").option("fetch", fetch).option("endpoint", endpoint).option("page_size", str(page_size)).option("mode", "FAILFAST" if strict else "PERMISSIVE").load()
    rows = cut(rows, "pages")
    first_bad = rows.where("not complete").agg(F.min("page")).first()[0]
    kept = rows.where("complete") if first_bad is None else rows.where(F.col("complete") & (F.col("page") < first_bad))
    return kept.select("page", "record"), first_bad is None


def read_one(spark: SparkSession, fetch: str, endpoint: str) -> str | None:
    """The single record of an endpoint as JSON text; a failing request is an error."""
    rows, _ = read_pages(spark, fetch, endpoint, 1, strict=True)
    found = rows.orderBy("page").first()
    return found and found.record


def fetch_by_keys(keys: DataFrame, raw: DataFrame, key: str = "uri") -> tuple[DataFrame, DataFrame]:
    """Records of listed keys, and the keys that have none."""
    return keys.join(raw, key), keys.join(raw, key, "left_anti")
