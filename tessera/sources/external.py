"""Parquet tables attached by path, read lazily through Spark's own readers."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import SparkSession

from tessera.plans.analyzer import Table

#: Single-column keys of the test tables.
KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
    "events": "event_id", "documents": "doc_id", "labels": "doc_id", "pages": "page_id", "benchmark": "item_id", "embeddings": "vec_id",
    "lineitem": None, "conversations": None,
}


def attached(spark: SparkSession, name: str, path: str, pk: str | None = None) -> Table:
    return Table(name, spark.read.parquet(path), pk)


class ParquetFolder(Mapping):
    """Tables ``<folder>/<name>.parquet`` by name, each read when it is first asked for."""

    def __init__(self, spark: SparkSession, folder: str, keys: Mapping[str, str | None] = KEYS):
        self.spark, self.folder, self.keys, self.known = spark, folder, keys, {}

    def __getitem__(self, name: str) -> Table:
        if name not in self.keys:
            raise KeyError(name)
        if name not in self.known:
            self.known[name] = attached(self.spark, name, f"{self.folder}/{name}.parquet", self.keys[name])
        return self.known[name]

    def __contains__(self, name: object) -> bool:
        return name in self.keys

    def __iter__(self) -> Iterator[str]:
        return iter(self.keys)

    def __len__(self) -> int:
        return len(self.keys)
