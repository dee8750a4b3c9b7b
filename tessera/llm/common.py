"""Shared plumbing of the training-data operators: scratch tables, checked broadcasts, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join may be broadcast up to this many bytes; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20
#: Arrow batches between Spark and Python hold about this many bytes, a single row at least.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; without one, a fresh local one in local mode, an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Workspace:
    """Written intermediate tables of one operator run; writing them cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.names: set[str] = set()

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def only(self, *names: str) -> None:
        """Remove all tables but these, which the operator's result still reads."""
        for name in self.names - set(names):
            self.drop(name)

    def drop(self, name: str) -> None:
        self.names.discard(name)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint for a written table whose counted size is below the limit; else the table as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch that hold about max_bytes of the string column each, a single row at least."""
    col = batch.column(column)
    size = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    begin, total = 0, 0
    for i, n in enumerate(size):
        if total and total + n > max_bytes:
            yield begin, i
            begin, total = i, 0
        total += int(n)
    if begin < batch.num_rows:
        yield begin, batch.num_rows


def bounded(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes: 10,000 rows, its other bound, can be any size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def released() -> None:
    """Give memory that a worker kept for reuse back to the system, for workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mapped(df: DataFrame, columns: list[str], text: str | None, fn: Callable, schema: str, max_bytes: int = 2 << 20) -> DataFrame:
    """mapInArrow of ``fn(batch) -> RecordBatch`` over slices of bounded text size."""

    def run(batches):
        for batch in batches:
            for a, b in slices(batch, text, max_bytes) if text else [(0, batch.num_rows)]:
                yield fn(batch.slice(a, b - a))
        batch = None
        released()

    bounded(df.sparkSession)
    return df.select(*columns).mapInArrow(run, schema)


def ints(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.asarray(pc.fill_null(batch.column(column), 0), dtype=np.int64)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it if the table has such a column already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
