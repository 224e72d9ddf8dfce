"""Reading tables, staging intermediate tables and Arrow helpers shared by the operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from optrace.session import ship_package

MASK = (1 << 64) - 1


#: Bytes of an Arrow batch handed to a Python worker, where the session sets no bound of its own.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    if BATCH_BYTES[0] not in spark.conf.getAll:
        spark.conf.set(*BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """df written as Parquet below spark.checkpoint.dir and read again: it cuts the lineage, and
    every executor can read it. A local session without that setting takes a temporary folder.
    options are the writer's, such as session.ROW_BY_ROW for rows of megabytes."""
    path = shared_folder(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _local_folder()
    return f"{folder.rstrip('/')}/llm-{name}-{uuid4().hex}"


_folders: list[str] = []


def _local_folder() -> str:
    if not _folders:
        _folders.append(tempfile.mkdtemp(prefix="optrace-llm-"))
    return _folders[0]


def slices(batch: pa.RecordBatch, column: str, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about size bytes of the text column (one row at least)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for row, length in enumerate(lengths):
        if row > start and total + length > size:
            yield batch.slice(start, row - start)
            start, total = row, 0
        total += length
    if start < batch.num_rows:
        yield batch.slice(start)


class Bounded(dict):
    """A cache that starts anew when it holds limit entries; __missing__ fills it."""

    def __init__(self, make, limit: int = 200_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


word_hashes = Bounded(xxhash.xxh3_64_intdigest)


def hashed_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(word_hashes.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def mixed_int(x: int) -> int:
    x = ((x ^ (x >> 33)) * 0xFF51AFD7ED558CCD) & MASK
    x = ((x ^ (x >> 29)) * 0xC4CEB9FE1A85EC53) & MASK
    return x ^ (x >> 32)


def sampled(df: DataFrame, key: str, rows: int, salt: str) -> DataFrame:
    """At most rows rows, those of the smallest hash of the key."""
    return df.orderBy(F.xxhash64(F.lit(salt), F.col(key)), key).limit(rows)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: (node, component), component being the smallest
    node. Large-star and small-star steps in turn until nothing changes; each step is an
    aggregate and a join on edges, staged in the shared folder. Nodes without an edge to another
    node are left out."""
    now = staged(
        edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    seen = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u")
        small = down.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
        now = staged(small.filter("u <> v").distinct(), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = tuple(state)
