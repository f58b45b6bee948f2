"""Shared folders and small files that the driver and every executor can reach.

Tables that cut lineage, token files, archives and text blocks live below ``spark.checkpoint.dir``.  Python tasks reach that
folder through ``pyarrow.fs`` (file, hdfs, s3 and gs addresses); tables go through Spark's own readers and writers.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new address below the cluster's shared folder.

    The session's ``spark.checkpoint.dir`` is used as it is set; a folder of this machine stands in for it only where it is
    unset and the master is local.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/augurline-shared-{os.getuid()}"
    if "://" not in base:
        base = f"file:{base}" if base.startswith("file:") else base
        base = "file://" + base.removeprefix("file:") if base.startswith(("/", "file:/")) else base
    return f"{base.rstrip('/')}/augurline-{name}-{uuid.uuid4().hex}"


def filesystem(address: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address and the path within it."""
    return pafs.FileSystem.from_uri(address.replace("s3a://", "s3://", 1))


def write_file(address: str, *parts: bytes) -> int:
    """Write a whole file under a temporary name, then rename it; a repeated task replaces it with the same bytes."""
    fs, path = filesystem(address)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    temporary = f"{path}.tmp-{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary, compression=None) as out:
        for part in parts:
            out.write(part)
    fs.move(temporary, path)
    return sum(map(len, parts))


@contextlib.contextmanager
def new_file(address: str) -> Iterator[pa.NativeFile]:
    """A stream into a file that gets its name when all is written; a failed or repeated task leaves no half file."""
    fs, path = filesystem(address)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    temporary = f"{path}.tmp-{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary, compression=None) as out:
        yield out
    fs.move(temporary, path)


def mapped(address: str, kind: str) -> np.ndarray:
    """A file as an array: memory-mapped where the file system is local, else read."""
    fs, path = filesystem(address)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, np.dtype(kind), "r") if os.path.getsize(path) else np.zeros(0, kind)
    return np.frombuffer(read_file(address), kind)


def read_file(address: str) -> bytes:
    fs, path = filesystem(address)
    with fs.open_input_stream(path, compression=None) as stream:
        return stream.read()


#: By default a batch for Python has up to 64 MB in the JVM's direct memory and again in the worker, and a batch of a scan 4096 rows.
TEXT_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 20), "spark.sql.parquet.columnarReaderBatchSize": "512"}


@contextlib.contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run within it get batches that suit long rows; what the session itself has set holds, and rows are the same."""
    own = [k for k in TEXT_BATCHES if spark.conf.get(k, None) is None]
    try:
        for k in own:
            spark.conf.set(k, TEXT_BATCHES[k])
        yield
    finally:
        for k in own:
            spark.conf.unset(k)


def stored(df: DataFrame, name: str, texts: bool = False) -> DataFrame:
    """The rows of df, written once to the shared folder and read back, so that lost executors cost no recomputation.

    texts: whether the job handles whole texts or sets, and so gets small batches.
    """
    spark = df.sparkSession
    address = shared_folder(spark, name)
    with text_batches(spark) if texts else contextlib.nullcontext():
        df.write.parquet(address)
    return spark.read.schema(df.schema).parquet(address)


def measured(df: DataFrame, name: str, *figures: Column) -> tuple[DataFrame, dict]:
    """As stored(), with figures of the rows (aggregates with an alias), which the writing job itself counts."""
    seen = Observation()
    kept = stored(df.observe(seen, *figures), name)
    return kept, seen.get


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def joined(rows: DataFrame, keyed: DataFrame, key: str, total: int, share: int = 2000) -> DataFrame:
    """Each of rows with the columns of its key in keyed; rows without one go.

    keyed has a row for each key, and n: how many of the `total` rows have that key; it is written to the shared folder.  Keys with more
    than total / share rows, which are fewer than share, are broadcast; the other rows are shuffled, and no task gets more than
    total / share of them for one key.
    """
    keyed, figures = measured(keyed, "keyed", F.max("n").alias("most"))
    often = F.col("n") * share > total
    if (figures["most"] or 0) * share <= total:
        return rows.join(keyed.drop("n"), key)
    hot = keyed.where(often).drop("n")
    seldom = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(keyed.where(~often).drop("n"), key)
    return rows.join(F.broadcast(hot), key).unionByName(seldom)
