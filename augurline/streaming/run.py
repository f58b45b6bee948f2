"""Runs a stream over stored rows to its end; for checks of streams against batch results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; below this machine's temporary folder only with a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base or tempfile.gettempdir()}/augurline-{name}-{uuid.uuid4().hex}"


def completed(df: DataFrame, make: Callable[[DataFrame], DataFrame], batches: int = 3) -> DataFrame:
    """The output of make(stream) when the rows of df arrive in `batches` files, one per micro-batch, in order of t."""
    spark = df.sparkSession
    folder = scratch(spark, "stream")
    df.repartitionByRange(batches, "t").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = make(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")
