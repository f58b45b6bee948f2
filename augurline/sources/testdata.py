"""Series and panels made from the driver's tables; values are in millions, so that sums stay near 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def daily_revenue(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    """(series_id, t, y): order value per day, positions without calendar gaps; one series, or one per value of a column."""
    keys = [by] if by else []
    days = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(*keys, "o_orderdate").agg((F.sum("o_totalprice") / 1e6).alias("y"))
    days = days.withColumn("series_id", F.col(by).cast("string") if by else F.lit("all"))
    t = F.row_number().over(Window.partitionBy("series_id").orderBy("o_orderdate")) - 1
    return days.select("series_id", t.cast("long").alias("t"), "y")


def priority_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly order value by priority; a week without orders of a priority has value 0, stated here and in the SQL."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    cells = orders.groupBy(F.date_trunc("week", "o_orderdate").alias("w"), F.col("o_orderpriority").alias("name")).agg((F.sum("o_totalprice") / 1e6).alias("value"))
    weeks = cells.select("w").distinct().withColumn("t", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("w")) - 1).cast("long"))
    names = cells.select("name").distinct().withColumn("col", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("name")) - 1)
    grid = weeks.withColumn("k", F.lit(1)).join(names.withColumn("k", F.lit(1)), "k").drop("k")
    full = grid.join(cells, ["w", "name"], "left")
    return full.select(F.lit("weekly").alias("panel_id"), "t", "col", "name", F.coalesce("value", F.lit(0.0)).alias("value"))


def centred(panel: DataFrame) -> DataFrame:
    """Each value less the mean of its row: a panel of relative performance with means on both sides of 0."""
    return panel.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy("panel_id", "t")))


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, t, y): one observation per event of a type, in order of time."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id")) - 1
    return events.select(F.col("event_type").alias("series_id"), t.cast("long").alias("t"), F.col("value").cast("double").alias("y"))
