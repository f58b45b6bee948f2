"""Packing into optimal length buckets.

A dynamic programme over the global histogram of sequence lengths chooses the bucket lengths that need the least padding; inside
each bucket, sequences in a fixed shuffled order fill batches of a token budget.  Lengths are any column: words, or the tokens of token
files, whose batches pack_files() writes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from augurline.llm import textops, tokenfiles
from augurline.llm.cluster import mapped, new_file, stored

WORDS = r"[^ \t\n\x0B\f\r]+"


def word_lengths(text: str = "text") -> Column:
    """Words of a text and one end mark; 1 for null and empty texts."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long") + 1


def best_bounds(lengths: list[int], counts: list[int], n_buckets: int) -> list[int]:
    """The bucket lengths with the least total padding; of equal choices, shorter buckets first.

    lengths ascend and counts are positive.  With at most n_buckets distinct lengths each is a bucket of its own.
    """
    if not lengths:
        return []
    length, total = np.array(lengths, np.int64), np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
    n = len(lengths)
    infinite = np.iinfo(np.int64).max // 2
    cost = np.full(n + 1, infinite, np.int64)
    cost[0] = 0
    # spent[a, b]: padded size of a bucket that holds the lengths a to b - 1
    spent = np.where(np.arange(n + 1)[:, None] < np.arange(n + 1)[None, :], np.concatenate([[0], length])[None, :] * (total[None, :] - total[:, None]), infinite)
    back = []
    for _ in range(min(n_buckets, n)):
        ways = np.where((cost[:, None] >= infinite) | (spent >= infinite), infinite, cost[:, None] + np.where(spent >= infinite, 0, spent))
        back.append(ways.argmin(axis=0))
        cost = ways.min(axis=0)
    bounds, at = [], n
    for step in reversed(back):
        bounds.append(int(length[at - 1]))
        at = int(step[at])
    return bounds[::-1]


def pack(df: DataFrame, length: Column, *, id_col: str = "doc_id", max_tokens: int = 2048, n_buckets: int = 16, token_budget: int = 65536, digits: int = 3) -> DataFrame:
    """Place every token of every row in a batch: one row per piece.

    Rows longer than max_tokens become consecutive pieces, so the histogram has at most max_tokens + 1 rows; only it reaches the
    driver.  A batch of the bucket of length L holds max(1, token_budget // L) pieces.  The order inside a bucket is by the MD5 of
    id and piece; its first hexadecimal digits cut each bucket into 16**digits blocks, whose counts give each block its first rank,
    so that a bucket with a third of all rows is still ranked by many tasks.

    Returns id_col, piece, start, n_tokens, bucket_len, batch, slot and pad (all long).  Null lengths count as 0 and stay as one
    piece without tokens; null ids hash as 'null'; repeated rows are kept as often as they occur; other columns are ignored; an
    empty table gives an empty result.
    """
    whole = F.coalesce(length.cast("long"), F.lit(0))
    pieces = (
        df.select(F.col(id_col).alias("id"), whole.alias("whole"))
        .select("id", "whole", F.explode(F.expr(f"sequence(0L, greatest(whole - 1, 0L) div {max_tokens}L)")).alias("piece"))
        .select("id", "piece", (F.col("piece") * max_tokens).alias("start"), F.least(F.lit(max_tokens), F.col("whole") - F.col("piece") * max_tokens).cast("long").alias("n_tokens"))
    )
    pieces = stored(pieces, "pieces")
    histogram = sorted((r["n_tokens"], r["count"]) for r in pieces.groupBy("n_tokens").count().collect())
    bounds = best_bounds([x for x, _ in histogram], [n for _, n in histogram], n_buckets) or [0]
    bucket = F.lit(bounds[-1])
    for bound in reversed(bounds[:-1]):
        bucket = F.when(F.col("n_tokens") <= bound, F.lit(bound)).otherwise(bucket)
    keyed = pieces.withColumn("bucket_len", bucket.cast("long")).withColumn("order", F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("piece").cast("string"))))
    keyed = keyed.withColumn("block", F.substring("order", 1, digits))
    # At most n_buckets * 16**digits rows, whatever the input.
    offsets = keyed.groupBy("bucket_len", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket_len").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("bucket_len", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("bucket_len", "block").orderBy("order", "id", "n_tokens")
    ranked = keyed.join(F.broadcast(offsets), ["bucket_len", "block"]).withColumn("rank", F.col("base") + F.row_number().over(inside) - 1)
    per_batch = F.expr(f"greatest(1, {token_budget} div greatest(bucket_len, 1))")
    ranked = ranked.withColumn("per_batch", per_batch)
    return ranked.select(
        F.col("id").alias(id_col), "piece", "start", "n_tokens", "bucket_len", F.expr("rank div per_batch").cast("long").alias("batch"), F.expr("rank % per_batch").cast("long").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("pad")
    )


def pack_files(spark: SparkSession, shards: list[dict], folder: str, **options) -> DataFrame:
    """Pack the documents of token files (see tokenfiles.write) and write the batches as token files of their own.

    A file per task holds the ids of whole batches, piece after piece and without padding.  Returns a row per piece: doc_id, piece,
    bucket_len, batch, slot, n_tokens, name (the file) and start (the place of its first id in the file, counted in ids).  Documents
    are told apart by their place, so null and repeated ids are packed like others.  options: those of pack().
    """
    kind = shards[0]["kind"] if shards else "<u2"
    docs = tokenfiles.read(spark, shards).select(F.struct("start", "doc_id").alias("at"), "n_tokens")
    packed = pack(docs.withColumn("key", F.col("at.start")).drop("at"), F.col("n_tokens"), id_col="key", **options)
    ids = tokenfiles.read(spark, shards).select(F.col("start").alias("key"), "doc_id")
    spans = packed.join(ids, "key").select("doc_id", "piece", "bucket_len", "batch", "slot", "n_tokens", (F.col("key") + F.col("start")).alias("begin"))
    schema = "doc_id long, piece long, bucket_len long, batch long, slot long, n_tokens long, name string, start long"
    bases = np.array([s["base"] for s in shards], np.int64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, at = f"{folder}/batches-{TaskContext.get().partitionId():06d}.ids", 0
        opened: dict[int, np.ndarray] = {}
        if (batch := next(batches, None)) is None:
            return
        with new_file(name) as out:
            while batch is not None:
                starts = []
                for begin, n in zip(batch.column("begin").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True):
                    shard = int(np.searchsorted(bases, begin, "right")) - 1
                    if shard not in opened:
                        opened[shard] = mapped(f"{shards[shard]['name']}.ids", kind)
                    first = begin - shards[shard]["base"]
                    out.write(opened[shard][first : first + n].tobytes())
                    starts.append(at)
                    at += n
                kept = batch.drop_columns(["begin"])
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([name] * batch.num_rows), pa.array(starts, pa.int64())], [*kept.schema.names, "name", "start"])
                batch = next(batches, None)

    by_batch = spans.repartition("bucket_len", "batch").sortWithinPartitions("bucket_len", "batch", "slot")
    return stored(by_batch.mapInArrow(textops.trimmed(task), schema), "packed")
