"""Blocks of documents in the shared folder, and exchanges of sorted integers between blocks and buckets.

Some operators need corpus-wide counts of what each document holds.  Documents are written once as blocks of bounded size.  A block
sends each bucket its distinct keys and gets back an answer for each, so the shuffles carry a block's distinct keys instead of a row
for each occurrence, and no task needs the whole dictionary.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from augurline.llm import textops
from augurline.llm.cluster import read_file, shared_folder, stored, write_file


class Blocks:
    """listed: a row per block with block (long), docs, bytes; the rows themselves are in files of the folder."""

    def __init__(self, folder: str, listed: DataFrame, count: int, total_bytes: int):
        self.folder, self.listed, self.count, self.total_bytes = folder, listed, count, total_bytes


def address(folder: str, block: int) -> str:
    return f"{folder}/block-{block >> 32:06d}-{block & 0xFFFFFFFF:06d}.arrow"


def load(folder: str, block: int) -> pa.Table:
    return pa.ipc.open_stream(read_file(address(folder, block))).read_all()


def write(df: DataFrame, name: str, text: str = "text", most: int = 12 << 20) -> Blocks:
    """Write the rows of df in blocks of about `most` bytes of text and one row at least."""
    folder = shared_folder(df.sparkSession, name)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                for b in held:
                    out.write_batch(b)
            block = part << 32 | seq
            write_file(address(folder, block), sink.getvalue())
            return pa.RecordBatch.from_pydict({"block": [block], "docs": [sum(b.num_rows for b in held)], "bytes": [size]}, pa.schema([("block", pa.int64()), ("docs", pa.int64()), ("bytes", pa.int64())]))

        for batch in textops.small_batches(batches, text, most):
            _, offsets = textops.buffers(batch.column(batch.schema.get_field_index(text)))
            if held and size + offsets[-1] > most:
                yield flush()
                seq, held, size = seq + 1, [], 0
            held.append(batch)
            size += int(offsets[-1])
        if held:
            yield flush()

    listed = stored(df.mapInArrow(textops.trimmed(task), "block long, docs long, bytes long"), f"{name}-list", texts=True)
    count, total = listed.selectExpr("count(*)", "coalesce(sum(bytes), 0)").first()
    return Blocks(folder, listed, count, total)


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Unsigned integers, by bytes of equal weight and compressed; ascending ones as differences."""
    values = values.astype(np.uint64)
    if ascending:
        values[1:] = np.diff(values)
    width = 4 if not len(values) or values.max() < 1 << 32 else 8
    kind = np.uint32 if width == 4 else np.uint64
    return bytes([width | ascending]) + zstandard.compress(np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(-1, width).T).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    width, ascending = data[0] & ~1, data[0] & 1
    raw = np.frombuffer(zstandard.decompress(data[1:]), np.uint8)
    values = np.ascontiguousarray(raw.reshape(width, -1).T).view(np.uint32 if width == 4 else np.uint64).ravel().astype(np.uint64)
    return np.cumsum(values, dtype=np.uint64) if ascending else values


Row = tuple[int, int, dict[str, bytes]]


def row_batch(bucket: int, block: int, fields: dict[str, bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([block], pa.int64()), *(pa.array([v], pa.binary()) for v in fields.values())], ["bucket", "block", *fields])


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
    for batch in batches:
        for row in batch.to_pylist():
            yield row.pop("bucket"), row.pop("block"), row


def schema(fields: tuple[str, ...]) -> str:
    return "bucket int, block long" + "".join(f", {f} binary" for f in fields)


def emitted(blocks: Blocks, emit: Callable[[int], Iterator[tuple[int, dict[str, bytes]]]], fields: tuple[str, ...]) -> DataFrame:
    """Rows (bucket, block, fields) that emit(block) yields for each block, a task for each."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("block").to_pylist():
                for bucket, blobs in emit(block):
                    yield row_batch(bucket, block, blobs)

    return blocks.listed.select("block").repartition(max(1, blocks.count)).mapInArrow(textops.trimmed(task), schema(fields))


def served(rows: DataFrame, n_buckets: int, serve: Callable[[int, list[Row]], Iterator[tuple[int, dict[str, bytes]]]], fields: tuple[str, ...]) -> DataFrame:
    """Rows (bucket, block, fields): what serve(bucket, its rows) yields as (block, fields); a partition for each bucket."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(rows_of(batches))
        if own:
            for block, blobs in serve(own[0][0], own):
                yield row_batch(own[0][0], block, blobs)

    return rows.repartitionById(n_buckets, "bucket").mapInArrow(textops.trimmed(task), schema(fields))


def returned(answers: DataFrame, blocks: Blocks, use: Callable[[int, list[Row]], Iterator[pa.RecordBatch]], out: str) -> DataFrame:
    """What use(block, all answers to it in order of buckets) yields."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own = None, []
        for row in rows_of(batches):
            if row[1] != block:
                if own:
                    yield from use(block, own)
                block, own = row[1], []
            own.append(row)
        if own:
            yield from use(block, own)

    return answers.repartition(max(1, blocks.count), "block").sortWithinPartitions("block", "bucket").mapInArrow(textops.trimmed(task), out)


def cut(keys: np.ndarray, n_buckets: int, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of the ranges of ascending keys below 2**bits that each bucket gets; bucket 0 also if it gets none."""
    limits = np.array([(b << bits) // n_buckets for b in range(1, n_buckets)], np.uint64)
    ends = [0, *np.searchsorted(keys, limits).tolist(), len(keys)]
    return [(b, ends[b], ends[b + 1]) for b in range(n_buckets) if ends[b] < ends[b + 1] or b == 0]
