"""A deterministic sharded WARC writer, and a reader that verifies what it reads.

Pages are range-sorted by id into shards whose bounds are exact ranks, so they depend on the rows and the number of shards alone.
A shard rolls to a new file when its compressed size passes a limit.  Headers and digests are made from the payloads; of equal
payloads, the page with the smallest id holds it and the others are revisit records.  Files get their names when they are complete,
and readers read what the manifest lists.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from augurline.llm import textops
from augurline.llm.cluster import filesystem, joined, new_file, shared_folder, shuffle_partitions, stored, write_file

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None, digest: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}/{digest}/{nth}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, nth: int, date: str) -> bytes:
    """One record, gzip-compressed by itself; refers_to makes it a revisit.  nth tells repeated rows apart."""
    digest = base32(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest, nth)}", f"WARC-Date: {date}"]
    head.append("WARC-Target-URI: " + "".join((url or f"urn:page:{page_id}").split()))
    if page_id is not None:
        head.append(f"WARC-X-Page: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest, 0)}", f"WARC-X-Refers-To-Page: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def shard_bounds(ids: DataFrame, n_shards: int) -> list[int]:
    """The ids at ranks N / n_shards, 2 N / n_shards, ...: one for each further shard."""
    ranged = ids.where("id is not null").repartitionByRange(n_shards, "id").withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "warc-ids")
    counts = sorted((r["part"], r["count"]) for r in ranged.groupBy("part").count().collect())
    total = sum(n for _, n in counts)
    step, base, bases = max(1, -(-total // n_shards)), 0, []
    for part, n in counts:
        bases.append((part, base))
        base += n
    if not bases:
        return []
    starts = ids.sparkSession.createDataFrame(bases, "part int, base long")  # a row for each shard
    rank = F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
    found = ranged.join(F.broadcast(starts), "part").withColumn("rank", rank).where((F.col("rank") % step == 0) & (F.col("rank") > 0))
    return sorted({r["id"] for r in found.select("id").collect()})


def write(pages: DataFrame, folder: str, *, n_shards: int | None = None, roll_bytes: int = 64 << 20, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> list[dict]:
    """Write a record for each row of pages (page_id, url, html); returns the manifest's files.

    Payloads below min_bytes are all responses.  A null html is an empty payload and a null url is ``urn:page:ID``.  Rows with a null
    id come first and are responses, or revisits where a page with an id has the payload.  Of rows with the same id and payload the
    first is the response.  Other columns are ignored, whatever their names; an empty table gives a manifest without files.  A very
    long page is one record; a task holds the batch that Spark gives it, at most 64 MB or one page (spark.sql.execution.arrow.maxBytesPerBatch).
    """
    spark = pages.sparkSession
    n_shards = n_shards or shuffle_partitions(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    slim = stored(rows.select("id", F.unhex(F.sha1(F.col("html").cast("binary"))).alias("digest"), F.octet_length("html").alias("size")), "warc-digests")
    bounds = shard_bounds(slim.select("id"), n_shards)

    @F.pandas_udf("int")
    def shard_of(ids):
        at = np.searchsorted(np.array(bounds, np.int64), ids.fillna(np.iinfo(np.int64).min).astype(np.int64), "right")
        return __import__("pandas").Series(at.astype(np.int32))

    groups = slim.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    # A payload that a large share of all pages has, such as an empty one, is split.
    marks = joined(slim.select("id", "digest"), groups, "digest", slim.count()).select("id", "digest", "first").distinct()
    merged = rows.select("id", F.lit(1).alias("kind"), F.unhex(F.sha1(F.col("html").cast("binary"))).alias("digest"), "url", "html", F.lit(None).cast("long").alias("first")).unionByName(
        marks.select("id", F.lit(0).alias("kind"), "digest", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "first")
    )
    dealt = merged.withColumn("shard", shard_of("id")).repartitionById(n_shards, "shard").sortWithinPartitions("id", "digest", "kind", "url")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, made = TaskContext.get().partitionId(), []
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("id", "kind", "digest", "url", "html", "first")), strict=True))
        row, last, mark, nth = next(rows, None), None, None, 0
        while row is not None:
            name = f"{folder}/shard-{number:06d}-{len(made):05d}.warc.gz"
            size = records = 0
            whole = hashlib.sha256()
            with new_file(name) as out:
                while row is not None and (not size or size < roll_bytes):
                    page_id, kind, digest, url, html, first = row
                    if (page_id, digest) != last:
                        last, mark, nth = (page_id, digest), None, 0
                    if kind == 0:
                        mark = first
                    else:
                        refers = mark if mark is not None and (page_id is None or mark < page_id or nth) else None
                        data = record(page_id, url, html.encode(), refers, nth, date)
                        out.write(data)
                        whole.update(data)
                        size, records, nth = size + len(data), records + 1, nth + 1
                    row = next(rows, None)
                if not size:
                    out.write(b"")
            if records:
                made.append((name, records, size, whole.hexdigest()))
        columns = list(zip(*made, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], ["name", "records", "bytes", "sha256"])

    files = [r.asDict() for r in sorted(dealt.mapInArrow(textops.trimmed(archive), "name string, records long, bytes long, sha256 string").collect())]
    write_file(f"{folder}/MANIFEST.json", json.dumps({"files": files}).encode())
    return files


def members(address: str) -> Iterator[bytes]:
    """The decompressed members of a gzip file, one at a time."""
    fs, path = filesystem(address)
    with fs.open_input_stream(path, compression=None) as stream:
        inflate, parts, data = zlib.decompressobj(31), [], b""
        while data or (data := stream.read(1 << 15)):
            parts.append(inflate.decompress(data))
            data = inflate.unused_data if inflate.eof else b""
            if inflate.eof:
                yield b"".join(parts)
                inflate, parts = zlib.decompressobj(31), []


def parse(member: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of a record; digests are verified."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if f"sha1:{base32(hashlib.sha1(block).digest())}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
    page, refers = fields.get("WARC-X-Page"), fields.get("WARC-X-Refers-To-Page")
    return page and int(page), size, digest, kind, refers and int(refers), fields["WARC-Target-URI"], payload


def read(spark: SparkSession, files: list[dict]) -> DataFrame:
    """A row per record of the manifest's files, a task for each file."""
    if not files:
        return spark.createDataFrame([], ROWS)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows = []
                for member in members(name):
                    rows.append(parse(member)[:5])
                    if len(rows) == 10_000:
                        yield as_batch(rows)
                        rows = []
                yield as_batch(rows)

    listed = spark.createDataFrame([(f["name"],) for f in files], "name string")
    return listed.repartition(len(files)).mapInArrow(textops.trimmed(records), ROWS)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def round_trip(pages: DataFrame, **options) -> DataFrame:
    folder = shared_folder(pages.sparkSession, "warc")
    return read(pages.sparkSession, write(pages, folder, **options))
