"""Time-series archive files (TSF text, or a ZIP archive with exactly one)."""

from __future__ import annotations

import hashlib
import io
import math
import os
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

LARGEST = 32 << 20
SCHEMA = "path string, relation string, frequency string, horizon int, sha256 string, ordinal int, name string, start_timestamp timestamp_ntz, attributes map<string, string>, y array<double>"
#: Archives known by name.
ARCHIVES = ("fred_md", "bitcoin", "oikolab_weather")
HEADS = {"relation", "frequency", "horizon", "missing", "equallength"}
STAMP = "%Y-%m-%d %H-%M-%S"


def parse(content: bytes, encoding: str = "cp1252") -> tuple[dict, list[tuple]]:
    """(header, records (name, start, attributes, values)); a question mark is a missing place and becomes None where it stands."""
    header: dict[str, str] = {}
    attributes: list[tuple[str, str]] = []
    records: list[tuple] = []
    body = False
    for number, line in enumerate(content.decode(encoding).splitlines(), 1):
        text = line.strip()
        if not text or text.startswith("#"):
            continue
        where = f"line {number}"
        if not body:
            if not text.startswith("@"):
                raise ValueError(f"{where}: data before @data")
            tag, *rest = text[1:].split(None, 2)
            tag = tag.lower()
            if tag == "data":
                if rest:
                    raise ValueError(f"{where}: @data takes nothing")
                body = True
            elif tag == "attribute":
                if len(rest) != 2 or rest[1] not in ("string", "numeric", "date") or rest[0] in dict(attributes):
                    raise ValueError(f"{where}: a new attribute and its type are needed")
                attributes.append((rest[0], rest[1]))
            else:
                value = text[1:].split(None, 1)[1:]
                if tag not in HEADS or tag in header or not value:
                    raise ValueError(f"{where}: unknown, repeated or empty header")
                header[tag] = value[0].strip()
        else:
            records.append(_record(text, attributes, len(records) + 1, where))
    if not body or not records:
        raise ValueError("no data")
    for tag in ("missing", "equallength"):
        if header.get(tag, "true").lower() not in ("true", "false"):
            raise ValueError(f"@{tag} must be true or false")
    if header.get("missing", "").lower() == "false" and any(v is None for r in records for v in r[3]):
        raise ValueError("missing values contradict @missing")
    if header.get("equallength", "").lower() == "true" and len({len(r[3]) for r in records}) > 1:
        raise ValueError("lengths contradict @equallength")
    if len({r[0] for r in records}) != len(records):
        raise ValueError("series names must be distinct")
    if "horizon" in header and (not header["horizon"].isdigit() or int(header["horizon"]) < 1):
        raise ValueError("@horizon must be a positive integer")
    return header, records


def _record(text: str, attributes: list[tuple[str, str]], ordinal: int, where: str) -> tuple:
    parts = text.split(":", len(attributes))
    if len(parts) != len(attributes) + 1:
        raise ValueError(f"{where}: {len(attributes)} attributes are needed")
    own, name, start = {}, str(ordinal), None
    for (key, kind), raw in zip(attributes, parts[:-1], strict=True):
        raw = raw.strip()
        if kind == "numeric" and not math.isfinite(float(raw)):
            raise ValueError(f"{where}: {key} is not finite")
        if kind == "date":
            stamp = datetime.strptime(raw, STAMP)
            start = stamp if key == "start_timestamp" else start
        if key == "series_name":
            name = raw
        own[key] = raw
    values = []
    for cell in parts[-1].split(","):
        cell = cell.strip()
        if cell != "?" and not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", cell):
            raise ValueError(f"{where}: {cell!r} is no number")
        value = None if cell == "?" else float(cell)
        if value is not None and not math.isfinite(value):
            raise ValueError(f"{where}: {cell!r} is not finite")
        values.append(value)
    return name, start, own, values


def unpacked(content: bytes) -> bytes:
    if len(content) > LARGEST:
        raise ValueError("larger than 32 MiB")
    if content[:2] != b"PK":
        return content
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        inside = [i for i in archive.infolist() if i.filename.lower().endswith(".tsf")]
        if len(inside) != 1 or inside[0].file_size > LARGEST:
            raise ValueError("an archive must hold exactly one TSF file of at most 32 MiB")
        return archive.read(inside[0])


def read_tsf(spark: SparkSession, path: str, encoding: str = "cp1252") -> DataFrame:
    """One row per series of every file at the path; missing places are null elements of y."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                content = bytes(row.content)
                head, records = parse(unpacked(content), encoding)
                digest = hashlib.sha256(content).hexdigest()
                horizon = int(head["horizon"]) if "horizon" in head else None
                rows = [(row.path, head.get("relation"), head.get("frequency"), horizon, digest, k, name, start, own, values) for k, (name, start, own, values) in enumerate(records)]
                frame = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.replace("map<string, string>", "map").split(", ")])
                frame["horizon"] = frame["horizon"].astype("Int32")
                yield frame

    return files.mapInPandas(run, SCHEMA)


def available_datasets() -> tuple[str, ...]:
    return ARCHIVES


def load_dataset(spark: SparkSession, name: str, *, cache_dir: str, sha256: str | None = None) -> DataFrame:
    """A known archive from a local cache, its digest checked; there is no network access here, so a file that isn't cached raises."""
    if name not in ARCHIVES:
        raise ValueError(f"unknown dataset {name!r}; known: {', '.join(ARCHIVES)}")
    path = os.path.join(cache_dir, f"{name}.zip")
    if not os.path.exists(path):
        raise FileNotFoundError(f"{path} is not cached, and datasets are not downloaded")
    with open(path, "rb") as file:
        digest = hashlib.sha256(file.read()).hexdigest()
    if sha256 is not None and digest != sha256:
        raise ValueError(f"{path} has digest {digest}")
    return read_tsf(spark, path)


def observations(rows: DataFrame, trim_leading: bool = True) -> DataFrame:
    """(series_id, t, y) of series rows: places without a value at the start are cut off; later ones stay null."""
    from pyspark.sql import functions as F

    long = rows.select(F.col("name").alias("series_id"), F.posexplode("y").alias("t", "y"))
    if not trim_leading:
        return long.withColumn("t", F.col("t").cast("long"))
    first = long.where("y is not null").groupBy("series_id").agg(F.min("t").alias("first"))
    return long.join(first, "series_id").where("t >= first").select("series_id", (F.col("t") - F.col("first")).cast("long").alias("t"), "y")
