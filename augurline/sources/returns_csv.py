"""Strict CSV files of returns."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from augurline.operators.hac import subtract_benchmark

SCHEMA = "panel_id string, t long, date string, col int, name string, value double"


def parse(content: bytes, path: str = "") -> list[tuple]:
    """(t, date, col, name, value) of a file; whatever isn't exactly a table of numbers raises.

    A byte order mark is allowed, names are stripped, nonempty and distinct, a column named date must hold strictly rising ISO times,
    every line has as many fields as the header, and a blank line is an error.
    """
    lines = list(csv.reader(io.StringIO(content.decode("utf-8-sig"), newline=""), strict=True))
    if not lines or not lines[0]:
        raise ValueError(f"{path}: no header")
    names = [n.strip() for n in lines[0]]
    if any(not n for n in names) or len(set(names)) != len(names):
        raise ValueError(f"{path}: names must be nonempty and distinct")
    at = names.index("date") if "date" in names else None
    values = [n for n in names if n != "date"]
    if not values:
        raise ValueError(f"{path}: no return columns")
    out, last = [], None
    for t, row in enumerate(lines[1:]):
        if len(row) != len(names):
            raise ValueError(f"{path}, line {t + 2}: {len(row)} fields instead of {len(names)}")
        date = None
        if at is not None:
            date = row[at].strip()
            now = datetime.fromisoformat(date)
            if last is not None and not now > last:
                raise ValueError(f"{path}, line {t + 2}: dates must rise strictly")
            last = now
        cells = [v for i, v in enumerate(row) if i != at]
        out += [(t, date, k, n, float(v)) for k, (n, v) in enumerate(zip(values, cells, strict=True))]
    if not out:
        raise ValueError(f"{path}: no rows")
    return out


def read_returns_csv(spark: SparkSession, path: str, *, benchmark: str | None = None) -> DataFrame:
    """A panel per file (panel_id is its address): panel_id, t, date, col, name, value; the benchmark column is subtracted."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                rows = parse(bytes(row.content), row.path)
                if benchmark is not None and benchmark not in {r[3] for r in rows}:
                    raise ValueError(f"{row.path}: no column {benchmark}")
                yield pd.DataFrame([(row.path, *r) for r in rows], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    panel = files.mapInPandas(run, SCHEMA)
    if benchmark is None:
        return panel
    dates = panel.where("col = 0").select("panel_id", "t", "date").distinct()
    return subtract_benchmark(panel, benchmark).join(dates, ["panel_id", "t"]).select("panel_id", "t", "date", "col", "name", "value")
