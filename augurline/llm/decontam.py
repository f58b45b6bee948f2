"""Benchmark decontamination by Wu-Manber search over words.

Every window of 8 benchmark words is a pattern.  A table of shifts for blocks of two words skips positions at which no pattern can
end; where the shift is 0, the block (a pattern's suffix) and the words a pattern begins with select the patterns to compare.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructType

from augurline.llm import textops
from augurline.llm.cluster import read_file, shared_folder, write_file

#: Lower-cases A-Z, keeps 0-9, a-z and all bytes from 0x80, and makes a space of everything else.
CLEANED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WINDOW = 8


def words_of(text: str | bytes | None) -> list[bytes]:
    return (text.encode() if isinstance(text, str) else text or b"").translate(CLEANED).split()


class Matcher:
    """Finds all occurrences of patterns of one length in words."""

    def __init__(self, patterns: dict[tuple[bytes, ...], frozenset[str]]):
        self.length = len(next(iter(patterns)))
        self.block = min(2, self.length)
        self.default = self.length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.tests: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list]] = {}
        for pattern, items in patterns.items():
            for end in range(self.block, self.length + 1):
                block = pattern[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.default), self.length - end)
            suffix, prefix = pattern[-self.block :], pattern[: self.block]
            self.tests.setdefault(suffix, {}).setdefault(prefix, []).append((pattern, items))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, frozenset[str]]]:
        """(first word, items) of each occurrence, in order."""
        length, block, default, shift = self.length, self.block, self.default, self.shift.get
        end, n = length, len(words)
        while end <= n:
            suffix = tuple(words[end - block : end])
            if skip := shift(suffix, default):
                end += skip
                continue
            begin = end - length
            for pattern, items in self.tests[suffix].get(tuple(words[begin : begin + block]), ()):
                if all(a == b for a, b in zip(pattern, words[begin:end], strict=True)):
                    yield begin, items
            end += 1


def windows_of(items: Iterator[tuple[str, str]]) -> dict[int, dict[tuple[bytes, ...], frozenset[str]]]:
    """Patterns by length, each with the items that hold it."""
    found: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - WINDOW + 1)) if words else ():
            window = tuple(words[i : i + WINDOW])
            found.setdefault(len(window), {}).setdefault(window, set()).add(item)
    return {n: {w: frozenset(x) for w, x in of.items()} for n, of in found.items()}


def search(words: list[bytes], matchers: list[Matcher], hit: bytearray, items: set[str]) -> None:
    for matcher in matchers:
        for begin, found in matcher.find(words):
            hit[begin : begin + matcher.length] = b"\1" * matcher.length
            items |= found


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> list[str]:
    """The benchmark in files of about `most` bytes in the shared folder, written by the tasks that read it."""
    folder = shared_folder(benchmark.sparkSession, "benchmark")
    rows = benchmark.where(F.col(f"`{text_col}`").isNotNull()).select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text_col}`").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, size = TaskContext.get().partitionId(), [], [], 0

        def flush() -> None:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as out:
                for b in held:
                    out.write_batch(b)
            made.append(f"{folder}/{part:06d}-{len(made):06d}.arrow")
            write_file(made[-1], sink.getvalue().to_pybytes())

        for batch in textops.small_batches(batches, "text", most):
            _, offsets = textops.buffers(batch.column("text"))
            if held and size + int(offsets[-1]) > most:
                flush()
                held, size = [], 0
            held.append(batch)
            size += int(offsets[-1])
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["name"])

    # A name for each `most` bytes.
    return sorted(r["name"] for r in rows.mapInArrow(textops.trimmed(task), "name string").collect())


_kept: dict[str, list[Matcher]] = {}


def matchers_of(block: str) -> list[Matcher]:
    """The matchers of a block; only the block used last stays in memory."""
    if block not in _kept:
        _kept.clear()
        table = pa.ipc.open_stream(read_file(block)).read_all()
        _kept[block] = [Matcher(p) for _, p in sorted(windows_of(zip(table["item"].to_pylist(), table["text"].to_pylist(), strict=True)).items())]
    return _kept[block]


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text; most = 0: as they come."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(textops.buffers(batch.column("text"))[0])
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def scan(df: DataFrame, benchmark: DataFrame, *, text: str = "text", item_col: str = "item_id", item_text: str = "text", min_items: int = 2, block_bytes: int = 4 << 20, gather_bytes: int = 16 << 20) -> DataFrame:
    """df without its text and with n_words, n_hit, n_items (long), items (sorted strings), contaminated; no shuffle.

    The benchmark is cut into files of block_bytes, and a task holds one at a time.  With several, a task gathers gather_bytes of
    documents and runs each file over them, so it loads a file once for so many documents.  Null and empty texts have no words; items
    without words are never found; an item id that occurs repeatedly is one item, and null ids are the item ''.  Long texts are searched
    whole; repeated rows stay; an empty table gives no rows, and an empty benchmark finds nothing.  Columns of df with the name of a new
    one give way to it.
    """

    blocks = blocks_of(benchmark, item_col, item_text, block_bytes)
    made = ("n_words", "n_hit", "n_items", "items", "contaminated")
    names = [c for c in df.columns if c != text and c not in made]
    own = df.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)), F.col(f"`{text}`").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(textops.small_batches(batches, "text"), gather_bytes if len(blocks) > 1 else 0):
            if len(blocks) < 2:
                found = [found_in(words_of(t.as_py()), blocks) for t in batch.column("text")]
            else:
                words = [words_of(t.as_py()) for t in batch.column("text")]
                marks, items = [bytearray(len(w)) for w in words], [set() for _ in words]
                for block in blocks:
                    matchers = matchers_of(block)
                    for w, m, i in zip(words, marks, items, strict=True):
                        search(w, matchers, m, i)
                found = [(len(w), sum(m), sorted(i)) for w, m, i in zip(words, marks, items, strict=True)]
            kept = batch.drop_columns(["text"]).columns
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([len(x[2]) for x in found], pa.int64()), pa.array([x[2] for x in found], pa.list_(pa.string())), pa.array([len(x[2]) >= min_items for x in found], pa.bool_())],
                [*(f"c{k}" for k in range(len(names))), "n_words", "n_hit", "n_items", "items", "contaminated"],
            )

    schema = StructType([f for f in own.schema.fields if f.name != "text"])
    for name, kind in (("n_words", LongType()), ("n_hit", LongType()), ("n_items", LongType()), ("items", ArrayType(StringType())), ("contaminated", BooleanType())):
        schema = schema.add(name, kind)
    return own.mapInArrow(textops.trimmed(task), schema).select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)), "n_words", "n_hit", "n_items", "items", "contaminated")


def found_in(words: list[bytes], blocks: list[str]) -> tuple[int, int, list[str]]:
    hit, items = bytearray(len(words)), set()
    for block in blocks:
        search(words, matchers_of(block), hit, items)
    return len(words), sum(hit), sorted(items)


def clean(df: DataFrame, benchmark: DataFrame, *, min_items: int = 1, **options) -> DataFrame:
    """The rows of df with fewer than min_items benchmark items, with their own columns, whatever their names; cases as in scan()."""
    names = df.columns
    text = options.pop("text", "text")
    doubled = df.select(*(F.col(f"`{c}`").alias(f"own{k}") for k, c in enumerate(names)), F.col(f"`{text}`").alias("text"))
    return scan(doubled, benchmark, min_items=min_items, **options).where("not contaminated").select(*(F.col(f"own{k}").alias(c) for k, c in enumerate(names)))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
