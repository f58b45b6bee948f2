"""Token files: flat unsigned integers, 64-bit document offsets, and partition bases from prefix sums.

Documents are range-partitioned and sorted by id; each partition writes one shard of three files:

* ``shard-N.ids``: all token ids in a row, little-endian unsigned integers of 2 bytes (4 for vocabularies above 65,536);
* ``shard-N.offsets``: the documents' starts within the shard and its end, unsigned 64-bit;
* ``shard-N.docs``: the document ids, signed 64-bit, and one byte each that is 0 for a null id.

``manifest.json`` lists the shards with the first token of each (its base), the sum of the tokens of all shards before it.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augurline.llm import textops
from augurline.llm.cluster import mapped, new_file, shared_folder, shuffle_partitions, write_file

DOC = np.dtype([("id", "<i8"), ("valid", "u1")])
#: The normaliser and pre-tokenizer that the lookup of words rests on.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Each is a token end for this pre-tokenizer: it is neither a letter, a number, white space nor an apostrophe.
PUNCTUATION = b",.!?;:*#$%&"


def word_wise(definition: dict) -> bool:
    """Whether a tokenizer's ids of a text are those of its words, one after another, as WordEncoder's lookup needs.

    It must have the normaliser and pre-tokenizer above, which treat each word alike wherever it stands, no dropout and no other
    steps, and each added token must hold ``<|``, so that words without it can be lower-cased beforehand.
    """
    model = definition.get("model", {})
    plain = definition.get("normalizer") == NORMALIZER and definition.get("pre_tokenizer") == PRE_TOKENIZER and model.get("type") == "BPE" and not model.get("dropout")
    added = all("<|" in t["content"] and not any(c.isspace() for c in t["content"]) and not t["lstrip"] and not t["rstrip"] for t in definition.get("added_tokens", ()))
    return plain and added and not any(definition.get(x) for x in ("truncation", "padding"))


class WordEncoder:
    """Ids of texts by a tokenizer; where word_wise() allows it, words already met are looked up, else whole texts are encoded.

    The lookup is exact: white space parts words, a letter or digit and the punctuation after it are always separate tokens, and words
    that hold ``<|`` go to the tokenizer as they are, since its special tokens are found before lower-casing.  Of words met, two
    generations of at most `most` are kept; a word of the older one that is met again moves to the younger.
    """

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, "rb") as file:
            definition = file.read()
        self.tokenizer = Tokenizer.from_buffer(definition)
        self.by_word = word_wise(json.loads(definition))
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.most = most

    def _ids(self, word: bytes) -> bytes:
        ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}{'H' if self.kind == '<u2' else 'I'}", *ids)

    def _learn(self, word: bytes) -> bytes:
        if (found := self.older.get(word)) is None:
            core = word.rstrip(PUNCTUATION)
            if len(core) == len(word) or not core[-1:].isalnum() or b"<|" in word:
                found = self._ids(word)
            else:
                found = b"".join([self.known.get(part) or self._learn(part) for part in (core, word[len(core) :])])
        if len(word) < 64:
            self.known[word] = found
        return found

    def encode(self, text: bytes) -> bytes:
        """The ids of a whole UTF-8 text as little-endian unsigned integers."""
        if not self.by_word:
            return self._ids(text)
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        words = (text if b"<|" in text else text.lower()).split()
        get, learn = self.known.get, self._learn
        return b"".join([get(w) or learn(w) for w in words])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write(df: DataFrame, folder: str, tokenizer: str, end_id: int, *, id_col: str = "doc_id", text: str = "text", n_shards: int | None = None) -> list[dict]:
    """Write all rows in ascending id order (null ids first, repeated ids by text); returns the manifest's shards.

    Ids must be whole numbers, as the files hold 64-bit integers; others are refused.  Other columns are ignored, whatever their names;
    an empty table gives no shards; very long texts are encoded whole.

    tokenizer: path of a tokenizers file, there on every executor.  Each document ends with end_id; null and empty texts have only
    that.  Shards are committed by renaming, and a task that runs again writes the same bytes.
    """
    spark = df.sparkSession
    if dict(df.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must hold whole numbers, not {dict(df.dtypes)[id_col]}")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    sorted_rows = rows.repartitionByRange(n_shards or shuffle_partitions(spark), "id", F.xxhash64("text")).sortWithinPartitions("id", "text")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = encoder(tokenizer), TaskContext.get().partitionId()
        kind, name, ends, docs = encode.kind, f"{folder}/shard-{number:06d}", [0], []
        end = np.array([end_id], kind).tobytes()
        width = len(end)
        if not (first := next(batches, None)):
            return
        with new_file(f"{name}.ids") as out:
            while first is not None:
                data, offsets = textops.buffers(first.column("text"))
                data = memoryview(data)
                for i in range(len(offsets) - 1):
                    ids = encode.encode(bytes(data[offsets[i] : offsets[i + 1]])) + end
                    out.write(ids)
                    ends.append(ends[-1] + len(ids) // width)
                own = np.zeros(first.num_rows, DOC)
                own["id"] = first.column("id").fill_null(0).to_numpy()
                own["valid"] = first.column("id").is_valid().to_numpy(zero_copy_only=False)
                docs.append(own)
                first = next(batches, None)
        write_file(f"{name}.offsets", np.array(ends, "<u8").tobytes())
        write_file(f"{name}.docs", np.concatenate(docs).tobytes())
        yield pa.RecordBatch.from_pydict({"shard": [number], "name": [name], "kind": [kind], "docs": [len(ends) - 1], "tokens": [ends[-1]]}, pa.schema([("shard", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    shards, base = [], 0
    for row in sorted(sorted_rows.mapInArrow(textops.trimmed(shard), "shard int, name string, kind string, docs long, tokens long").collect()):
        shards.append({"name": row["name"], "kind": row["kind"], "docs": row["docs"], "tokens": row["tokens"], "base": base})
        base += row["tokens"]
    write_file(f"{folder}/manifest.json", json.dumps({"end_id": end_id, "tokens": base, "shards": shards}).encode())
    return shards


def read(spark: SparkSession, shards: list[dict]) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, from the memory-mapped files, a task for each shard."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                ids, offsets, docs = mapped(f"{shard['name']}.ids", shard["kind"]), mapped(f"{shard['name']}.offsets", "<u8"), mapped(f"{shard['name']}.docs", DOC)
                for i in range(0, len(docs), 50_000):
                    own, at = docs[i : i + 50_000], offsets[i : i + 50_001].astype(np.int64)
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(own["id"], pa.int64(), mask=own["valid"] == 0), pa.array(at[:-1] + shard["base"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame([(s["name"], s["kind"], s["base"]) for s in shards], "name string, kind string, base long")
    return listed.repartition(len(shards)).mapInArrow(textops.trimmed(documents), schema)


def round_trip(df: DataFrame, tokenizer: str, end_id: int, **options) -> DataFrame:
    folder = shared_folder(df.sparkSession, "tokens")
    return read(df.sparkSession, write(df, folder, tokenizer, end_id, **options))
