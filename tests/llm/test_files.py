"""Token files and WARC archives: round trips, ties, nulls, retries."""

import base64
import hashlib
import json
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from augurline.llm import tokenfiles, warc
from augurline.llm.cluster import filesystem, read_file, shared_folder

PATH = public_tokenizers.path("word_bpe_49k.json")
TRICKY = [
    None, "", " \t\n", "Don't you'Re it's THE'S, x.'s ok", "É́ é É ́a İstanbul ΑΣ ΑΣ, ﬁ", "a<|endoftext|>b <|ENDOFTEXT|> <|endoftext|>", "abc123,,!! 12ab.# $%&x *&", "\x1ca\x1cb\x85c\xa0d　e", "x" * 3000, "wörd " * 2000, "a,b,c a, ,a ,, '' ','", "日本語、テキスト。", "!!!??? ... ... a...b..."
]


def test_word_lookup_equals_the_tokenizer(spark, sf):
    plain, own = Tokenizer.from_file(PATH), tokenfiles.WordEncoder(PATH)
    texts = [t or "" for t in TRICKY] + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(150).collect()]
    for t in texts:
        assert np.frombuffer(own.encode(t.encode()), own.kind).tolist() == plain.encode(t, add_special_tokens=False).ids, t[:80]


def test_other_tokenizers_encode_whole_texts(tmp_path):
    definition = json.loads(open(PATH).read())
    assert tokenfiles.word_wise(definition)
    definition["normalizer"] = None  # cased
    (tmp_path / "cased.json").write_text(json.dumps(definition))
    for path in (str(tmp_path / "cased.json"), public_tokenizers.path("byte_bpe_50k.json")):
        own, plain = tokenfiles.WordEncoder(path), Tokenizer.from_file(path)
        assert not own.by_word
        for t in TRICKY:
            t = t or ""
            assert np.frombuffer(own.encode(t.encode()), own.kind).tolist() == plain.encode(t, add_special_tokens=False).ids


def test_generations_of_words(sf):
    plain, own = Tokenizer.from_file(PATH), tokenfiles.WordEncoder(PATH, most=3)
    for i in range(40):
        t = f"the cat{i % 7}, the dog{i % 5}!! a{i % 3}. the"
        assert np.frombuffer(own.encode(t.encode()), own.kind).tolist() == plain.encode(t, add_special_tokens=False).ids


def test_ids_must_be_whole_numbers(spark):
    with pytest.raises(TypeError):
        tokenfiles.round_trip(spark.createDataFrame([("a", "b")], "doc_id string, text string"), PATH, 2)


def test_token_files(spark, sf):
    rows = [(i * 7 % 13, t) for i, t in enumerate(TRICKY)] + [(3, "again"), (3, "again"), (None, "no id"), (-4, "first")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = shared_folder(spark, "test")
    shards = tokenfiles.write(df, folder, PATH, 2, n_shards=4)
    got = tokenfiles.read(spark, shards).collect()
    tokenizer, at, want = Tokenizer.from_file(PATH), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((w[0], w[2], w[3]) for w in want)
    single = {r["doc_id"]: r["start"] for r in got if r["doc_id"] != 3}
    assert all(single[w[0]] == w[1] for w in want if w[0] != 3)
    manifest = json.loads(read_file(f"{folder}/manifest.json"))
    assert manifest["tokens"] == at and [s["base"] for s in manifest["shards"]] == list(np.cumsum([0, *(s["tokens"] for s in shards)])[:-1])
    fs, path = filesystem(folder)
    assert not [f for f in fs.get_file_info(__import__("pyarrow.fs").fs.FileSelector(path)) if ".tmp-" in f.path]
    assert tokenfiles.round_trip(df.limit(0), PATH, 2).count() == 0


@pytest.fixture()
def pages(spark, sf):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    rows += [(10**6 + i, "http://e.example/a b\nc" if i % 2 else None, t) for i, t in enumerate([None, "", rows[3][2], rows[3][2], "€\r\n\r\nWARC/1.1", "dup", "dup", "x" * 300_000])]
    rows += [(10**6 + 5, "u", "dup"), (10**6 + 5, "u", "dup"), (None, None, "dup"), (None, None, "only"), (-3, "u", "late first")]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")


def test_archives(spark, pages):
    rows, df = pages
    folder = shared_folder(spark, "test")
    files = warc.write(df.repartition(5), folder, n_shards=3, roll_bytes=20_000)
    assert len(files) > 3
    got = warc.read(spark, files).collect()
    least = {}
    for page, _, html in rows:
        if page is not None:
            least[html or ""] = min(page, least.get(html or "", page))
    want, seen = Counter(), set()
    for page, _, html in rows:
        data, first = (html or "").encode(), least.get(html or "")
        response = first is None or (first == page and (page, html or "") not in seen)
        seen.add((page, html or ""))
        want[page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else first] += 1
    assert Counter(map(tuple, got)) == want
    again = warc.write(df.repartition(2), shared_folder(spark, "test"), n_shards=3, roll_bytes=20_000)
    assert [f["sha256"] for f in again] == [f["sha256"] for f in files]  # the same bytes, however the input is partitioned
    payloads = Counter(html or "" for _, _, html in rows)
    read = [warc.parse(m) for f in files for m in warc.members(f["name"])]
    assert {p[6].decode() for p in read if p[3] == "response"} == set(payloads)
    small = warc.round_trip(df, min_bytes=1000, n_shards=2)
    assert small.where("payload_bytes < 1000 and record_type = 'revisit'").count() == 0
    assert small.where("record_type = 'revisit'").count() > 0
    assert warc.round_trip(df.limit(0)).count() == 0


def test_packed_batches_hold_the_tokens(spark, sf):
    from collections import defaultdict

    from augurline.llm import packing

    rows = [(i * 7 % 13, t) for i, t in enumerate(TRICKY)] + [(3, "again"), (3, "again"), (None, "no id")]
    rows += [(100 + i, " ".join(["word"] * n)) for i, n in enumerate([1, 5, 40, 41, 300, 65, 64, 63])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shards = tokenfiles.write(df, shared_folder(spark, "test"), PATH, 2, n_shards=3)
    found = packing.pack_files(spark, shards, shared_folder(spark, "test"), max_tokens=64, n_buckets=4, token_budget=256).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter((doc, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])) for doc, t in rows)
    pieces, batches = defaultdict(dict), defaultdict(list)
    for r in found:
        ids = np.frombuffer(read_file(r["name"]), shards[0]["kind"])[r["start"] : r["start"] + r["n_tokens"]]
        assert r["n_tokens"] <= r["bucket_len"] <= 64
        pieces[r["doc_id"]].setdefault(r["piece"], []).append(tuple(ids.tolist()))
        batches[r["bucket_len"], r["batch"]].append((r["slot"], r["name"], r["start"]))
    for (length, _), slots in batches.items():
        slots.sort()
        assert [s[0] for s in slots] == list(range(len(slots))) and len(slots) <= 256 // length
        assert len({s[1] for s in slots}) == 1 and [s[2] for s in slots] == sorted(s[2] for s in slots)  # a batch is one stretch
    single = {doc: texts for doc, texts in pieces.items() if sum(d == doc for d, _ in want.elements()) == 1}
    for doc, own in single.items():
        assert want[doc, tuple(x for k in sorted(own) for x in own[k][0])] == 1
    assert sum(r["n_tokens"] for r in found) == sum(len(ids) * n for (_, ids), n in want.items())
    assert packing.pack_files(spark, [], shared_folder(spark, "test")).count() == 0
