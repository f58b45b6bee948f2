"""The pipeline against a plain version of all its stages, and what the stages promise."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from augurline.llm import decontam, quality
from tests.llm.test_ngramjoin import brute_at
from tests.llm.test_simple_ops import WORD, plain_features


@pytest.fixture(scope="module")
def corpus(spark, sf, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    bench = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rng, text = random.Random(4), lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    base = text(80)
    docs += [(10_000 + i, base.replace(base.split()[i], "new", 1), "en", "near", 0) for i in range(12)] + [(10_100, f"{text(30)} {bench[0]} {text(30)}", "en", "leak", 0), (10_101, None, None, None, None), (10_102, "", "de", "s", 0)]
    docs += [(20_000 + i, text(40) + ("".join(f" ##{rng.randrange(10**6)}$" for _ in range(20)) if i % 10 == 0 else ""), "en", "lab", 0) for i in range(1500)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(20_000 + i, int(i % 10 != 0), 0) for i in range(1500)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, bench


def test_pipeline_equals_plain_stages(spark, corpus):
    folder, docs, bench = corpus
    kept = []
    for d in docs:
        n, chars, symbols, dups, repeat = plain_features(d[1])
        text = d[1] or ""
        lines, capitals, bangs = sum(bool(WORD.search(x)) for x in text.split("\n")), sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text), text.count("!")
        worst = max(1000 * a // b if b else 0 for a, b in ((symbols, n), (bangs, n), (capitals, chars), (dups, lines), (repeat, n)))
        # of the labelled documents, those with symbols are bad, and the laxest cutoff rejects them all
        if n >= 20 and 100 * repeat <= 30 * n and not (d[2] == "en" and worst > 700):
            kept.append(d)
    first = corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert {r["doc_id"] for r in first.collect()} == {d[0] for d in kept}
    assert first.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    top = {doc for doc, _, component in brute_at([(d[0], d[1]) for d in kept if d[0] < 20_000], 5, 80) if doc == component}
    kept = [d for d in kept if d[0] in top or d[0] >= 20_000]
    patterns = decontam.windows_of((str(i), t) for i, t in enumerate(bench))
    windows = {n: set(p) for n, p in patterns.items()}

    def leaks(text):
        words = decontam.words_of(text)
        return any(tuple(words[i : i + n]) in of for n, of in windows.items() for i in range(len(words) - n + 1))

    kept = [d for d in kept if not leaks(d[1])]
    assert 10_100 not in {d[0] for d in kept} and sum(10_000 <= d[0] < 10_100 for d in kept) >= 1
    want = Counter()
    for d in kept:
        n = len(WORD.findall(d[1])) + 1
        for p in range((n - 1) // 2048 + 1):
            want[d[0], p, min(2048, n - 2048 * p)] += 1
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["piece"], r["n_tokens"]) for r in got) == want


def test_stages_take_empty_tables(spark, corpus):
    folder = corpus[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_cutoffs_hold_on_labels(spark, corpus):
    folder = corpus[0]
    cutoffs = quality.calibrate(quality.features(spark.read.parquet(f"{folder}/documents.parquet")), spark.read.parquet(f"{folder}/labels.parquet"))
    assert cutoffs == {"en": 700}


def test_near_duplicates_are_linked_by_five_words_at_80_percent(spark, corpus):
    words = [f"n{i}" for i in range(80)]
    # four changed neighbours: 0.857 of the 3-word and 0.810 of the 5-word shingles; four words apart: 0.583 of the latter
    text = lambda changed: " ".join("new" + w if i in changed else w for i, w in enumerate(words))
    rows = [(1, text(()), "en"), (2, text(range(30, 34)), "en"), (3, text((10, 30, 50, 70)), "en")]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), corpus[0])
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    docs = [d for d in corpus[1] if d[0] < 20_000]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), corpus[0])
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(doc for doc, _, component in brute_at([d[:2] for d in docs], 5, 80) if doc == component)
