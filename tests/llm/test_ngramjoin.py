"""The Jaccard join against brute force, for every class of tokens and chunk size."""

import random
import re
import time
import tracemalloc

import pytest

from augurline.llm import graph, ngramjoin


def brute(rows):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = min(3, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted((doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    rows = [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one"), (905, "one two"), (906, "One Two three"), (907, "one two THREE"), (908, "a a a a a a a")]
    passage = [word() for _ in range(60)]
    for family in range(12):
        base = [word() for _ in range(rng.choice([4, 11, 20, 31, 60, 150, 400]))]
        if family % 3 == 0:
            base += passage
        for _ in range(rng.choice([1, 3, 9])):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(2)] = [word()] * rng.randrange(2)
            rows.append((len(rows), " ".join(copy)))
    base = [word() for _ in range(90)]  # a large group of near copies: a chain of single changes and many versions of one text
    for i in range(60):
        copy = list(base)
        copy[rng.randrange(90)] = f"v{i}"
        if i % 2:
            copy[rng.randrange(90)] = f"u{i}"
        rows.append((len(rows), " ".join(copy)))
    chain = [word() for _ in range(120)]
    for i in range(40):
        chain[i * 3] = f"c{i}"
        rows.append((len(rows), " ".join(chain)))
    return rows


@pytest.mark.parametrize(("seed", "rare", "chunk"), [(1, 32, 512), (2, 1, 7), (3, 4, 10)])
def test_join_loses_and_invents_no_link(spark, seed, rare, chunk):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _, found = ngramjoin.join(df, rare=rare, chunk=chunk)
    got = found.collect()
    assert sorted((r["id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows)
    tops = {r["component_id"] for r in got}
    assert sum(r["stays"] for r in got) == len(tops)


def test_one_of_each_keeps_columns_ties_and_nulls(spark):
    rows = [(1, "a b c d", "x", 5), (1, "a b c d", "y", 6), (2, "A b c D", "z", 7), (None, "q r s", "n", 1), (None, "q r s", None, None), (3, None, "e", 0), (4, "", "e", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, block int")
    kept = ngramjoin.one_of_each(df)
    assert kept.schema == df.schema
    out = [tuple(r) for r in kept.collect()]
    assert len(out) == 4 and {r[0] for r in out} == {1, None, 3, 4} and set(out) <= set(rows)
    assert ngramjoin.one_of_each(df.limit(0)).count() == 0
    assert ngramjoin.one_of_each(df.where("text = ''")).count() == 1


def test_prefixes_cover_linked_pairs():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(2, 400))
        base = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        other = base[rng.random(len(base)) > rng.random() * 0.1]
        other = np.unique(np.concatenate([other, rng.integers(0, 1 << 63, int(len(base) * rng.random() * 0.05)).astype(np.uint64)]))
        both = len(np.intersect1d(base, other))
        if not len(other) or 100 * both < 90 * (len(base) + len(other) - both) or np.array_equal(base, other):
            continue
        mode = rng.integers(0, 3)

        def classes(tokens, mode=mode):
            shared = np.isin(tokens, base) & np.isin(tokens, other)
            c = np.where(tokens % np.uint64(5) < mode, 1, 2)
            return np.where(shared, c, np.where(tokens % np.uint64(2) == 0, 0, c))

        assert set(ngramjoin.entries(base, classes(base))) & set(ngramjoin.entries(other, classes(other)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(200, 230)] + [(1, k) for k in range(2, 60)] + [(100, 99), (7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 200 for i in range(200, 231)}, **{i: 1 for i in range(1, 60)}, 100: 99, 99: 99}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_at(rows, size, percent):
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        n = min(size, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set())
    name = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and name[i] != name[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                name = [name[j] if x == name[i] else x for x in name]
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[name[i]] = min(doc, least.get(name[i], doc))
    return sorted((doc, len(sets[i]), least[name[i]]) for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize(("size", "percent", "rare", "chunk"), [(5, 80, 32, 512), (5, 80, 1, 7), (2, 60, 2, 9)])
def test_join_at_other_sizes_and_percents(spark, size, percent, rare, chunk):
    rows = corpus(size + rare)
    _, found = ngramjoin.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size=size, percent=percent, rare=rare, chunk=chunk)
    assert sorted((r["id"], r["n_shingles"], r["component_id"]) for r in found.collect()) == brute_at(rows, size, percent)


def test_join_refuses_what_prefixes_do_not_cover(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for options in ({"percent": 50}, {"percent": 101}, {"size": 0}):
        with pytest.raises(ValueError):
            ngramjoin.join(df, **options)


def test_recomposed_texts_meet_in_small_stars(spark, monkeypatch):
    """Texts of sentences that many share are one candidate component; the work must follow the candidate pairs instead."""
    rng = random.Random(8)
    sentences = [" ".join(f"w{rng.randrange(5000)}" for _ in range(30)) for _ in range(600)]
    rows = [(i, " ".join(rng.sample(sentences, 12))) for i in range(600)]
    kept = {}
    plain = ngramjoin.measured
    monkeypatch.setattr(ngramjoin, "measured", lambda df, name, *figures: kept.setdefault(name, plain(df, name, *figures)))
    _, found = ngramjoin.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(r["component_id"] == r["id"] for r in found.collect())
    largest = kept["join-stars"][0].groupBy("hub").count().selectExpr("max(count)").first()[0]
    assert largest < 200  # a text shares sentences with some 140 others
    near = graph.components(kept["join-stars"][0].selectExpr("hub as a", "node as b"))
    assert near.select("root").distinct().count() < 20  # what all pairs of a candidate component would have met


def test_very_long_texts_and_ids_of_any_type(spark):
    rng = random.Random(3)
    long = [f"w{rng.randrange(10**6)}" for _ in range(150_000)]
    other = [w if rng.random() > 0.01 else "x" for w in long]
    rows = [("b", " ".join(long)), ("a", " ".join(other)), ("c", "unlike them all"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r["id"]: r["component_id"] for r in ngramjoin.join(df, chunk_bytes=1 << 20)[1].collect()}
    assert got == {"a": "a", "b": "a", "c": "c", None: None}


def test_hubs_of_any_share_are_joined(spark):
    from augurline.llm import cluster

    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(9000)], "k long, v long")
    keyed = rows.groupBy("k").count().selectExpr("k", "count as n", "k * 2 as w").where("k <> 3")
    got = sorted(tuple(r) for r in cluster.joined(rows, keyed, "k", 9000).collect())
    assert got == sorted((k, v, 2 * k) for k, v in ((r["k"], r["v"]) for r in rows.collect()) if k != 3)


def test_texts_come_in_small_batches_and_a_bucket_is_held_in_few_arrays(spark, monkeypatch, tmp_path):
    from augurline.llm import quality, textops

    plain, folder = textops.trimmed, str(tmp_path)

    def noted(task):
        def run(batches):
            sizes = [0]

            def seen():
                for batch in batches:
                    sizes.append(batch.nbytes)
                    yield batch

            tracemalloc.start()
            yield from task(seen())
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            with open(f"{folder}/{task.__qualname__.split('.')[0]}-{time.time_ns()}", "w") as out:
                out.write(f"{max(sizes)} {peak}")

        return plain(run)

    monkeypatch.setattr(textops, "trimmed", noted)
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(10**6):06d}" for _ in range(500)), "en") for i in range(1400)]  # one block of 5.6 MB, 700,000 words
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert ngramjoin.join(df)[1].where("stays").count() == 1400
        assert quality.keep_good(df, spark.createDataFrame([(0, 1)], "doc_id long, quality int")).count() == 1400
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    figures = {}
    for path in tmp_path.iterdir():
        size, peak = map(int, path.read_text().split())
        kind = path.name.split("-")[0]
        figures[kind] = tuple(map(max, figures.get(kind, (0, 0)), (size, peak)))
    assert figures["write"][0] < 2 << 20 and figures["measure"][0] < 2 << 20
    assert figures["served"][1] < 45 * 700_000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None
