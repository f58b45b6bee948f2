"""The backoff model against a plain version: counts, base scores, exact normalisation, and gain on held-out texts."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from augurline.llm import katz


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


def plain(rows):
    train = [tokens(t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    c1 = Counter(w for t in train for w in t)
    c2 = Counter(p for t in train for p in zip(["</s>", *t[:-1]], t, strict=True))
    n, v = sum(c1.values()), len(c1)
    tally = lambda c: [0, *(sum(x == r for x in c.values()) for r in range(1, 7))]
    d1, d2 = katz.discounts(tally(c1)), katz.discounts(tally(c2))
    kept = sum((d1[c] if c <= 5 else 1) * c for c in c1.values())
    freed = n - kept if n - kept > 1e-9 else 1.0
    uni = lambda w: ((d1[c1[w]] if c1[w] <= 5 else 1) * c1[w] if c1[w] else freed) / (kept + freed)
    follow = defaultdict(dict)
    for (h, w), c in c2.items():
        follow[h][w] = c

    def prob(h, w):
        if not c1[h]:
            return uni(w)
        own = follow[h]
        lost = sum((1 - d2[c]) * c for c in own.values() if c <= 5)
        extra = 0 if lost > 1e-12 else 1
        total = c1[h] + extra
        if w in own:
            c = own[w]
            return (d2[c] if c <= 5 else 1) * c / total
        return (lost or 1) / total / (1 - sum(map(uni, own))) * uni(w)

    return c1, n, v, prob, follow


def plain_of_order(rows, order):
    """(log10 probability of a text, all words, probability) by recursion over histories as tuples."""
    train = [tokens(t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    grams = lambda t, k: [(tuple((["<b>"] * order + ["</s>"] + t)[order + i + 2 - k : order + i + 1]), w) for i, w in enumerate(t)]
    follow = {k: defaultdict(Counter) for k in range(1, order + 1)}
    for t in train:
        for k in follow:
            for h, w in grams(t, k):
                follow[k][h][w] += 1
    words = follow[1][()]
    n = sum(words.values())
    tally = lambda counts: [0, *(sum(x == r for x in counts) for r in range(1, 7))]
    d = {k: katz.discounts(tally([c for own in follow[k].values() for c in own.values()])) for k in follow}
    kept = sum((d[1][c] if c <= 5 else 1) * c for c in words.values())
    freed = n - kept if n - kept > 1e-9 else 1.0

    def prob(h, w):
        if not h:
            return ((d[1][words[w]] if words[w] <= 5 else 1) * words[w] if words[w] else freed) / (kept + freed)
        own = follow[len(h) + 1].get(h)
        if own is None:
            return prob(h[1:], w)
        lost = sum((1 - d[len(h) + 1][c]) * c for c in own.values() if c <= 5)
        total = sum(own.values()) + (0 if lost > 1e-12 else 1)
        if w in own:
            return (d[len(h) + 1][own[w]] if own[w] <= 5 else 1) * own[w] / total
        return (lost if lost > 1e-12 else 1) / total / (1 - sum(prob(h[1:], x) for x in own)) * prob(h[1:], w)

    return lambda t: sum(math.log10(prob(h, w)) for h, w in grams(t, order)), words, prob, follow


@pytest.mark.parametrize("order", [2, 3, 4])
def test_any_order_recurses(spark, order, monkeypatch):
    monkeypatch.setattr(katz, "HOT_PARTS", 3)
    rows = corpus(4)
    _, words, tables, _ = found = katz.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), order=order, block_bytes=9000)
    score, known, prob, follow = plain_of_order(rows, order)
    want = Counter((i, round(score(tokens(t)), 6)) for i, t in rows)
    assert Counter((r["doc_id"], round(r["score"], 6)) for r in found[0].collect()) == want
    assert sorted(tables) == list(range(2, order + 1))
    for k, table in tables.items():
        assert sorted(r["count"] for r in katz.gram_table(table).collect()) == sorted(c for own in follow[k].values() for c in own.values())
    for h in [*list(follow[order])[:30], ("never", "seen")[: order - 1]]:
        assert sum(prob(h, w) for w in [*known, "<unknown>"]) == pytest.approx(1, abs=1e-9)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(6000)]
    rows, at = [], 0
    while at < len(words):
        n = rng.randrange(1, 90)
        rows.append((len(rows), " ".join(["The", "THE cat"][len(rows) % 2 : 1 + len(rows) % 2] + words[at : at + n])))
        at += n
    return rows + [(1000, None), (1001, ""), (1002, "never-seen words here"), (5, "repeated id"), (7, rows[7][1]), (-3, "ÄÄ Ää é")]


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_equal_the_plain_model(spark, seed, monkeypatch):
    rows = corpus(seed)
    monkeypatch.setattr(katz, "HOT_PARTS", 3)
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, block int").repartition(3)
    got = katz.score(df)[0].collect()
    c1, n, v, prob, follow = plain(rows)
    want = Counter()
    for i, t in rows:
        own = tokens(t)
        base = sum(math.log10((c1[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        score = sum(math.log10(prob(h, w)) for h, w in zip(["</s>", *own[:-1]], own, strict=True))
        want[i, zlib.crc32(str(i).encode()) % 5 == 1, len(own), sum(c1[w] > 0 for w in own), n, round(base, 6), round(score, 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == want
    for h in [*list(follow)[:40], "</s>", "unseen"]:
        assert sum(prob(h, w) for w in [*c1, "<unknown>"]) == pytest.approx(1, abs=1e-9)


def test_tables_hold_all_counts(spark):
    rows = corpus(3)
    _, words, tables, model = katz.score(spark.createDataFrame(rows, "doc_id long, text string"))
    c1, n, v, _, follow = plain(rows)
    assert sorted(r["count"] for r in katz.word_table(words).collect()) == sorted(c1.values())
    table = katz.gram_table(tables[2]).collect()
    assert sorted(r["count"] for r in table) == sorted(c for own in follow.values() for c in own.values())
    assert Counter(Counter(r["history"] for r in table).values()) == Counter(len(own) for own in follow.values())
    assert (model.total, model.distinct) == (n, v)


def test_held_out_texts_gain(spark, sf):
    got = katz.score(spark.read.parquet(f"{sf}/documents.parquet"))[0].where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]


def test_edges(spark):
    schema = "doc_id long, text string"
    assert katz.score(spark.createDataFrame([], schema))[0].count() == 0
    assert [r["score"] for r in katz.score(spark.createDataFrame([(i, "a b") for i in range(30) if zlib.crc32(str(i).encode()) % 5 == 1], schema))[0].collect()] == [0.0] * sum(zlib.crc32(str(i).encode()) % 5 == 1 for i in range(30))
    assert katz.score(spark.createDataFrame([(None, "a b"), (None, None)], schema))[0].count() == 2


def test_discounts():
    d = katz.discounts([0, 1000, 400, 200, 120, 80, 55])
    assert all(0 < x <= 1 for x in d[1:])
    q = 6 * 55 / 1000
    assert d[1] == pytest.approx((2 * 400 / 1000 - q) / (1 - q))
    assert katz.discounts([0] * 7)[1] == 0.5
