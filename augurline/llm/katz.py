"""A Katz backoff language model over words, of any order.

Counts of n-grams are discounted by Good-Turing, and the mass that is freed after a history goes to the words not seen after it, in
proportion to their probability after the history without its first word, by backoff weights that make every distribution sum to 1.
The word distribution itself leaves its freed mass to one class of unknown words.

Documents are written as blocks.  A block asks for the counts of its distinct words, then, level by level, of its distinct n-grams, and
gets an answer for each; so training and scoring share these exchanges.  Words are named by 64-bit fingerprints until they are counted,
then by numbers; a counted n-gram gets a number too, by which it is a history of the next level.  From the answers a block works out
each token's probability recursively: the n-gram's where it was seen, else the backoff weight times the level below.  The tables of
words and n-grams are written to the shared folder, partitioned by bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augurline.llm import blocks as bl
from augurline.llm import textops
from augurline.llm.cluster import shuffle_partitions, stored

U64 = np.uint64
K = 5  # counts above this one aren't discounted
END = np.array([0xE17A1465EEDF00D5], U64)  # stands for the end of a text; no word has it but by chance
HOT_PARTS = 32


def discounts(n: list[int]) -> np.ndarray:
    """d[r] for r = 0..K, from the numbers n[r] of entries that occur r times (n[1] to n[K + 1]).

    Katz's d = (r*/r - q) / (1 - q) with r* = (r + 1) n[r+1] / n[r] and q = (K + 1) n[K+1] / n[1].  Where that is undefined or outside
    (0, 1] for any r, absolute discounting by n1 / (n1 + 2 n2) (by 1/2 without singletons) takes its place.
    """
    found = np.ones(K + 1)
    try:
        q = (K + 1) * n[K + 1] / n[1]
        for r in range(1, K + 1):
            found[r] = ((r + 1) * n[r + 1] / (r * n[r]) - q) / (1 - q)
    except ZeroDivisionError:
        found[1:] = -1
    if not ((found[1:] > 0) & (found[1:] <= 1)).all() or found[1] >= 1:
        cut = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        found[1:] = [(r - min(max(cut, 0.05), 0.95)) / r for r in range(1, K + 1)]
    return found


class Model:
    """The global numbers: tokens, distinct tokens, and the discounts of words and of the n-grams of each level."""

    def __init__(self, total: int, distinct: int, singles: list[int]):
        self.total, self.distinct = total, distinct
        self.word_d = discounts(singles)
        kept = float(total) - sum((1 - self.word_d[r]) * r * singles[r] for r in range(1, K + 1))
        freed = total - kept
        if freed <= 0:  # no word is rare: one pseudo-count makes room for the unknown
            freed = 1.0
        self.scale = kept + freed
        self.unknown = freed / self.scale if total else 1.0
        self.gram_d: dict[int, np.ndarray] = {}

    def word(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities of words by their counts; unknown words share one class."""
        c = counts.astype(np.float64)
        d = np.where(counts <= K, self.word_d[np.minimum(counts, K).astype(np.int64)], 1.0)
        return np.where(counts > 0, d * c / max(self.scale, 1.0), self.unknown)

    def history(self, level: int, count: np.ndarray, rare: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(factor, weight) per history: seen n-grams have factor * d * c / count, others weight * the probability one level below.

        count: occurrences of the history; rare[:, r - 1]: its n-grams that occur r times; seen: sum of their words' probabilities
        one level below.
        """
        r = np.arange(1, K + 1)
        freed = ((1 - self.gram_d[level][1:]) * r * rare).sum(axis=1)
        room = freed <= 0  # only frequent n-grams: one pseudo-count makes room
        total = count + np.where(room, 1.0, 0.0)
        left = np.where(room, 1.0, freed) / np.maximum(total, 1.0)
        return count / np.maximum(total, 1.0), np.where(count > 0, left / np.maximum(1.0 - seen, self.unknown), 1.0)


class Doc:
    """The tokens of a block: index into its distinct words (ascending fingerprints), with an end after each text."""

    def __init__(self, folder: str, block: int, id_col: str, text: str, fold: int, folds: int):
        table = bl.load(folder, block).combine_chunks()
        self.ids = table.column(id_col).to_pylist()
        self.held = np.array([crc32(str(i).encode()) % folds == fold if i is not None else False for i in self.ids], bool)
        parts, sizes = [], []
        for _, _, texts in textops.slices(table.column(text)):
            parts.append(np.insert(texts.words(), texts.first[1:], END))
            sizes.append(texts.n_words + 1)
        tokens, self.n = np.concatenate([np.zeros(0, U64), *parts]), np.concatenate([np.zeros(0, np.int64), *sizes])
        self.words, self.at = np.unique(tokens, return_inverse=True)
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        self.trained = np.repeat(~self.held, self.n)
        # each text begins after an end
        self.before = np.roll(self.at, 1)
        self.before[self.first[:-1]] = np.searchsorted(self.words, END[0])

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.first[:-1]) if len(self.ids) else np.zeros(0)


def merged(arrays: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all keys, their order, starts of equal keys in that order, summed counts)."""
    keys = np.concatenate(arrays)
    order = np.argsort(keys, kind="stable")
    if not len(keys):
        return keys, order, order, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    return keys, order, first, np.add.reduceat(np.concatenate(counts).astype(np.int64)[order], first)


def spread(values: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each key in its old place the value of its group."""
    out = np.empty(len(order), values.dtype)
    out[order] = np.repeat(values, np.diff(np.append(first, len(order))))
    return out


def tallies(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[: K + 2].tolist()


def parts_of(history: np.ndarray, n_buckets: int) -> np.ndarray:
    """The buckets, a row for each history, that hold the parts of a hot history."""
    return ((textops.mix(history.astype(U64))[:, None] + np.arange(HOT_PARTS, dtype=U64)[None, :]) % U64(n_buckets)).astype(np.int64)


class Grams:
    """A block's distinct n-grams of one level, as histories and words, in order of bucket, history and word.

    An n-gram is at home in a bucket by its history; the n-grams of a hot history, one with more than half a bucket's share of all
    tokens, are dealt over HOT_PARTS buckets by the word, and a block asks all of these for that history's sums.  There are at most
    2 * n_buckets hot histories in a level, and a count alone tells them.
    """

    def __init__(self, doc: Doc, before: np.ndarray, heads: np.ndarray, head_counts: np.ndarray, numbers: np.ndarray, counts: np.ndarray, total: int, n_buckets: int):
        # before: for each token the index of its history; heads and numbers: of histories and words
        n = max(1, len(doc.words))
        gram, place, inverse = np.unique(before.astype(np.int64) * n + doc.at, return_index=True, return_inverse=True)
        h, w = np.divmod(gram, n)
        hot = head_counts.astype(np.float64) * 2 * n_buckets > total
        part = np.where(hot[h], textops.mix(numbers[w].astype(U64)) % U64(HOT_PARTS), U64(0))
        bucket = ((textops.mix(heads[h].astype(U64)) + part) % U64(n_buckets)).astype(np.int64)
        bucket[(head_counts[h] == 0) | (counts[w] == 0)] = n_buckets  # such an n-gram can't be known
        order = np.lexsort([numbers[w], heads[h], bucket])
        self.heads = heads
        self.h, self.w, self.place, bucket = h[order], w[order], place[order], bucket[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.at = rank[inverse]  # for each token its n-gram
        self.ends = np.searchsorted(bucket, np.arange(n_buckets + 1))
        known = np.unique(h[head_counts[h] > 0]) if len(h) else h
        often, seldom = known[hot[known]], known[~hot[known]]
        homes = np.stack([(textops.mix(heads[seldom].astype(U64)) % U64(n_buckets)).astype(np.int64), seldom])
        more = np.stack([parts_of(heads[often], n_buckets).ravel(), np.repeat(often, HOT_PARTS)])
        # (bucket, history) for all sums that the block needs, in order of bucket and number
        self.sums = np.unique(np.concatenate([homes, more], axis=1), axis=1)
        self.sums = self.sums[:, np.lexsort([heads[self.sums[1]], self.sums[0]])]
        self.sum_ends = np.searchsorted(self.sums[0], np.arange(n_buckets + 1))

    def bucket(self, b: int) -> tuple[slice, np.ndarray]:
        return slice(self.ends[b], self.ends[b + 1]), self.sums[1, self.sum_ends[b] : self.sum_ends[b + 1]]


def score(
    docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", order: int = 2, folds: int = 5, fold: int = 1, block_bytes: int = 12 << 20, bucket_bytes: int = 24 << 20
) -> tuple[DataFrame, DataFrame, dict[int, DataFrame], Model]:
    """Train on the rows whose crc32 of the id (as text) modulo folds isn't fold and score all rows.

    Returns the scores (id_col, held_out, n_tokens, n_known, train_tokens, base_score, score in log10), the stored tables of words and,
    by level from 2 to order, of n-grams (see word_table and gram_table) and the model's global numbers.  Null and empty texts have one
    token, the end; rows with a null id are trained on; repeated rows count as often as they occur; without training rows every token
    is unknown and scores log10(1).  Whole texts are scored, however long; other columns are ignored, whatever their names; an empty
    table gives no rows.  block_bytes, bucket_bytes: see blocks.py, larger ones suit larger executors.
    """
    if order < 2:
        raise ValueError("the order must be 2 or more")
    spark = docs.sparkSession
    blocks = bl.write(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")), "katz", most=block_bytes)
    folder = blocks.folder
    n_buckets = max(shuffle_partitions(spark), -(-blocks.total_bytes // bucket_bytes))

    def of(block: int) -> Doc:
        return Doc(folder, block, "id", "text", fold, folds)

    def ask_words(block: int) -> Iterator[tuple[int, dict[str, bytes]]]:
        doc = of(block)
        counts = np.bincount(doc.at[doc.trained], minlength=len(doc.words))
        for bucket, a, b in bl.cut(doc.words, n_buckets, 64):
            yield bucket, {"keys": bl.pack(doc.words[a:b], True), "counts": bl.pack(counts[a:b])}

    def count_words(bucket: int, rows: list[bl.Row]) -> Iterator[tuple[int, dict[str, bytes]]]:
        each = [bl.unpack(r["keys"]) for _, _, r in rows]
        keys, order_, first, totals = merged(each, [bl.unpack(r["counts"]) for _, _, r in rows])
        numbers = numbered(totals, keys[order_][first], bucket, n_buckets)
        counts, named = spread(totals, order_, first), spread(numbers, order_, first)
        stats = np.array([totals.sum(), (totals > 0).sum(), *tallies(totals)], np.int64).tobytes()
        yield -1, {"numbers": bl.pack(numbers), "counts": bl.pack(totals), "stats": stats}
        at = 0
        for (_, block, _), own in zip(rows, each, strict=True):
            s = slice(at, at := at + len(own))
            yield block, {"numbers": bl.pack(named[s]), "counts": bl.pack(counts[s]), "stats": b""}

    words = stored(bl.served(bl.emitted(blocks, ask_words, ("keys", "counts")), n_buckets, count_words, ("numbers", "counts", "stats")), "katz-words")
    sums = totalled(words)
    total, distinct, singles = int(sums[0]), int(sums[1]), sums[2:].tolist()
    model = Model(total, distinct, singles)

    def replayed(block: int, rows: list[bl.Row], upto: int) -> tuple[Doc, np.ndarray, np.ndarray, np.ndarray, Grams | None]:
        """(texts, word counts, word numbers, each token's probability at the level before upto, n-grams of level upto).

        Beyond the order there are no n-grams to ask for.
        """
        doc = of(block)
        mine = {k: [(b, r) for b, _, r in rows if r["level"] == k] for k in range(1, upto)}
        numbers, counts = (np.concatenate([bl.unpack(r[f]) for _, r in mine[1]]).astype(np.int64) for f in ("numbers", "counts"))
        before, heads, head_counts, p = doc.before, numbers, counts, model.word(counts)[doc.at]
        for level in range(2, upto + 1):
            if level > order:
                break
            own = Grams(doc, before, heads, head_counts, numbers, counts, total, n_buckets)
            if level == upto:
                return doc, counts, numbers, p, own
            rare, seen = np.zeros((len(heads), K), np.int64), np.zeros(len(heads))
            found, named = np.zeros(len(own.h), np.int64), np.zeros(len(own.h), np.int64)
            for b, r in mine[level]:
                s, asked = own.bucket(b)
                found[s] = bl.unpack(r["answers"])
                if level < order:
                    named[s] = bl.unpack(r["numbers"])
                rare[asked] += bl.unpack(r["rare"]).astype(np.int64).reshape(-1, K)
                seen[asked] += np.frombuffer(bl.zstandard.decompress(r["seen"]), np.float64)
            factor, weight = model.history(level, head_counts.astype(np.float64), rare, seen)
            # recursion: the n-gram where it was seen, else the history's backoff weight times the level below
            d = np.where(found <= K, model.gram_d[level][np.minimum(found, K)], 1.0)
            p = np.where(found > 0, factor[own.h] * d * found / np.maximum(head_counts[own.h], 1), weight[own.h] * p[own.place])[own.at]
            # an n-gram is the next token's history; the history of a text's first token has number 0 and each text's end for a count
            before = np.roll(own.at, 1)
            before[doc.first[:-1]] = len(own.h)
            ends = counts[np.searchsorted(doc.words, END[0])] if len(doc.words) else 0
            heads, head_counts = np.append(named, 0), np.append(found, ends)
        return doc, counts, numbers, p, None

    def asking(level: int):
        def ask(block: int, rows: list[bl.Row]) -> Iterator[pa.RecordBatch]:
            doc, counts, numbers, p, grams = replayed(block, rows, level)
            heads = grams.heads
            trained = np.bincount(grams.at[doc.trained], minlength=len(grams.h))
            for b in range(n_buckets):
                s, asked = grams.bucket(b)
                if not len(asked):
                    continue
                at = np.searchsorted(heads[asked], heads[grams.h[s]])
                weights = bl.pack(counts[grams.w[s]]) if level == 2 else bl.zstandard.compress(p[grams.place[s]].tobytes(), 1)
                yield bl.row_batch(b, block, {"heads": bl.pack(heads[asked], True), "lengths": bl.pack(np.bincount(at, minlength=len(asked))), "words": bl.pack(numbers[grams.w[s]]), "weights": weights, "counts": bl.pack(trained[s])})

        return ask

    def counting(level: int):
        def count(bucket: int, rows: list[bl.Row]) -> Iterator[tuple[int, dict[str, bytes]]]:
            heads = [bl.unpack(r["heads"]) for _, _, r in rows]
            own = [np.repeat(h, bl.unpack(r["lengths"]).astype(np.int64)) for h, (_, _, r) in zip(heads, rows, strict=True)]
            all_heads, at = np.unique(np.concatenate(heads), return_inverse=True)
            all_words, w = np.unique(np.concatenate([bl.unpack(r["words"]) for _, _, r in rows]), return_inverse=True)
            h = np.searchsorted(all_heads, np.concatenate(own)).astype(np.int64)
            keys, order_, first, totals = merged([h * max(1, len(all_words)) + w], [np.concatenate([bl.unpack(r["counts"]) for _, _, r in rows])])
            at_first = order_[first]
            if level == 2:
                weight = model.word(np.concatenate([bl.unpack(r["weights"]) for _, _, r in rows])[at_first].astype(np.int64))
            else:
                weight = np.concatenate([np.frombuffer(bl.zstandard.decompress(r["weights"]), np.float64) for _, _, r in rows])[at_first]
            seen = totals > 0
            sums = np.bincount(h[at_first][seen], weight[seen], minlength=len(all_heads))
            rare = np.zeros((len(all_heads), K), np.int64)
            few = seen & (totals <= K)
            np.add.at(rare, (h[at_first][few], totals[few] - 1), 1)
            answer = spread(totals, order_, first)
            none = dict.fromkeys(ANSWERS, b"")
            kept = at_first[seen]
            yield -1, none | {"heads": bl.pack(all_heads[h[kept]], True), "words": bl.pack(all_words[w[kept]]), "totals": bl.pack(totals[seen]), "stats": np.array(tallies(totals), np.int64).tobytes()}
            if level < order:
                named = spread(np.where(seen, numbered(totals, keys[at_first], bucket, n_buckets) + 1, 0), order_, first)
            i = j = 0
            for (_, block, _), asked, mine in zip(rows, heads, own, strict=True):
                s, t = slice(i, i := i + len(mine)), slice(j, j := j + len(asked))
                yield block, none | {"answers": bl.pack(answer[s]), "numbers": bl.pack(named[s]) if level < order else b"", "rare": bl.pack(rare[at[t]].ravel()), "seen": bl.zstandard.compress(sums[at[t]].tobytes(), 1)}

        return count

    answers = words.where("block >= 0").select("bucket", "block", F.lit(1).alias("level"), "numbers", "counts")
    tables: dict[int, DataFrame] = {}
    for level in range(2, order + 1):
        asked = bl.returned(answers, blocks, asking(level), bl.schema(("heads", "lengths", "words", "weights", "counts")))
        tables[level] = stored(bl.served(asked, n_buckets, counting(level), ANSWERS), f"katz-{level}-grams")
        model.gram_d[level] = discounts(totalled(tables[level], K + 2).tolist())
        own = tables[level].where("block >= 0").select("bucket", "block", F.lit(level).alias("level"), "numbers", "answers", "rare", "seen")
        answers = answers.unionByName(own, allowMissingColumns=True)

    def evaluate(block: int, rows: list[bl.Row]) -> Iterator[pa.RecordBatch]:
        doc, counts, _, p, _ = replayed(block, rows, order + 1)
        base = np.log10((counts + 0.5) / (total + 0.5 * (distinct + 1)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc.ids), pa.array(doc.held), pa.array(doc.n, pa.int64()), pa.array(doc.sums((counts > 0)[doc.at].astype(np.int64)), pa.int64()), pa.array([total] * len(doc.ids), pa.int64()), pa.array(doc.sums(base[doc.at])), pa.array(doc.sums(np.log10(p)))],
            ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    kind = dict(docs.dtypes)[id_col]
    scores = bl.returned(answers, blocks, evaluate, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scores.withColumnRenamed("id", id_col), words, tables, model


ANSWERS = ("answers", "numbers", "rare", "seen", "heads", "words", "totals", "stats")


def numbered(totals: np.ndarray, keys: np.ndarray, bucket: int, n_buckets: int) -> np.ndarray:
    """Numbers of a bucket's keys that no other bucket gives; frequent ones get small numbers."""
    rank = np.empty(len(totals), np.int64)
    rank[np.lexsort([keys, -totals])] = np.arange(len(totals))
    return rank * n_buckets + bucket


def totalled(table: DataFrame, n: int = K + 4) -> np.ndarray:
    """The sum of the buckets' statistics; a row for each bucket reaches the driver."""
    rows = table.where("block = -1").select("stats").collect()
    return np.sum([np.zeros(n, np.int64), *(np.frombuffer(r["stats"], np.int64) for r in rows)], axis=0)


def word_table(words: DataFrame) -> DataFrame:
    """(bucket, word, count) of the model's words, by number."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, _, r in bl.rows_of(batches):
            numbers, counts = bl.unpack(r["numbers"]), bl.unpack(r["counts"])
            yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(numbers), pa.int32()), pa.array(numbers.astype(np.int64)), pa.array(counts.astype(np.int64))], ["bucket", "word", "count"])

    return words.where("block = -1").mapInArrow(task, "bucket int, word long, count long").where("count > 0")


def gram_table(grams: DataFrame) -> DataFrame:
    """(bucket, history, word, count) of the n-grams of one level; histories and words by number."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, _, r in bl.rows_of(batches):
            heads, words, totals = bl.unpack(r["heads"]), bl.unpack(r["words"]), bl.unpack(r["totals"])
            yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(heads), pa.int32()), *(pa.array(x.astype(np.int64)) for x in (heads, words, totals))], ["bucket", "history", "word", "count"])

    return grams.where("block = -1").mapInArrow(task, "bucket int, history long, word long, count long")
