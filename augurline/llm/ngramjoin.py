"""Exact Jaccard join of word shingles by token-combination prefixes.

A document's tokens are its distinct shingles.  Tokens fall into classes by document frequency: unique ones, rare ones and
frequent ones, and are ordered by class, then by fingerprint.  A linked pair misses at most E = n - ceil(p n / 100) of a document's n
tokens at p percent, so it suffices to index a prefix of the order: E + 1 tokens where they are rare; where frequent ones are needed, the prefix
is extended and pairs of frequent tokens of the same group are indexed, as a + sum(max(0, f_g - 1)) > E for a rare tokens and f_g
frequent ones of group g means that a rare token or a pair is shared.  Unique tokens need no entry.  Groups depend on the size
level, and a document is entered in the two levels that documents of similar size can share.

Documents with equal sets are one node.  The nodes of an entry are candidates of each other.  Entries with the same smallest node,
their hub, form a star, so that the many entries of a group of near copies are one star or a few, and a pair that shares an entry meets
in one.  A star's whole sets are verified in chunks of bounded size: all pairs of a chunk, to which the hub comes as well.  Where a
star has several chunks, only strays, the nodes that their chunk doesn't connect with the hub, are compared with the other chunks;
the others are in the hub's component already.  Only a spanning forest of the links goes on.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augurline.llm import blocks as bl
from augurline.llm import graph, textops
from augurline.llm.cluster import joined, measured, shuffle_partitions, stored

BITS = 48
U64 = np.uint64


@functools.cache
def level_bounds(percent: int) -> np.ndarray:
    """The least size of each level; sizes of a linked pair are in one level or in neighbours."""
    levels = [1]
    while levels[-1] < 1 << 40:
        levels.append(max(levels[-1] + 1, -(-levels[-1] * 100 // percent)))
    return np.array(levels, np.int64)


def shingle_sets(column: pa.Array, size: int = 3) -> Iterator[np.ndarray]:
    """For each text the sorted fingerprints of its distinct shingles (of the whole sequence, if it is shorter; none without words)."""
    for _, _, texts in textops.slices(column):
        words = texts.words()
        runs = {n: textops.combined(words, n) for n in range(1, size + 1)}
        for a, b in zip(texts.first[:-1], texts.first[1:], strict=True):
            n = min(size, b - a)
            yield np.unique(runs[n][a : b - n + 1] + U64(n)) if n else np.zeros(0, U64)


def flat_sets(column: pa.ChunkedArray, size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The sets of all texts of a column in one array, and where each begins and the last one ends."""
    # a shingle for every two bytes at most; memory that isn't written to isn't taken
    flat = np.empty(sum(len(textops.buffers(c)[0]) + len(c) for c in column.chunks) // 2 + 1, U64)
    starts = [0]
    for chunk in column.chunks:
        for tokens in shingle_sets(chunk, size):
            starts.append(starts[-1] + len(tokens))
            flat[starts[-2] : starts[-1]] = tokens
    return flat[: starts[-1]], np.array(starts)


def edges(ascending: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end of the last one."""
    edge = np.ones(len(ascending) + 1, bool)
    np.not_equal(ascending[1:], ascending[:-1], out=edge[1:-1])
    return np.flatnonzero(edge)


def classes_of(rows: list[bl.Row], rare: int) -> Iterator[tuple[int, np.ndarray]]:
    """(block, class of each of its keys) of a bucket's rows, whose keys and counts are taken out of them.

    A bucket is the largest thing a task holds: three words for a key at a time, not a dozen.
    """
    keys = [bl.unpack(r.pop("keys")) for _, _, r in rows]
    sizes = [len(k) for k in keys]
    each = np.concatenate(keys)
    del keys
    order = np.argsort(each, kind="stable")
    each = each[order]
    first = edges(each)
    del each
    counts = np.concatenate([bl.unpack(r.pop("counts")).astype(np.uint32) for _, _, r in rows])[order]
    totals = np.add.reduceat(counts, first[:-1], dtype=U64) if len(counts) else np.zeros(0, U64)
    del counts
    kinds = (totals >= 2).astype(np.uint8) + (totals > rare)
    answer = np.empty(len(order), np.uint8)
    answer[order] = np.repeat(kinds, np.diff(first))
    del order, totals, kinds, first
    at = 0
    for (_, block, _), n in zip(rows, sizes, strict=True):
        yield block, answer[at : at + n]
        at += n


def node_of(tokens: np.ndarray) -> bytes:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        return b"".join(int(textops.mix(tokens * U64(m)).sum(dtype=U64) + U64(len(tokens))).to_bytes(8, "big", signed=False) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def level_of(n: int, percent: int) -> int:
    return int(np.searchsorted(level_bounds(percent), n, "right"))


def errors_of(n: int, percent: int) -> int:
    """The most tokens of a set of n that a linked set lacks."""
    return n * (100 - percent) // 100


def entries(tokens: np.ndarray, classes: np.ndarray, percent: int = 90) -> Iterator[int]:
    """The index entries of a set for both its levels; classes: 0 unique, 1 rare, 2 frequent."""
    n = len(tokens)
    errors = errors_of(n, percent)
    rare = tokens[classes == 1]
    n_unique = int((classes == 0).sum())
    singles = rare[: max(0, errors + 1 - n_unique)]
    enough = n_unique + len(rare) > errors
    frequent = tokens[classes == 2]
    for level in (level_of(n, percent), level_of(n, percent) + 1):
        salt = U64(level * 0x632BE59BD9B4E019 & (1 << 64) - 1)
        yield from textops.mix(singles + salt).tolist()
        if enough:
            continue
        groups = max(1, int(level_bounds(percent)[max(0, level - 2)]) * (100 - percent) // 200)
        group = (textops.mix(frequent) % U64(groups)).astype(np.int64)
        seen: dict[int, list[int]] = {}
        got = n_unique + len(rare)
        for token, g in zip(frequent.tolist(), group.tolist(), strict=True):
            own = seen.setdefault(g, [])
            got += bool(own)
            own.append(token)
            if got > errors:
                break
        pairs = [(a, b) for own in seen.values() for i, b in enumerate(own) for a in own[:i]]
        if pairs:
            both = np.array(pairs, U64)
            yield from textops.mix(textops.mix(both[:, 0] + salt) + both[:, 1]).tolist()


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
    return 100 * common >= percent * (len(a) + len(b) - common)


def link_forest(sets: list[np.ndarray], sides: list[int], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of different sides (or of all, with one side)."""
    if len(sets) == 2:
        return [(0, 1)] if alike(sets[0], sets[1], percent) else []
    size = np.array([len(s) for s in sets], np.float64)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    shared = np.bincount(token) > 1
    order = np.argsort(token[keep := np.flatnonzero(shared[token])], kind="stable")
    column = (np.cumsum(shared) - 1)[token[keep][order]]
    owner = owner[keep][order]
    common, width = np.zeros((len(sets), len(sets)), np.float32), 2048
    starts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + width + 1, width))
    for k, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        x = np.zeros((len(sets), min(width, int(column[-1]) + 1 - k * width)), np.float32)
        x[owner[a:b], column[a:b] - k * width] = 1
        common += x @ x.T
    linked = np.triu((100 + percent) * common.astype(np.float64) >= percent * (size[:, None] + size[None, :]), 1)
    if len(set(sides)) > 1:
        side = np.array(sides)
        linked &= side[:, None] != side[None, :]
    parent, out = list(range(len(sets))), []
    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = root(parent, int(i)), root(parent, int(j))
        if a != b:
            parent[b] = a
            out.append((int(i), int(j)))
    return out


def root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = i = parent[parent[i]]
    return i


def verified(dealt: DataFrame, percent: int, n_tasks: int) -> DataFrame:
    """(a, b) links and (a, hub) strays of the chunks of dealt: hub, i, j, whole, side, node, tokens.

    A chunk is what hub, i and j name; its sets of different sides are compared, or all of them if there is one side.  Unless whole
    is true, the nodes that aren't connected with the hub are strays.
    """
    kinds = ("hub", "i", "j", "whole", "side", "node", "tokens")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, found = None, {}, []

        def settle() -> None:
            nodes, sets, sides = [n for n, _ in held], list(held.values()), [s for _, s in held]
            links = link_forest(sets, sides, percent) if len(held) > 1 else []
            found.extend((nodes[a], nodes[b], None) for a, b in links)
            if not key[3]:
                parent = list(range(len(nodes)))
                for a, b in links:
                    parent[root(parent, b)] = root(parent, a)
                hub = root(parent, nodes.index(key[0]))
                found.extend((n, None, key[0]) for k, n in enumerate(nodes) if root(parent, k) != hub)

        def send() -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [()] * 3
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["a", "b", "hub"])

        for batch in batches:
            *names, tokens = (batch.column(c) for c in kinds)
            for k, (hub, i, j, whole, side, node) in enumerate(zip(*(c.to_pylist() for c in names), strict=True)):
                if key != (now := (hub, i, j, whole)):
                    if held:
                        settle()
                    if len(found) > 10_000:
                        yield send()
                    key, held = now, {}
                held[node, side] = np.frombuffer(tokens[k].as_buffer(), U64).copy()
        if held:
            settle()
        yield send()

    dealt = dealt.select(*kinds).repartition(n_tasks, "hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    return dealt.mapInArrow(textops.trimmed(task), "a binary, b binary, hub binary")


def join(
    docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90, rare: int = 32, chunk_bytes: int = 8 << 20, chunk: int = 256, block_bytes: int = 12 << 20, bucket_bytes: int = 48 << 20
) -> tuple[bl.Blocks, DataFrame]:
    """Blocks of all rows of docs, and for each row: block, pos, id, n_shingles, component_id, stays.

    component_id is the smallest id reachable by links; stays is true for one row of each component (smallest id, null last, then by
    place).  Rows without words have an empty set and are linked with nothing.  Null texts are empty; repeated rows are linked; ids are
    of any type with an order; other columns play no part, whatever their names; an empty table gives no rows; a very long text is a
    set like others, and a chunk holds one set at least.  Fingerprints of 64 bits stand for shingles.

    size: words of a shingle; percent: the least Jaccard similarity of a link; rare: the largest document frequency of a rare token;
    chunk_bytes, chunk: bytes and sets that a chunk holds on average; block_bytes, bucket_bytes: see blocks.py, larger ones suit larger executors.
    """
    # at 50 or less, sets of one and two tokens may be linked without an entry in common
    if size < 1 or not 50 < percent <= 100:
        raise ValueError("shingles have a word or more, and links more than 50 percent")
    spark = docs.sparkSession
    blocks = bl.write(docs, "join", text, block_bytes)
    n_buckets = max(shuffle_partitions(spark), -(-blocks.total_bytes // bucket_bytes))
    n_tasks = max(shuffle_partitions(spark), blocks.count)
    folder, rows_made = blocks.folder, F.count(F.lit(1)).alias("n")

    def emit(block: int) -> Iterator[tuple[int, dict[str, bytes]]]:
        flat, _ = flat_sets(bl.load(folder, block).column(text), size)
        flat >>= U64(64 - BITS)
        flat.sort()
        first = edges(flat)
        keys, counts = flat[first[:-1]], np.diff(first).astype(np.uint32)
        del flat, first
        for bucket, a, b in bl.cut(keys, n_buckets, BITS):
            yield bucket, {"keys": bl.pack(keys[a:b], True), "counts": bl.pack(counts[a:b])}

    def serve(bucket: int, rows: list[bl.Row]) -> Iterator[tuple[int, dict[str, bytes]]]:
        for block, classes in classes_of(rows, rare):
            yield block, {"classes": bl.pack(classes)}

    fields = f"kind int, block long, pos int, id {dict(docs.dtypes)[id_col]}, n long, node binary, entry long"

    def index(block: int, rows: list[bl.Row]) -> Iterator[pa.RecordBatch]:
        table = bl.load(folder, block)
        flat, starts = flat_sets(table.column(text), size)
        ids = table.column(id_col).combine_chunks()
        del table
        distinct = flat >> U64(64 - BITS)
        distinct.sort()
        distinct = distinct[edges(distinct)[:-1]]
        classes = np.concatenate([bl.unpack(r["classes"]).astype(np.uint8) for _, _, r in rows])
        nodes, sizes, found, owners = [], [], [], []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            tokens = flat[a:b]
            own = classes[np.searchsorted(distinct, tokens >> U64(64 - BITS))]
            nodes.append(node_of(tokens) if len(tokens) else None)
            sizes.append(len(tokens))
            if len(tokens) and (own == 0).sum() <= errors_of(len(tokens), percent):
                made = set(entries(tokens, own, percent))
                found += made
                owners += [len(nodes) - 1] * len(made)
        kinds = (pa.int32(), pa.int64(), pa.int32(), ids.type, pa.int64(), pa.binary(), pa.int64())
        names = ["kind", "block", "pos", "id", "n", "node", "entry"]
        n, m = len(nodes), len(found)
        yield pa.RecordBatch.from_arrays([ids if c is ids else pa.array(c, k) for c, k in zip(([0] * n, [block] * n, range(n), ids, sizes, nodes, [None] * n), kinds, strict=True)], names)
        signed = np.array(found, U64).view(np.int64)
        for i in range(0, m, 100_000):
            o = owners[i : i + 100_000]
            k = len(o)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([1] * k, [block] * k, o, [None] * k, [sizes[x] for x in o], [nodes[x] for x in o], signed[i : i + k]), kinds, strict=True)], names)

    answers = bl.served(bl.emitted(blocks, emit, ("keys", "counts")), n_buckets, serve, ("classes",))
    indexed = stored(bl.returned(answers, blocks, index, fields), "join-index")
    rows = indexed.where("kind = 0").select("block", "pos", "id", "n", "node")

    # Candidates: each node of an entry with the hub of that entry, its smallest node.
    entry = indexed.where("kind = 1").select("entry", "node", "n").distinct()
    entry, entries_made = measured(entry, "join-entries", rows_made)
    hubs = entry.groupBy("entry").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars, stars_made = measured(joined(entry.withColumnRenamed("n", "size"), hubs, "entry", entries_made["n"]).select("hub", "node", "size").distinct(), "join-stars", rows_made)
    place = rows.where("node is not null").groupBy("node").agg(F.min(F.struct("block", "pos")).alias("at"))

    def chunks(members: DataFrame, name: str) -> DataFrame:
        """hub, n (members), and the number of chunks that they need."""
        return members.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.expr(f"cast(greatest(ceil(8 * sum(size) / {chunk_bytes}), ceil(count(*) / {chunk})) as int)").alias(name))

    def with_sets(dealt: DataFrame) -> DataFrame:
        """hub, i, j, whole, side, node with the node's tokens, read from the first place of its set."""
        schema = "hub binary, i int, j int, whole boolean, side int, node binary, tokens binary"

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, column, pos, tokens = None, None, None, b""
            for batch in batches:
                own, held, first = [], 0, 0
                for k, (b, p) in enumerate(zip(batch.column("block").to_pylist(), batch.column("pos").to_pylist(), strict=True)):
                    if b != block:
                        block, column, pos = b, bl.load(folder, b).column(text).combine_chunks(), None
                    if p != pos:
                        pos, tokens = p, next(shingle_sets(column.slice(p, 1), size)).tobytes()
                    own.append(tokens)
                    held += len(tokens)
                    if held > chunk_bytes or k == batch.num_rows - 1:
                        part = batch.select(["hub", "i", "j", "whole", "side", "node"]).slice(first, len(own))
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own, pa.binary())], [*part.schema.names, "tokens"])
                        own, held, first = [], 0, k + 1

        located = dealt.join(place, "node").select("hub", "i", "j", "whole", "side", "node", "at.block", "at.pos")
        return located.repartition(n_tasks, "block").sortWithinPartitions("block", "pos").mapInArrow(textops.trimmed(fetch), schema)

    # Every chunk of a star has the hub.
    n_stars = stars_made["n"]
    starred = joined(stars, chunks(stars, "k"), "hub", n_stars)
    own_chunk = F.expr("if(node = hub, sequence(0, k - 1), array(cast(pmod(xxhash64(node), k) as int)))")
    dealt = starred.select("hub", F.explode(own_chunk).alias("i"), F.lit(0).alias("j"), F.expr("k = 1").alias("whole"), F.lit(0).alias("side"), "node")
    found = stored(verified(with_sets(dealt), percent, n_tasks), "join-links", texts=True)

    # Strays are compared with all nodes of their star.
    strays, strays_made = measured(found.where("hub is not null").select("hub", F.col("a").alias("node")).join(stars, ["hub", "node"]), "join-strays", rows_made)
    links = found.where("hub is null").select("a", "b")
    if strays_made["n"]:
        k_strays = chunks(strays, "s").drop("n")
        counted = chunks(stars, "k").join(k_strays, "hub")
        members = joined(stars, counted, "hub", n_stars)
        left = members.join(strays.select("hub", "node"), ["hub", "node"], "left_semi").select("hub", "node", F.expr("cast(pmod(xxhash64(node), s) as int)").alias("i"), F.explode(F.expr("sequence(0, k - 1)")).alias("j"), F.lit(0).alias("side"))
        right = members.select("hub", "node", F.explode(F.expr("sequence(0, s - 1)")).alias("i"), F.expr("cast(pmod(xxhash64(node), k) as int)").alias("j"), F.lit(1).alias("side"))
        more = left.unionByName(right).withColumn("whole", F.lit(True))
        links = links.unionByName(stored(verified(with_sets(more), percent, n_tasks), "join-links", texts=True).select("a", "b"))
    linked = stored(graph.components(links), "join-components")

    # The smallest id and place of each node, then of each component; rows without a node stand alone.
    head = F.struct(F.col("id").isNull().alias("none"), "id", "block", "pos")
    heads = rows.where("node is not null").groupBy("node").agg(F.min(head).alias("head"), F.count(F.lit(1)).alias("copies"))
    rooted = heads.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted, nodes_made = measured(rooted, "join-rooted", rows_made)
    tops = rooted.groupBy("root").agg(F.min("head").alias("top"), F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")).where("copies > 1").drop("copies")
    named = joined(rooted.select("node", "root"), tops, "root", nodes_made["n"]).select("node", "top")
    out = rows.join(named, "node", "left").select(
        "block", "pos", "id", F.col("n").alias("n_shingles"), F.when(F.col("top").isNull(), F.col("id")).otherwise(F.col("top.id")).alias("component_id"), (F.col("top").isNull() | ((F.col("top.block") == F.col("block")) & (F.col("top.pos") == F.col("pos")))).alias("stays")
    )
    return blocks, out


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without all but one row of each component, with their own columns."""
    blocks, found = join(docs, **options)
    folder = blocks.folder

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at = None, []
        for batch in batches:
            for b, pos in zip(batch.column("block").to_pylist(), batch.column("pos").to_pylist(), strict=True):
                if b != block and at:
                    yield from bl.load(folder, block).take(pa.array(at)).to_batches(max_chunksize=1000)
                    at = []
                block = b
                at.append(pos)
        if at:
            yield from bl.load(folder, block).take(pa.array(at)).to_batches(max_chunksize=1000)

    kept = found.where("stays").select("block", "pos")
    return kept.repartition(max(1, blocks.count), "block").sortWithinPartitions("block", "pos").mapInArrow(textops.trimmed(task), docs.schema)
