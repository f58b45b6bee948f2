"""Quality rules with risk-controlled thresholds.

Features are counted over whole texts, and a document's score is the largest of their ratios.  In each stratum, cutoffs of the score are
tried on labelled documents one after another, from the laxest: a cutoff is certified if, by an exact binomial test, the share of good
documents that it rejects, for whatever feature, is below a limit.  The sequence ends at the first cutoff that fails, so its tests need
no division of the level between them (fixed-sequence testing); between the strata with labels the level is divided (Bonferroni).  All
labelled documents take part in the tests, since the sequence and its order are fixed beforehand and nothing is learned from them but
where it ends; of the certified cutoffs, all of which keep the limit at once, the one that separates best takes effect.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from augurline.llm import textops
from augurline.llm.cluster import stored

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
CAPITALS = np.zeros(256, bool)
CAPITALS[65:91] = True
BANGS = np.zeros(256, bool)
BANGS[ord("!")] = True
LETTERS = (np.arange(256) & 0xC0) != 0x80
LETTERS[textops.SPACE] = False
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_bangs", "n_lines")

#: A feature's value is 1000 times a ratio, rounded down; larger is worse.  Cutoffs, from the laxest: reject above.
RATIOS = {
    "symbols": ("n_symbols", "n_words"),
    "bangs": ("n_bangs", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}
GRID = (700, 500, 400, 300, 200, 150, 100, 50, 20)
STRATA = ("en", "de", "fr", "es")


def repeated_words(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text, the words inside windows of 8 words that occur twice or more in it."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return np.zeros(len(first) - 1, np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    keys = textops.mix(textops.combined(words, WINDOW) + text[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    keys = keys[inside := np.flatnonzero(text[:n] == text[WINDOW - 1 :])]
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    change = np.zeros(len(words) + 1, np.int32)
    at = inside[again]
    change[at] += 1
    np.subtract.at(change, at + WINDOW, 1)
    sums = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
    return np.diff(sums[first])


def measure(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The columns of the batches besides the text, and COUNTS."""
    for batch in textops.small_batches(batches, text):
        for i, j, texts in textops.slices(batch.column(text)):
            lines, dups = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for k in range(len(texts)):
                own = [x for x in texts.bytes_of(k).split(b"\n") if x.strip()]
                lines[k], dups[k] = len(own), len(own) - len(set(own))
            counts = (
                texts.n_words, texts.counted(LETTERS), texts.counted(SYMBOLS), dups, repeated_words(texts.words(lowered=False), texts.first), texts.counted(CAPITALS), texts.counted(BANGS), lines,
            )
            kept = batch.drop_columns([text]).slice(i, j - i)
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, pa.int64()) for c in counts)], [*kept.schema.names, *COUNTS])


def features(df: DataFrame, *, id_col: str = "doc_id", stratum: str = "lang", text: str = "text") -> DataFrame:
    """One row per row of df: id, stratum and COUNTS.

    A null text has no words; repeated rows stay; other columns are ignored, whatever their names; an empty table gives no rows; very
    long texts are measured whole.
    """
    slim = df.select(F.col(id_col).alias("id"), F.col(stratum).alias("stratum"), F.col(text).alias("text"))
    schema = ", ".join(["id " + dict(slim.dtypes)["id"], "stratum " + dict(slim.dtypes)["stratum"], *(f"{c} long" for c in COUNTS)])
    return slim.mapInArrow(textops.trimmed(measure), schema)


def ratio(name: str) -> Column:
    a, b = RATIOS[name]
    return F.expr(f"coalesce(1000 * {a} div {b}, 0)")


def score() -> Column:
    return F.greatest(*(ratio(name) for name in RATIOS))


def stratum_of(column: str, strata: tuple[str, ...]) -> Column:
    return F.when(F.col(column).isin(*strata), F.col(column)).otherwise("other")


def base_failed(max_repeat: int = 30, min_words: int = 20) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))


def binomial_cdf(x: int, n: int, p: float) -> float:
    """P(X <= x) of n draws with probability p, exactly summed."""
    if x >= n:
        return 1.0
    terms = [lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log1p(-p) for k in range(x + 1)]
    top = max(terms)
    return min(1.0, exp(top) * sum(exp(t - top) for t in terms))


def certified(counts: dict[str, dict[int, tuple[int, int]]], sizes: dict[str, int], *, limit: float = 0.01, level: float = 0.05) -> dict[str, int]:
    """The cutoff of each stratum that has a certified one.

    counts: for each cutoff the good and bad documents above it; sizes: good documents of each stratum.  A test rejects if
    P(Bin(n, limit) <= rejected good documents) <= level / strata.  With probability 1 - level, no stratum loses more than the limit.
    The best cutoff has the most bad less good rejections; the laxer wins ties.
    """
    chosen, strata = {}, sum(n > 0 for n in sizes.values())
    for stratum, of in sorted(counts.items()):
        n, found = sizes.get(stratum, 0), []
        for cutoff, (good, bad) in sorted(of.items(), reverse=True):
            # far from the limit no sum is needed, and none gets long
            if not n or good > limit * n or binomial_cdf(good, n, limit) > level / strata:
                break
            if bad > good:
                found.append((bad - good, cutoff))
        if found:
            chosen[stratum] = max(found)[1]
    return chosen


def calibrate(measured: DataFrame, labels: DataFrame, *, strata: tuple[str, ...] = STRATA, limit: float = 0.01, level: float = 0.05) -> dict[str, int]:
    """Cutoffs from all labelled documents that pass the base rules.

    measured: rows with id, stratum and COUNTS; labels: doc_id and quality (1 good, 0 bad; null says nothing; a document with both
    counts as good).  Strata besides those named are one, 'other'.  Only one row per stratum reaches the driver.
    """
    known = labels.where("quality is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"))
    held = measured.where(~base_failed()).join(known, "id").select(stratum_of("stratum", strata).alias("stratum"), (F.col("quality") > 0).alias("good"), score().alias("score"))
    sums = [F.count_if("good").alias("n")]
    for cutoff in GRID:
        sums += [F.count_if(F.col("good") & (F.col("score") > cutoff)).alias(f"good {cutoff}"), F.count_if(~F.col("good") & (F.col("score") > cutoff)).alias(f"bad {cutoff}")]
    rows = held.groupBy("stratum").agg(*sums).collect()
    counts = {r["stratum"]: {c: (r[f"good {c}"], r[f"bad {c}"]) for c in GRID} for r in rows}
    return certified(counts, {r["stratum"]: r["n"] for r in rows}, limit=limit, level=level)


def verdict(cutoffs: dict[str, int], strata: tuple[str, ...] = STRATA) -> Column:
    """True for rows with stratum and COUNTS that the base rules and their stratum's cutoff keep."""
    kept = ~base_failed()
    for stratum, cutoff in sorted(cutoffs.items()):
        kept &= ~((stratum_of("stratum", strata) == stratum) & (score() > cutoff))
    return kept


def keep_good(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", stratum: str = "lang", text: str = "text", strata: tuple[str, ...] = STRATA, **risk) -> DataFrame:
    """The rows of df that the base rules and the cutoffs learned from them and the labels keep, with their own columns only.

    Texts are measured once: rows and counts are written to the shared folder, the cutoffs learned and the rows filtered from there.
    Null texts have no words and go; a null stratum is in 'other', a null id has no label; repeated rows are judged alike; columns may
    have any names; an empty table stays empty; very long texts are measured whole.
    """
    names = df.columns
    own = df.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)), F.col(f"`{text}`").alias("text"), F.col(f"`{stratum}`").alias("stratum"), F.col(f"`{id_col}`").alias("id"))
    schema = StructType([f for f in own.schema.fields if f.name != "text"])
    for c in COUNTS:
        schema = schema.add(c, LongType())
    measured = stored(own.mapInArrow(textops.trimmed(measure), schema), "quality", texts=True)
    cutoffs = calibrate(measured, labels, strata=strata, **risk)
    return measured.where(verdict(cutoffs, strata)).select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)))
