"""Packing, chat formatting, quality rules, decontamination and license scans against plain versions."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from augurline.llm import chat, decontam, licenses, packing, quality, queries, textops

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t ", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h i", "É É x É\x1cy\n\nÉ É x É\x1cy\nz", "same line\nsame line\n same line\n\n#$|<>", "w " * 5000, "x" * 9000]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, [None, "en", "xx"][i % 3], None, 1) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[4], (None, "null id", "en", "s", 1)], DOCS)


def both(spark, sf, odd):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").union(odd)


def test_words_match_the_pattern():
    texts = ["", *[t or "" for t in ODD], "Ab aB c"]
    import pyarrow as pa

    for i, j, of in textops.slices(pa.array(texts), most=100):
        words = of.words()
        for k in range(j - i):
            want = WORD.findall(texts[i + k])
            assert of.n_words[k] == len(want)
            lower = [re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in want]
            own = words[of.first[k] : of.first[k + 1]]
            assert len(set(own)) == len(set(lower))
    assert len({int(h) for h in textops.hashed(np.frombuffer(b"abba", np.uint8), np.arange(4), np.arange(1, 5))}) == 2


@pytest.mark.parametrize("seed", range(4))
def test_bounds_are_optimal(seed):
    rng = np.random.default_rng(seed)
    lengths = sorted(rng.choice(40, 9, replace=False).tolist())
    counts = rng.integers(1, 30, 9).tolist()

    def padded(bounds):
        return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in zip(lengths, counts, strict=True))

    best = min(padded((*c, lengths[-1])) for k in range(3) for c in itertools.combinations(lengths[:-1], k))
    assert padded(packing.best_bounds(lengths, counts, 3)) == best
    assert packing.best_bounds(lengths, counts, 20) == lengths
    assert packing.best_bounds([], [], 3) == []


def test_packing(spark, sf, odd):
    docs = both(spark, sf, odd)
    want = Counter()
    for r in docs.collect():
        n = len(WORD.findall(r["text"] or "")) + 1
        for p in range((n - 1) // 256 + 1):
            want[r["doc_id"], p, min(256, n - p * 256)] += 1
    rows = packing.pack(docs, packing.word_lengths(), max_tokens=256, n_buckets=5, token_budget=1000).collect()
    assert Counter((r["doc_id"], r["piece"], r["n_tokens"]) for r in rows) == want
    assert len({r["bucket_len"] for r in rows}) == 5
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r["pad"] == r["bucket_len"] - r["n_tokens"] and r["start"] == r["piece"] * 256
        slots[r["bucket_len"], r["batch"]].append(r["slot"])
    for (length, batch), got in slots.items():
        full = max(1, 1000 // length)
        assert sorted(got) == list(range(len(got))) and len(got) <= full
        assert len(got) == full or (length, batch + 1) not in slots
    again = packing.pack(docs.repartition(7), packing.word_lengths(), max_tokens=256, n_buckets=5, token_budget=1000)
    assert Counter(again.collect()) == Counter(rows)
    assert packing.pack(docs.limit(0), packing.word_lengths()).count() == 0


def test_chat(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    tricky = [(-5, 1, "assistant", "&lt;|im_end|> &amp; <|im_start|>"), (-5, 0, "us\ner<|", None), (-5, 2, None, "last"), (-6, 0, "user", ""), (None, 0, "assistant", "n"), (-7, 0, "assistant", "twice"), (-7, 0, "assistant", "twice")]
    rows = [tuple(r) for r in rows] + tricky
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.examples(frame)).collect()}
    convs = defaultdict(list)
    for c, t, role, text in rows:
        convs[c].append((t, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    made = chat.examples(frame).where("conv_id = -5").orderBy("example").collect()
    assert [r["trained"] for r in made] == [True, False] and made[1]["formatted"].startswith(made[0]["formatted"])
    assert chat.digests(chat.examples(frame.limit(0))).count() == 0
    assert queries.op5_chat(spark, sf).where("conv_id = -1 and n_turns = 2").count() == 1


def plain_features(text):
    words = WORD.findall(text or "")
    runs = defaultdict(list)
    for i in range(len(words) - 7):
        runs[tuple(words[i : i + 8])].append(i)
    inside = {i + k for at in runs.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_quality(spark, sf, odd):
    docs = both(spark, sf, odd)
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = quality.features(docs).collect()
    assert Counter((r["id"], *(r[c] for c in cols)) for r in rows) == Counter((r["doc_id"], *plain_features(r["text"])) for r in docs.collect())
    assert quality.features(docs.limit(0)).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.calibrate(quality.features(docs), none) == {}
    clashing = docs.withColumnRenamed("n_chars", "id").withColumn("n_words", F.lit("x")).withColumn("stratum", F.lit(1))
    kept = quality.keep_good(clashing, none)
    assert kept.columns == ["doc_id", "text", "lang", "source", "id", "n_words", "stratum"]
    plain = [(r["doc_id"], *plain_features(r["text"])) for r in docs.collect()]
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(d for d, n, _, _, _, repeat in plain if n >= 20 and 100 * repeat <= 30 * n)


def labelled(spark):
    """Documents of which those with many symbols are bad, in three strata: many, few and no labels."""
    rng, rows, labels = random.Random(9), [], []
    for i in range(1600):
        lang, bad = ("en", "de", None)[0 if i < 1200 else 1 if i < 1500 else 2], i % 10 == 0
        words = [f"w{rng.randrange(5000)}" for _ in range(40)]
        marks = rng.randrange(14, 40) if bad else rng.randrange(3) * (i % 7 == 0) + 12 * (i in (1, 2, 3, 4, 5, 6, 7, 8))
        rows.append((i, " ".join(words + [f"#{k}" for k in range(marks)]), lang))
        if lang:
            labels.append((i, int(not bad)))
    labels += [(10, 1), (11, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_certified_cutoffs_equal_sql(spark, tmp_path):
    import duckdb

    from augurline.llm import sql

    docs, labels = labelled(spark)
    measured = quality.features(docs)
    for limit, level, want in ((0.01, 0.05, {"en": 300}), (0.05, 0.05, {"en": 200, "de": 200}), (0.001, 0.05, {})):
        cutoffs = quality.calibrate(measured, labels, limit=limit, level=level)
        assert cutoffs == want
        base = duckdb.connect()
        base.register("documents", docs.toPandas())
        base.register("labels", labels.toPandas().astype({"quality": "Int64"}))
        rows = {r[0]: r[-1] for r in base.sql(sql.quality(f"{limit}e0", f"{level}e0")).fetchall()}
        assert rows == {r["id"]: r["kept"] for r in measured.withColumn("kept", quality.verdict(cutoffs)).collect()}
        kept = quality.keep_good(docs, labels, limit=limit, level=level)
        assert {r["doc_id"] for r in kept.collect()} == {d for d, k in rows.items() if k}
    assert quality.calibrate(measured, labels, strata=("de",), limit=0.05) == {"other": 200, "de": 200}


def test_thresholds_control_risk():
    assert quality.binomial_cdf(0, 10, 0.1) == pytest.approx(0.9**10)
    assert quality.binomial_cdf(3, 10, 0.3) == pytest.approx(sum(__import__("math").comb(10, k) * 0.3**k * 0.7 ** (10 - k) for k in range(4)))
    assert quality.certified({"en": {50: (0, 5), 100: (0, 5)}}, {"en": 100}) == {}
    assert quality.certified({"en": {50: (30, 90), 100: (0, 80), 150: (0, 80)}}, {"en": 5000}) == {"en": 150}
    assert quality.certified({"en": {50: (0, 90), 100: (90, 900), 150: (0, 8)}}, {"en": 5000}) == {"en": 150}  # nothing after a failure
    # over whole sequences, the share of strata in which a cutoff with more false rejections than the limit takes effect is the level
    rng, wrong = np.random.default_rng(3), 0
    for _ in range(400):
        scores = rng.random(3000)  # good documents; the cutoffs reject 0.5, 0.8, 1.01, 1.5 and 3 % of them
        counts = {c: (int((scores < share).sum()), 10**6 // c) for c, share in ((500, 0.005), (400, 0.008), (300, 0.0101), (200, 0.015), (100, 0.03))}
        wrong += quality.certified({"en": counts}, {"en": 3000}).get("en", 500) < 400
    assert wrong <= 400 * 0.05 + 12


def test_decontamination(spark, sf, odd):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    extra = spark.createDataFrame([(900, "Short one"), (901, "short ONE"), (902, None), (903, "..."), (904, "x y z a b c d e x y z a b c d e x y z")], "item_id long, text string")
    planted = spark.createDataFrame([(5000, "u, short one v short-one"), (5001, "x y z a b c d e x y z a b c d e x y z a"), (5002, " ".join(r["text"] for r in bench.limit(2).collect())), (5002, "short")], "doc_id long, text string")
    bench, docs = bench.union(extra), both(spark, sf, odd).select("doc_id", "text").union(planted)
    items = {str(r["item_id"]): re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")) for r in bench.collect()}
    want = Counter()
    for r in docs.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        hit, found = set(), set()
        for item, own in items.items():
            for i in range(max(1, len(own) - 7)) if own else ():
                window = own[i : i + 8]
                for j in range(len(words) - len(window) + 1):
                    if words[j] == window[0] and words[j : j + len(window)] == window:
                        hit |= set(range(j, j + len(window)))
                        found.add(item)
        want[r["doc_id"], len(words), len(hit), len(found), ",".join(sorted(found))] += 1
    for size in (1 << 20, 200):
        got = decontam.scan(docs, bench, block_bytes=size).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["items"])) for r in got) == want
    assert decontam.clean(docs, bench).count() == sum(n for k, n in want.items() if not k[3])
    assert decontam.scan(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.scan(docs.limit(0), bench).count() == 0
    clashing = docs.selectExpr("doc_id", "text", "'a' as n_words", "2 as items", "3 as contaminated", "4 as __searched", "doc_id as n_hit", "5 as c0", "6 as own0")
    kept = decontam.clean(clashing, bench)
    assert kept.schema == clashing.schema
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in decontam.clean(docs, bench).collect())
    assert decontam.scan(clashing, bench).columns == ["doc_id", "__searched", "c0", "own0", "n_words", "n_hit", "n_items", "items", "contaminated"]
    many = bench.unionByName(bench.selectExpr("item_id + 10000 as item_id", "concat(text, ' and more') as text")).repartition(5)
    few = {r["doc_id"]: r["n_hit"] for r in decontam.scan(docs, many).collect()}
    assert few == {r["doc_id"]: r["n_hit"] for r in decontam.scan(docs, many, block_bytes=2000, gather_bytes=100_000).collect()}


def test_licenses(spark, odd):
    text = "a line\n// Released under the MIT License.\n * This work is licensed under the GNU General Public License, version 3.\n# SPDX-License-Identifier: BSD-3-Clause\nAll rights reserved."
    assert licenses.scan_text(text)[2] == ["MIT", "GPL-3.0-only", "BSD-3-Clause", "Proprietary"]
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. x"
    assert licenses.scan_text(bsd)[2] == ["UNKNOWN"]
    assert licenses.scan_text("Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0.")[2] == ["CC-BY-NC-4.0", "Apache-2.0"]
    rows = licenses.scan(odd).collect()
    assert len(rows) == len(ODD) + 2 and not any(r["licenses"] for r in rows)


def forms(pattern, pick):
    """A sentence that a pattern of the table takes: pick chooses among alternatives and whether optional parts are there."""
    import re._parser as parser

    def write(tree):
        out = ""
        for kind, arg in tree:
            kind = str(kind)
            if kind == "LITERAL":
                out += chr(arg)
            elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, inner = arg
                out += "".join(write(inner) for _ in range(max(low, int(high > 2), pick(min(2, int(high)) + 1))))
            elif kind == "SUBPATTERN":
                out += write(arg[3])
            elif kind == "BRANCH":
                out += write(arg[1][pick(len(arg[1]))])
            elif kind == "IN":
                options = [chr(x) for k, x in arg if str(k) == "LITERAL"] or ["q"]
                out += options[pick(len(options))]
            elif kind == "ANY":
                out += " x "
        return out

    return write(parser.parse(pattern))


def plain_sentences(pieces):
    """identified() without any filter: every pattern at every piece, from the last."""
    whole, found, begin = "\n".join(pieces), [], []
    for k in range(len(pieces)):
        begin.append(len("\n".join(pieces[:k])) + (k > 0))
    limit = len(whole)
    for at in reversed(begin):
        m = next(((n, m) for n, p in licenses.COMPILED.items() if (m := p.match(whole, at, limit))), None)
        if m:
            found.append((m[0], m[1][0].replace("\n", " ")))
            limit = max(0, at - 1)
    return found[::-1]


def test_no_filter_hides_a_sentence(spark, sf):
    rng = random.Random(4)
    for name, (_, pattern) in licenses.SENTENCES.items():
        for pick in [lambda n: 0, lambda n: n - 1, *[rng.randrange] * 40]:
            sentence = forms(pattern, pick).replace("\\b", "")
            raw = sentence.replace(" and or ", " and/or ").upper() if pick(2) else sentence.capitalize() + "."
            found = licenses.scan_text(f"Some text.\n{raw}\nmore")
            assert found[0], (name, raw)
    for text in [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + [MIT, BSD + ENDORSE + AS_IS, ISC, APACHE]:
        plain = []
        for pieces in licenses.paragraphs(text or ""):
            held = []
            for piece, ends in [*pieces, ("", True)]:
                held += [piece] if piece else []
                if ends:
                    plain += plain_sentences(held)
                    held = []
        if "SPDX" not in (text or ""):
            assert licenses.scan_text(text)[1] == [n for n, _ in plain]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Released under CC BY 4.0.", "CC-BY-4.0"),
        ("This work is licensed under the CC BY-SA 4.0.", "CC-BY-SA-4.0"),
        ("Released under CC BY-NC 4.0", "CC-BY-NC-4.0"),
        ("This work is licensed under a Creative Commons\nAttribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"),
        ("Licensed under the GNU General Public License v3.0 or later", "GPL-3.0-or-later"),
        ("This project is licensed under the MIT License - see the LICENSE file for details.", "MIT"),
        ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)", "BSL-1.0"),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.", "MPL-2.0"),
        ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "GPL-3.0-only"),
        ("Licensed under the 3-Clause BSD License.", "BSD-3-Clause"),
    ],
)
def test_named_licenses(text, want):
    assert licenses.scan_text(text)[2] == [want]


MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ENDORSE = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
AS_IS = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""


@pytest.mark.parametrize(("text", "want"), [(MIT, "MIT"), (BSD + AS_IS, "BSD-2-Clause"), (BSD + ENDORSE + AS_IS, "BSD-3-Clause"), (ISC, "ISC"), (APACHE, "Apache-2.0")])
def test_wrapped_license_texts(text, want):
    one_line = "\n\n".join(" ".join(p.split()) for p in re.split(r"\n\n|\n(?=\d\.)", text))
    for mark in ("", "# ", " * ", "// ", "-- "):
        for form in (text, one_line, text.replace("\n", "\r\n")):
            got = licenses.scan_text("\n".join(mark + line for line in form.split("\n")))
            assert got[2] == [want], (mark, form, got)
    assert licenses.scan_text(MIT)[1] == ["mit-grant", "mit-notice", "asis-software", "asis-liability"]


def test_lines_without_end_marks_stay_apart():
    text = "Some title\nLicensed under the GNU Lesser General Public License\nAll rights reserved\nReleased under the\nMIT License\nmore text"
    assert licenses.scan_text(text)[1:] == (["lgpl-named", "all-rights", "mit-named"], ["LGPL", "Proprietary", "MIT"])


FREE = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} either version {}{} or (at your option) any later version."
GPL, LESSER, LIBRARY = "General Public License", "Lesser General Public License", "Library General Public License"


@pytest.mark.parametrize(
    ("words", "want"),
    [
        (("program", ":", GPL, ",", "3", " of the License,"), "GPL-3.0-or-later"),
        (("program", ";", GPL, ";", "2", " of the License,"), "GPL-2.0-or-later"),
        (("file", ";", GPL, ";", "2", ","), "GPL-2.0-or-later"),
        (("library", ";", LESSER, ";", "2.1", " of the License,"), "LGPL-2.1-or-later"),
        (("program", ":", LESSER, ",", "3", " of the License,"), "LGPL-3.0-or-later"),
        (("library", ";", LIBRARY, ";", "2", " of the License,"), "LGPL-2.0-or-later"),
    ],
)
def test_gnu_notices_in_one_line_and_wrapped(words, want):
    import textwrap

    text = FREE.format(*words)
    rest = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY."
    for width in (1000, 80, 72, 60, 40, 25):
        for mark in ("", " * ", "# "):
            form = "\n".join(mark + line for part in (text, "", rest) for line in textwrap.wrap(part, width) or [""])
            assert licenses.scan_text(form)[2] == [want], (width, form, licenses.scan_text(form))
    cut = text.replace(", either", ". Either").replace("; either", ". Either")  # as a sentence of its own
    assert licenses.scan_text(cut)[2] == [want]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("/* SPDX-License-Identifier: MIT */ Licensed under the Apache License, Version 2.0.", ["MIT", "Apache-2.0"]),
        ("SPDX-License-Identifier: MIT. SPDX-License-Identifier: ISC Released under the MIT License. SPDX-License-Identifier: 0BSD", ["MIT", "ISC", "0BSD"]),
        ("All rights reserved. SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0\nAll rights reserved.", ["Proprietary", "GPL-2.0+ WITH Classpath-exception-2.0"]),
        ("# SPDX-License-Identifier: (MIT OR  Apache-2.0)", ["(MIT OR Apache-2.0)"]),
        ("(SPDX-License-Identifier: MIT) All rights reserved.", ["MIT", "Proprietary"]),
        ("SPDX-License-Identifier: ( MIT AND (ISC OR 0BSD) )OR CC0-1.0 -->", ["(MIT AND (ISC OR 0BSD))OR CC0-1.0"]),
        ("<!-- SPDX-License-Identifier: MIT-->\nReleased under the\nApache License 2.0", ["MIT", "Apache-2.0"]),
    ],
)
def test_all_spdx_marks_of_a_line_and_what_is_between(text, want):
    assert licenses.scan_text(text)[2] == want
