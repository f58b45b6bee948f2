"""License scans by sentence rules.

A text is cut into sentences, which are normalised and mapped to known license-sentence identifiers; the sequence of identifiers is
then matched against ordered license rules.  The first rule that fits at a place takes its sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from augurline.llm import textops

#: Names of public licenses as they stand in a sentence, normalised, with a part of a word that each form holds.
NAMES = {
    "MIT": ("licen", r"mit( x11| expat)? licen[sc]e( mit)?"),
    "Apache-2.0": ("apache", r"apache( software)?( licen[sc]e)?( version| v)? ?v?2(\.0)?( licen[sc]e)?( the license)?"),
    "GPL-3.0-or-later": ("public", r"gnu general public licen[sc]e( gpl)?( version| v)? ?v?3(\.0)?( of the license)? or( at your option)?( any)? later( version)?"),
    "GPL-2.0-or-later": ("public", r"gnu general public licen[sc]e( gpl)?( version| v)? ?v?2(\.0)?( of the license)? or( at your option)?( any)? later( version)?"),
    "GPL-3.0-only": ("public", r"gnu general public licen[sc]e( gpl)?( version| v)? ?v?3(\.0)?( only)?"),
    "GPL-2.0-only": ("public", r"gnu general public licen[sc]e( gpl)?( version| v)? ?v?2(\.0)?( only)?"),
    "LGPL-3.0-only": ("public", r"gnu lesser general public licen[sc]e( lgpl)?( version| v)? ?v?3(\.0)?( only)?"),
    "LGPL-2.1-only": ("public", r"gnu lesser general public licen[sc]e( lgpl)?( version| v)? ?v?2\.1( only)?"),
    "LGPL": ("public", r"gnu lesser general public licen[sc]e.*"),
    "AGPL-3.0": ("affero", r"gnu affero general public licen[sc]e.*"),
    "MPL-2.0": ("mozilla", r"mozilla public licen[sc]e( mpl)?( version| v)? ?v?2(\.0)?"),
    "EPL-2.0": ("eclipse", r"eclipse public licen[sc]e( version| v)? ?v?2(\.0)?"),
    "BSL-1.0": ("boost", r"boost software licen[sc]e( version)? 1\.0"),
    "BSD-3-Clause": ("licen", r"(bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd) licen[sc]e"),
    "BSD-2-Clause": ("licen", r"(bsd 2 clause|2 clause bsd|simplified bsd|freebsd) licen[sc]e"),
    "ISC": ("licen", r"isc licen[sc]e"),
    "Zlib": ("zlib", r"zlib( libpng)? licen[sc]e"),
    "Unlicense": ("unlicense", r"unlicense( licen[sc]e)?"),
    "CC0-1.0": ("cc0", r"cc0( 1\.0)?( universal)?( public domain dedication)?( licen[sc]e)?"),
    "CC-BY-NC-SA-4.0": ("cc", r"cc by nc sa 4\.0( international)?( licen[sc]e)?"),
    "CC-BY-NC-ND-4.0": ("cc", r"cc by nc nd 4\.0( international)?( licen[sc]e)?"),
    "CC-BY-NC-4.0": ("cc", r"cc by nc 4\.0( international)?( licen[sc]e)?"),
    "CC-BY-SA-4.0": ("cc", r"cc by sa 4\.0( international)?( licen[sc]e)?"),
    "CC-BY-ND-4.0": ("cc", r"cc by nd 4\.0( international)?( licen[sc]e)?"),
    "CC-BY-4.0": ("cc", r"cc by 4\.0( international)?( licen[sc]e)?"),
    "CC-BY-SA-3.0": ("cc", r"cc by sa 3\.0( unported)?( licen[sc]e)?"),
    "CC-BY-3.0": ("cc", r"cc by 3\.0( unported)?( licen[sc]e)?"),
}
#: The long names of the Creative Commons licenses, by their short ones.
COMMONS = {"by": "attribution", "nc": "non ?commercial", "sa": "share ?alike", "nd": "no ?derivatives"}
NAMED = r"((this|the)( \w+)?( \w+)? is |are |all files are )?(dual )?(released|licensed|distributed|available|provided|published|covered|subject)( under| by| to)?( the terms( and conditions)? of)?( the| an?)? {}( see .*)?"
FREE = r"this (program|file|library|software) is free software you can redistribute it and or modify it under the terms of the gnu {}general public licen[sc]e as published by the free software foundation"
LATER = r"either version {}( of the license)? or at your option any later version"

#: Other sentences of public licenses, normalised, as patterns that a whole sentence must match, each with a part of a
#: word that the sentence holds.
SENTENCES = {
    "mit-grant": ("permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files .*"),
    "mit-notice": ("permission", r"the above copyright notice and this permission notice( including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    "asis-software": ("warrant", r"the software is provided as is without warranty of any kind .*"),
    "asis-liability": ("liable", r"in no event shall the (authors|author|copyright holders|copyright holder|copyright owner|regents) (or copyright holders |or contributors )?be liable for any .*"),
    "apache-2-title": ("apache", r"apache license version 2\.0 january 2004.*"),
    "apache-2-use": ("complian", r"you may not use this (file|work) except in compliance with the license"),
    "apache-2-copy": ("licen", r"you may obtain a copy of the license at( .*)?"),
    "apache-2-asis": ("warrant|distributed", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis .*"),
    **{f"{family}-{v}-free-later": ("redistribute", FREE.format(word) + " " + LATER.format(number)) for family, word, v, number in (("gpl", "", "3", r"3(\.0)?"), ("gpl", "", "2", r"2(\.0)?"), ("lgpl", "(lesser|library) ", "3", r"3(\.0)?"), ("lgpl", "(lesser|library) ", "21", r"2\.1"), ("lgpl", "(lesser|library) ", "2", r"2(\.0)?"), ("agpl", "affero ", "3", r"3(\.0)?"))},
    "lgpl-any-free": ("redistribute", FREE.format("(lesser|library) ") + ".*"),
    "agpl-any-free": ("redistribute", FREE.format("affero ") + ".*"),
    "gpl-any-free": ("redistribute", FREE.format("") + ".*"),
    "gpl-3-later": ("version", LATER.format(r"3(\.0)?")),
    "gpl-2-later": ("version", LATER.format(r"2(\.0)?")),
    "lgpl-21-later": ("version", LATER.format(r"2\.1")),
    "gpl-3-title": ("public", r"gnu general public license version 3 29 june 2007"),
    "gpl-2-title": ("public", r"gnu general public license version 2 june 1991"),
    "agpl-3-title": ("affero", r"gnu affero general public license version 3 19 november 2007"),
    "lgpl-3-title": ("public", r"gnu lesser general public license version 3 29 june 2007"),
    "mpl-2-form": ("mozilla", r"this source code form is subject to the terms of the mozilla public license v\.? ?2\.0"),
    "bsd-grant": ("redistribut", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    "bsd-source": ("redistribut", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    "bsd-binary": ("redistribut", r"redistributions in binary form must reproduce the above copyright notice .*"),
    "bsd-endorse": ("endorse", r"neither the name of .* may be used to endorse or promote products .*"),
    "isc-grant": ("permission", r"permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted .*"),
    "zlib-grant": ("permission", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely .*"),
    "boost-grant": ("permission", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license .*"),
    "unlicense-text": ("unencumbered", r"this is free and unencumbered software released into the public domain"),
    **{f"{name.lower()}-named": (need, NAMED.format(pattern)) for name, (need, pattern) in NAMES.items()},
    **{
        f"{name.lower()}-long": ("commons", NAMED.format(f"creative commons {' '.join(COMMONS[x] for x in name.lower().split('-')[1:-1])} {name[-3:].replace('.', '[.]')}( international| unported)?( public)?( licen[sc]e)?"))
        for name in NAMES if name.startswith("CC-")
    },
    "cc0-waived": ("universal", r".*\bcc0 1\.0 universal.*"),
    "all-rights": ("reserved", r"(copyright .*)?all rights reserved"),
}

#: Identifiers in order (one may be left out where it ends in ?) and the license they make, first rule first.
RULES = [
    (("mit-grant", "mit-notice", "asis-software?", "asis-liability?"), "MIT"),
    (("apache-2.0-named", "apache-2-use?", "apache-2-copy?", "apache-2-asis?"), "Apache-2.0"),
    (("apache-2-title",), "Apache-2.0"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "asis-liability?"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "asis-liability?"), "BSD-2-Clause"),
    (("isc-grant", "asis-liability?"), "ISC"),
    (("zlib-grant",), "Zlib"),
    (("boost-grant", "asis-software?", "asis-liability?"), "BSL-1.0"),
    (("gpl-3-free-later",), "GPL-3.0-or-later"),
    (("gpl-2-free-later",), "GPL-2.0-or-later"),
    (("gpl-any-free", "gpl-3-later"), "GPL-3.0-or-later"),
    (("gpl-any-free", "gpl-2-later"), "GPL-2.0-or-later"),
    (("lgpl-3-free-later",), "LGPL-3.0-or-later"),
    (("lgpl-21-free-later",), "LGPL-2.1-or-later"),
    (("lgpl-2-free-later",), "LGPL-2.0-or-later"),
    (("lgpl-any-free", "gpl-3-later"), "LGPL-3.0-or-later"),
    (("lgpl-any-free", "lgpl-21-later"), "LGPL-2.1-or-later"),
    (("lgpl-any-free", "gpl-2-later"), "LGPL-2.0-or-later"),
    (("lgpl-any-free",), "LGPL"),
    (("agpl-3-free-later",), "AGPL-3.0-or-later"),
    (("agpl-any-free", "gpl-3-later"), "AGPL-3.0-or-later"),
    (("gpl-3-title",), "GPL-3.0-only"),
    (("gpl-2-title",), "GPL-2.0-only"),
    (("agpl-3-title",), "AGPL-3.0-only"),
    (("lgpl-3-title",), "LGPL-3.0-only"),
    (("mpl-2-form",), "MPL-2.0"),
    (("unlicense-text",), "Unlicense"),
    *(((f"{name.lower()}-named",), name) for name in NAMES),
    *(((f"{name.lower()}-long",), name) for name in NAMES if name.startswith("CC-")),
    (("cc0-waived",), "CC0-1.0"),
    (("all-rights",), "Proprietary"),
]
_TERM = r"(?:\([ \t]*)*[\w.+:-]*[\w+](?:[ \t]*\))*"
SPDX = re.compile(rf"SPDX-License-Identifier:[ \t]*({_TERM}(?:(?:[ \t]+|(?<=\)))(?:AND|OR|WITH)(?:[ \t]+|(?=\()){_TERM})*)")
#: Words of a sentence may be parted by joins of pieces, and a sentence ends where a piece does.
COMPILED = {name: re.compile(f"(?:{pattern})(?![^\n])".replace(" ", "[ \n]"), re.DOTALL) for name, (_, pattern) in SENTENCES.items()}
NEEDS = {name: tuple(need.split("|")) for name, (need, _) in SENTENCES.items()}
#: Parts of words without which a text holds no sentence; short ones count as whole words only.
PARTS = tuple(sorted({n for needs in NEEDS.values() for n in needs if len(n) > 3} | {"spdx"}))
SHORT = {n: re.compile(rf"(?<![^\W_]){n}(?![^\W_])") for needs in NEEDS.values() for n in needs if len(n) < 4}
#: Places inside a line where a sentence ends or may go on.
CUT = re.compile(r"(?<=[.!?])(?<!\b[vV]\.)[ \t\r\f\v]+(?=[A-Z0-9\"'(])|(?<=;)[ \t\r\f\v]+")
END = re.compile(r"(?<!\b[vV])[.!?][\"')\]]*$")
ITEM = re.compile(r"\(?(?:\d{1,2}|[a-z]|[ivx]{2,4})[.)][ \t]+")
MARKS = re.compile(r"^[\s/*#;%!>|-]+|[\s*/|-]+$")
DROPPED = re.compile(r"[\"'`,;:()\[\]{}<>/_*#=|!?-]+")


def paragraphs(text: str) -> Iterator[list[tuple[str, bool]]]:
    """Runs of lines without a blank one; a list item begins a new run.

    Each has pieces of lines, and whether a sentence ends there.  Pieces are normalised: without comment marks and punctuation, in
    lower case, single spaces, no end mark.
    """
    out: list[tuple[str, bool]] = []
    for line in text.split("\n"):
        line = MARKS.sub("", line)
        item = ITEM.match(line)
        found = []
        for part in CUT.split(line[item.end() :] if item else line):
            plain = " ".join(DROPPED.sub(" ", MARKS.sub("", part)).lower().split()).rstrip(".")
            if plain:
                found.append((plain, bool(END.search(part.rstrip()))))
        if out and (item or not found):
            yield out
            out = []
        out += found
    if out:
        yield out


def identified(pieces: list[str]) -> list[tuple[str, str]]:
    """(identifier, sentence) of the known sentences in pieces of which only the last ends a sentence for certain.

    A known sentence is one piece or several in a row, as many as its pattern takes up to the next known sentence.  Of the patterns
    that match at a piece, the first counts.
    """
    whole, found = "\n".join(pieces), []
    at = limit = len(whole)
    last = last_needs(whole, limit)
    for piece in reversed(pieces):
        at -= len(piece)
        for name in [n for n, i in last.items() if i >= at]:
            if m := COMPILED[name].match(whole, at, limit):
                found.append((name, m[0].replace("\n", " ")))
                limit = max(0, at - 1)
                last = last_needs(whole, limit)
                break
        at -= 1
    return found[::-1]


def last_needs(whole: str, limit: int) -> dict[str, int]:
    """For each sentence that can be in whole[:limit], in order of the table, the last place of a part that it needs."""
    places = {n: whole.rfind(n, 0, limit) for needs in NEEDS.values() for n in needs}
    return {name: i for name, needs in NEEDS.items() if (i := max(places[n] for n in needs)) >= 0}


def hinted(text: str) -> bool:
    """Whether a text has a part that a sentence needs; without one it holds none."""
    lowered = text.lower()
    return any(part in lowered for part in PARTS) or any(n in lowered and bool(p.search(lowered)) for n, p in SHORT.items())


def known(text: str) -> Iterator[tuple[str, str]]:
    """(identifier, sentence) of all known sentences of a text, in order."""
    for pieces in paragraphs(text):
        held: list[str] = []
        for plain, ends in pieces:
            held.append(plain)
            if ends:
                yield from identified(held)
                held = []
        if held:
            yield from identified(held)


def take(rule: tuple[str, ...], names: list[str], at: int) -> int:
    """How many identifiers the rule takes at a place; 0: it doesn't fit."""
    i = at
    for want in rule:
        if i < len(names) and names[i] == want.rstrip("?"):
            i += 1
        elif not want.endswith("?"):
            return 0
    return i - at


def licenses(found: list[tuple[str, str]]) -> list[str]:
    """Licenses of a sequence of (identifier, sentence), in order; UNKNOWN for what no rule takes."""
    names, out, i = [n for n, _ in found], [], 0
    while i < len(names):
        if names[i] == "spdx":
            out.append(found[i][1])
            i += 1
            continue
        n, license_ = next(((n, name) for rule, name in RULES if (n := take(rule, names, i))), (1, "UNKNOWN"))
        out.append(license_)
        i += n
    return out


def expression(text: str) -> str:
    """An SPDX expression with single spaces and balanced brackets: those closed in excess are of the text around it."""
    out, depth = [], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            break
        out.append(c)
    plain = " ".join("".join(out).split()).replace("( ", "(").replace(" )", ")")
    while depth > 0 and plain.startswith("("):
        plain, depth = plain[1:].lstrip(), depth - 1
    return plain


def scan_text(text: str | None) -> tuple[int, list[str], list[str]]:
    """(known sentences, their identifiers, distinct licenses in order of first occurrence)."""
    if not text or not hinted(text):
        return 0, [], []
    found, at = [], 0
    for m in SPDX.finditer(text):
        found += [*known(text[at : m.start()]), ("spdx", expression(m[1]))]
        at = m.start() + len(m[0].rstrip(") \t"))
    found += known(text[at:])
    return len(found), [n for n, _ in found], list(dict.fromkeys(licenses(found)))


def scan(df: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: id_col, n_sentences (known ones), sentence_ids, licenses; no shuffle.

    Null and empty texts have none; whole texts are read, however long, and sentences run over line ends up to a blank line, a list item
    or an SPDX mark.  Repeated rows stay; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    own = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.small_batches(batches, "text"):
            found = [scan_text(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.string())), pa.array([x[2] for x in found], pa.list_(pa.string()))], ["id", "n_sentences", "sentence_ids", "licenses"])

    schema = StructType([own.schema["id"]]).add("n_sentences", LongType()).add("sentence_ids", ArrayType(StringType())).add("licenses", ArrayType(StringType()))
    return own.mapInArrow(textops.trimmed(task), schema).withColumnRenamed("id", id_col)
