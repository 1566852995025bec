"""Whole licence texts, as published and with a copyright line, in other line breaks and case."""

import re
import textwrap

import duckdb

from opinaria.llm import licenses

WANTED = {"BSD-2-Clause", "BSD-3-Clause", "Unlicense", "Zlib", "BSL-1.0", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1",
          "LGPL-3.0", "MPL-2.0", "CC0-1.0"}


def test_whole_texts_are_found(texts):
    known = licenses.package_texts()
    assert {name for name, _ in known} == WANTED
    rows = [(2 * i, "Copyright (c) 2020 Some One\n\n" + body) for i, (_, body) in enumerate(known)]
    rows += [(2 * i + 1, " ".join(body.split()).upper()) for i, (_, body) in enumerate(known) if "opyright" not in body]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(texts(rows)).filter("line = 0").collect()}
    assert got == {d: known[d // 2][0] for d, _ in rows}
    bsd = dict(known)["BSD-3-Clause"]
    assert "Redistributions in binary form" in bsd and "Neither the name" in bsd and len(bsd) > 1200


def wrapped(body, width):
    """Paragraphs filled anew to a width; copyright statements stay lines of their own."""
    out, words = [], []
    for line in [*body.split("\n"), ""]:
        states = re.match(r"\W*copyright\W*(\(c\)|[0-9]{4}|[<\[{])", line.lower()) is not None
        if states or not line.strip():
            out += [*textwrap.wrap(" ".join(words), width, break_on_hyphens=False, break_long_words=False), line]
            words = []
        else:
            words.append(line)
    return "\n".join(out)


def test_known_texts_are_found_at_every_width(texts):
    known = [(name, body) for name, body in licenses.KNOWN if len(body) > 500]
    rows = [(1000 * i + width, wrapped(body, width)) for i, (_, body) in enumerate(known) for width in range(50, 101)]
    df = texts(rows)
    digests = {r["digest"]: r["license"] for r in licenses.known_digests(df.sparkSession).collect()}
    found = {r["doc_id"]: digests.get(r["d"]) for r in df.select("doc_id", licenses.digest(df["text"]).alias("d")).collect()}
    assert {d: name for d, name in found.items() if name != known[d // 1000][0]} == {}


def test_copyright_lines_and_neighbouring_spellings(texts):
    gone = ("Copyright 2020 A", "  * Copyright (c) 2020-2021 A", "(C) 2020 A", "© A", "Copyright [yyyy] [name]", "Copyright: <year> <name>",
            "Copyright (c) A", "All rights reserved.")
    kept = {"copyright notice and this": "copyright notice and this", "Copyright holders": "copyright holders",
            "c) 3 copies": "c 3 copies", "licence licence Licence": "license license license",
            "copyright owner copyright owner": "copyright holder copyright holder", "sub-licence non-infringement": "sublicense noninfringement"}
    rows = [*enumerate(gone), *enumerate(kept, 100)]
    df = texts(rows)
    got = {r["doc_id"]: " ".join(r["c"].split()) for r in df.select("doc_id", licenses.canonical(df["text"]).alias("c")).collect()}
    assert got == {**{i: "" for i in range(len(gone))}, **dict(enumerate(kept.values(), 100))}
    sql = duckdb.sql(f"SELECT i, {licenses._sql_canonical('t')} FROM (VALUES {', '.join(str(r) for r in rows)}) v(i, t)").fetchall()
    assert dict(sql) == got
