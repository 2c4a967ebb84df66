"""Canonical digests: what they ignore, and what they tell apart."""

import re
import textwrap

from pyspark.sql import functions as F

from wayreach.llm import licences
from wayreach.llm.licence_texts import TEXTS


def scan(spark, texts, known=None):
    docs = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)], "doc_id long, text string, digest string")
    rows = licences.scan(docs, licences.known(spark, known)).collect()
    return [(r["license_ids"], r["line_license_ids"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_variants_match(spark):
    mit = TEXTS["MIT"]
    changed = "  Copyright (c) 2020 Some One\n# ALL RIGHTS RESERVED.\n" + mit.upper().replace("\n\n", "\r\n\n*  ").replace("SUBLICENSE", "SUB-LICENCE").replace(",", " ;")
    assert scan(spark, [mit, changed, mit + " more", mit.replace("free", "fee")]) == [("MIT", ""), ("MIT", ""), ("", ""), ("", "")]


def test_lines_and_odd_texts(spark):
    line = "Licensed under the Apache Licence, version 2.0"
    found = scan(spark, [f"text\n{line}\nReleased under the MIT license!", line, None, "", "©", "word " * 100_000])
    assert found == [("", "Apache-2.0 (notice),MIT (notice)"), ("Apache-2.0 (notice)", "Apache-2.0 (notice)"), *[("", "")] * 4]


def test_equal_canonical_forms_are_all_reported(spark):
    assert scan(spark, ["One  two", "three"], {"b": "one two", "a": "ONE-TWO", "none": "(c) 2020"}) == [("a,b", "a,b"), ("", "")]


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "one"), (1, "one"), (1, "one")], "doc_id long, text string")
    rows = licences.scan(docs, licences.known(spark, {"x": "One."})).collect()
    assert sorted((str(r["doc_id"]), r["license_ids"]) for r in rows) == [("1", "x"), ("1", "x"), ("None", "x")]
    assert licences.scan(docs.limit(0), licences.known(spark)).count() == 0


def test_wrapped_copies_of_every_known_text(spark):
    """Lines that are notices by themselves stay lines (also in the forms that some texts end with); all others are wrapped anew."""
    texts, names = [], []
    for name, text in TEXTS.items():
        for width in (61, 72, 79, 100, 10_000):
            parts, notice = [], re.compile(r"[\W_]*(copyright \W*(\(c\)|\d{4}|yyyy|<?year)|\(c\) \d{4}|©|all rights reserved)", re.I)
            for line in text.split("\n"):
                if notice.match(line) or not line.strip() or not parts or not parts[-1] or notice.match(parts[-1]):
                    parts.append(line.strip())
                else:
                    parts[-1] += " " + line.strip()
            lines = [x for p in parts for x in ([p] if notice.match(p) else textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False) or [""])]
            texts.append("\n".join(lines))
            names.append((name, width))
    missed = [n for n, (ids, _) in zip(names, scan(spark, texts), strict=True) if n[0] not in ids.split(",")]
    assert not missed, str(missed)


def test_narrow_terms(spark):
    """At any width a word after "copyright" in the terms does not make a notice."""
    for name in ("ISC", "BSD-3-Clause", "MIT", "Apache-2.0 (terms)", "GPL-3.0 (terms)", "MPL-2.0", "CC0-1.0"):
        body = re.sub(r"(?m)^ *Copyright \(C\).*$", "", TEXTS[name])
        copies = ["\n".join(textwrap.wrap(body, w, break_long_words=False, break_on_hyphens=False)) for w in (12, 30, 44, 60)]
        assert [name in ids for ids, _ in scan(spark, copies)] == [True] * 4, name


def test_full_texts_are_known():
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense", "CC0-1.0"} <= TEXTS.keys()


def test_notices_and_sentences(spark):
    notices = ["Copyright Some One", "copyright (C) some one", "Copyright 2020", "© us", "(c) 2020 us", "Copyright The Tree Authors.", "Copyright © 2020", "Copyright Notable Inc", "Copyright: Inka"]
    sentences = ["copyright notice and this", "Copyright holders be liable", "copyright owner", "copyright law", "copyright", "(c) You must retain", "copyright in the work", "copyrighted by", "Copyright the software"]
    lines = spark.createDataFrame([(k, x) for k, x in enumerate(notices + sentences)], "k int, line string")
    left = {r["line"] for r in lines.where(licences.canonical_line(F.col("line")) != "").collect()}
    assert left == set(sentences)
