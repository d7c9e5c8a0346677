"""Licence scans of published files: titles, copyright lines, widths, comment signs; and a table of one's own."""

from __future__ import annotations

import textwrap

import pytest
from pyspark.sql import functions as F

from rollcall.llm import licenses


def published(name, width, mark=""):
    """A licence file as it is published: title, copyright line, paragraphs wrapped at a width."""
    head = [*licenses.TITLES.get(name, [])[:1], "Copyright (c) 2019-2024 Jane Doe <jane@example.org>. All rights reserved."]
    body = [textwrap.fill(p, width) for p in licenses.KNOWN_TEXTS[name].split("\n\n")]
    lines = "\n\n".join([*head, *body]).split("\n")
    return "\n".join(f"{mark}{line}".rstrip() for line in lines) + "\n"


@pytest.mark.parametrize("width", [60, 72, 75, 78, 10_000])
def test_published_files_are_known_at_any_width(spark, width):
    rows = [(f"{n}{m}", published(n, width, m)) for n in licenses.KNOWN_TEXTS for m in ("", "# ", " * ")]
    got = licenses.scan(spark.createDataFrame(rows, "name string, text string"))
    assert {r["name"].rstrip(" #*"): r["license"] for r in got.collect()} == {n: n for n in licenses.KNOWN_TEXTS}
    assert got.where(F.col("license").isNull()).count() == 0


def test_copyright_lines_have_a_year_or_a_sign(spark):
    lines = ["Copyright 2020 A", "copyright (C) A", "(c) A. B.", "© A", "All Rights Reserved.", "copyright notice and this", "Copyright holders may", "see 2020"]
    got = spark.createDataFrame([("\n".join(lines),)], "text string").select(licenses.canonical_lines(F.col("text"))).first()[0]
    assert got == ["copyright notice and this", "copyright holders may", "see 2020"]


def test_a_table_of_ones_own(spark):
    known = spark.createDataFrame([(True, "Own", "You may do\nanything."), (False, "Own line", "Own licence applies.")], licenses.KNOWN)
    docs = spark.createDataFrame([(1, "YOU may do anything!"), (2, "text\n own license: applies\nmore"), (3, None), (4, "MIT"), (5, "")], "id long, text string")
    got = {r["id"]: (r["license"], r["notices"]) for r in licenses.scan(docs, known=known.unionByName(known)).collect()}
    assert got == {1: ("Own", []), 2: (None, ["Own line"]), 3: (None, []), 4: (None, []), 5: (None, [])}
