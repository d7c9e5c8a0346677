"""Spans of very many pieces, cut within letters, and equal surroundings over many batches."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from rollcall.llm import substring_dedup


def removed(texts, length):
    """Kept bytes of each text, by looking every string of ``length`` bytes up."""
    raws, count = [(t or "").encode() for t in texts], {}
    for r in raws:
        for i in range(len(r) - length + 1):
            count[r[i : i + length]] = count.get(r[i : i + length], 0) + 1
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(bytes(b for b, g in zip(r, gone, strict=True) if not g))
    return out


def test_many_spans_of_one_long_text(spark):
    rng = random.Random(3)
    shared = ["".join(rng.choices("abcdefghé€😀", k=60)) for _ in range(400)]
    long = "".join(s + "".join(rng.choices("ijklmnö", k=rng.randint(1, 9))) for s in shared)
    texts = [long, *shared, None, "", "x" * 300]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in substring_dedup.removal_digests(docs, length=40, gram=12).collect()}
    want = removed(texts, 40)
    assert [got[i]["kept_sha256"] for i in range(len(texts))] == [hashlib.sha256(w).hexdigest() for w in want]
    assert got[0]["n_spans"] > 350 and got[0]["n_removed"] == len(long.encode()) - len(want[0])


def test_spans_touching_and_overlapping_are_one(spark):
    rows = [(1, 5, 9), (1, 9, 12), (1, 0, 3), (1, 6, 7), (1, 20, 30), (1, 5, 9), (2, 4, 8)]
    found = substring_dedup._merged(spark.createDataFrame(rows, "_row long, begin long, stop long")).collect()
    assert {r["_row"]: [tuple(s) for s in r["spans"]] for r in found} == {1: [(0, 3), (5, 12), (20, 30)], 2: [(4, 8)]}


def test_row_numbers_of_very_many_files(spark):
    """Row numbers above 2^60, as hundreds of thousands of files give, stay apart."""
    text = F.repeat(F.sha2(F.lit("a"), 512), 6)
    docs = spark.range(4).select((F.col("id") + (1 << 61)).alias("_row"), F.concat(text, F.col("id").cast("string")).alias("text"))
    spans, _ = substring_dedup.repeated_spans(docs.repartition(1))
    assert {r["_row"] - (1 << 61) for r in spans.collect()} == {0, 1, 2, 3}


@pytest.mark.parametrize("crowd", [1, 4, 30])
def test_crowded_groups_are_cut_and_lose_nothing(spark, crowd, monkeypatch):
    """One passage in most texts, with different bytes on both sides, some equal for a while, and some twice in a text."""
    monkeypatch.setattr(substring_dedup, "SEEN", 7)
    rng = random.Random(11)
    passage = "".join(rng.choices("abcdefgh", k=90))

    def side(n):
        return "".join(rng.choices("xyz", k=n))

    near = [side(25) for _ in range(4)]
    texts = [side(rng.randint(0, 40)) + rng.choice(["", *near]) + passage[rng.randint(0, 9) : rng.randint(75, 90)] + rng.choice(["", *near]) + side(30) for _ in range(120)]
    texts += [side(12) + passage + side(9) + passage + side(12) for _ in range(10)] + texts[:5] + [passage, passage[:39], None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["kept_sha256"] for r in substring_dedup.removal_digests(docs, length=40, gram=8, crowd=crowd).collect()}
    assert [got[i] for i in range(len(texts))] == [hashlib.sha256(w).hexdigest() for w in removed(texts, 40)]


def test_a_crowd_shrinks_to_what_lies_at_the_edge(spark):
    """Two hundred different surroundings of one passage: no group keeps more than the limit, whatever is found meanwhile."""
    passage = "".join(random.Random(2).choices("abcdefgh", k=40))
    rows = [(9, i, 30, 0, 20, (f"{i:020d}" + passage).encode(), False) for i in range(200)]
    members = spark.createDataFrame(rows, "hash long, _row long, pos long, lo int, hi int, around binary, twice boolean")
    left, spans = substring_dedup._uncrowded(members, 40, 20, 50)
    assert left.groupBy("hash").count().agg(F.max("count")).first()[0] <= 50
    assert {r["_row"] for s in spans for r in s.where("begin <= 30 and stop = 70").collect()} == set(range(200))
