"""Ranked search against scoring every document, with ties, copies, nulls and long texts."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from rollcall.llm import lexical_search as ls

RNG = random.Random(7)
VOCAB = [f"w{i}" for i in range(400)] + ["Über", "naïve", "日本", "😀x", "A1b2"]
WEIGHTS = [1 / (i + 1) for i in range(len(VOCAB))]
SCHEMA = "doc_id long, text string, term string, shard long, n long, query long, _row long"


def prose(n):
    return RNG.choice([" ", ", ", "-"]).join(RNG.choices(VOCAB, WEIGHTS, k=n))


TEXTS = [prose(RNG.choice((1, 5, 30, 200))) for _ in range(700)]
TEXTS += [TEXTS[3]] * 40 + [None, "", " .,!", "w1 " * 5000, "W1 w1\tw1.w1"]
DOCS = [(i if i % 97 else None, t) for i, t in enumerate(TEXTS)] + [(5, TEXTS[3]), (5, TEXTS[3])]
ITEMS = [(i, prose(RNG.choice((1, 2, 8, 25)))) for i in range(60)] + [(60, TEXTS[3]), (61, "zzz unknown"), (62, None), (63, ""), (None, "w1 w2"), (60, "w3 w3 W3")]


def terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(ls.TERM, text or "")]


def brute(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, c.total()) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in counted:
            m = 10 + 90 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -score) for rank, (score, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*d, "t", 1, 2, 3, 4) for d in DOCS], SCHEMA).repartition(3)


def ranked(index, n, spark, items, k=10):
    asked = spark.createDataFrame([(*i, "x", 1) for i in items], "item_id long, text string, item string, query long")
    return sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in ls.search(index, n, asked, k).collect()], key=repr)


def test_search_equals_scoring_everything(spark, docs):
    index, n = ls.build_index(docs)
    assert ranked(index, n, spark, ITEMS) == brute(DOCS, ITEMS, 10)
    assert ranked(index, n, spark, ITEMS[:5], k=3) == brute(DOCS, ITEMS[:5], 3)


def test_small_shards_and_query_blocks_change_nothing(spark, docs, monkeypatch):
    index, n = ls.build_index(docs, shard_bytes=2000)
    assert index.select("shard").distinct().count() > 20
    monkeypatch.setattr(ls, "QUERY_BYTES", 500)
    assert ranked(index, n, spark, ITEMS) == brute(DOCS, ITEMS, 10)


def test_empty_tables(spark, docs):
    index, n = ls.build_index(docs.limit(0))
    assert n == 0 and ranked(index, n, spark, ITEMS) == []
    index, n = ls.build_index(docs)
    assert ranked(index, n, spark, ITEMS[:0] + [(1, None)]) == []


def packed(docs, tf):
    return ls.pack(np.stack([np.diff(docs, prepend=-1) - 1, tf], 1).ravel())[0].tobytes()


def test_postings_pack_and_unpack():
    for _ in range(50):
        docs = np.array(sorted(RNG.sample(range(RNG.choice((200, 70_000, 2**30))), RNG.randint(1, 128))), np.int64)
        tf = np.array([RNG.choice((1, 127, 128, 300, 70_000, 2**40)) for _ in docs], np.int64)
        got = ls.unpack(packed(docs, tf))
        assert (got[0] == docs).all() and (got[1] == tf).all()


def test_blocks_without_hope_stay_packed():
    """A common term's blocks are unpacked only where a rare term has candidates."""
    norms = np.full(20_000, 100, np.int64)

    def listed(docs, tf):
        part = ls._List()
        for at in range(0, len(docs), ls.BLOCK):
            d, t = docs[at : at + ls.BLOCK], tf[at : at + ls.BLOCK]
            part.add(int(d[-1]), int(ls.impacts(t, norms[d]).max()), packed(d, t))
        part.finish(norms)
        return part

    every = np.arange(20_000)
    common, rare = listed(every, np.ones(20_000, np.int64)), listed(every[[5, 9000]], np.array([3, 1]))
    docs, scores = ls.candidates([(10, common), (9000, rare)], 9000 * rare.bound)
    assert docs.tolist() == [5] and scores[0] == 9000 * rare.bound + 10 * common.bound
    assert set(common.open) == {0}
    assert not len(ls.candidates([(10, common)], 10 * common.bound + 1)[0])


def test_terms_of_very_long_texts(monkeypatch):
    text = prose(3000) + "é" * 50
    monkeypatch.setattr(ls, "PIECE", 7)
    assert ls.term_counts(text) == Counter(t.encode() for t in terms(text))
