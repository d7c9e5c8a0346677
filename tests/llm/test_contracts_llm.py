"""The queries without SQL on the smallest tables: their laws by plain Python, and their models by independent solvers."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rollcall.llm import language_id, mixing, quality
from rollcall.llm.queries import QUERIES
from rollcall.llm.storage import settle

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def rows(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, SMALL).collect()]


def test_op1_shards_all_documents_evenly(spark, docs):
    got = rows(spark, "op1_sampled_splitters")
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        raw = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "bytes")
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(sizes) == set(range(24)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    fair, largest = sum(sizes.values()) / 24, max(r["size"] for r in got)
    assert all(abs(s - fair) <= largest for s in sizes.values())


def test_op3_takes_near_its_targets(spark, docs):
    got = rows(spark, "op3_entropy_mix")
    words = {i: len((r["text"] or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ")) - (r["text"] or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ").count("") for i, r in docs.items()}
    total, taken = Counter(), Counter()
    for r in got:
        assert r["size"] == words[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
        total[docs[r["doc_id"]]["source"]] += r["size"]
        taken[docs[r["doc_id"]]["source"]] += r["taken"]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    level, want = 0.0, {}
    low, high = 0.0, 2.0 * sum(total.values())
    for _ in range(200):  # the level of the uncapped sources, by bisection
        level = (low + high) / 2
        want = {s: min(2 * total[s], weights[s] * level) for s in names}
        low, high = (level, high) if sum(want.values()) < 1.5 * sum(total.values()) else (low, level)
    largest = max(words.values())
    for r in got:
        assert r["source_size"] == total[docs[r["doc_id"]]["source"]]
        assert math.isclose(r["target"], want[docs[r["doc_id"]]["source"]], rel_tol=1e-9)
    assert all(abs(taken[s] - want[s]) <= 2 * largest for s in names)


def test_op3_tilt_solves_the_dual(spark):
    """Rates against a scalar solver for each source."""
    rng = random.Random(4)
    cells = {(s, rng.randint(1, 900)): rng.randint(1, 30) for s in range(6) for _ in range(40)}
    sizes = {s: sum(k[1] * n for k, n in cells.items() if k[0] == s) for s in range(6)}
    wanted = {s: sizes[s] * f for s, f in zip(range(6), (0.05, 0.6, 1.0, 1.4, 1.95, 2.0), strict=True)}
    table = settle(spark.createDataFrame([(*k, n) for k, n in cells.items()], "_source long, size long, n long"))
    for s, (t, scale) in mixing.balance(table, sizes, wanted).items():
        mine = [(size, n) for (source, size), n in cells.items() if source == s]
        low, high = -2000.0, 2000.0
        for _ in range(300):
            mid = (low + high) / 2
            mass = sum(size * n * min(2.0, math.exp(min(700.0, mid * size / 1000))) for size, n in mine)
            low, high = (mid, high) if mass < wanted[s] else (low, mid)
        for size, _ in mine:
            rate = min(2.0, math.exp(max(-700.0, min(700.0, t * size / scale))))
            assert math.isclose(rate, min(2.0, math.exp(min(700.0, low * size / 1000))), rel_tol=1e-4, abs_tol=1e-9)


def test_op7_marks_held_out_documents_and_scores(spark, docs):
    got = rows(spark, "op7_output_codes")
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    langs = {r["lang"] for r in docs.values()} | {"und"}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["lang_pred"] in langs and 0 <= r["score"] <= 1 for r in got)
    known = [r for r in got if r["held_out"] and docs[r["doc_id"]]["lang"] and any(map(str.isalpha, docs[r["doc_id"]]["text"] or ""))]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in known) >= 0.9 * len(known)


def test_op7_predicts_as_plain_log_odds_do(spark, docs):
    """Every prediction again from dictionaries of n-grams: smoothed frequencies, all splits, loss-weighted decoding."""
    training = [r for i, r in docs.items() if r["text"] is not None and r["lang"] not in (None, "und") and zlib.crc32(str(i).encode()) % 3 != 1]
    seen: dict[str, Counter] = defaultdict(Counter)
    for r in training:
        seen[r["lang"]].update(plain_ngrams(r["text"]))
    names = sorted(seen)
    total = {s: sum(seen[s].values()) for s in names}
    smooth = language_id.SMOOTHING / sum(total.values())
    code = language_id.codebook(len(names))
    assert len({tuple(word) for word in code.tolist()}) == len(names)

    def mean(names_of_half, gram):
        return sum(seen[s][gram] / total[s] for s in names_of_half) / len(names_of_half)

    for r in rows(spark, "op7_output_codes")[:60]:
        text = docs[r["doc_id"]]["text"] or ""
        if not any(map(str.isalpha, text)):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        grams = plain_ngrams(text)
        margins = []
        for bit in range(code.shape[1]):
            halves = [[s for s, word in zip(names, code[:, bit], strict=True) if word == side] for side in (1, -1)]
            odds = sum(n * (math.log(mean(halves[0], g) + smooth) - math.log(mean(halves[1], g) + smooth)) for g, n in grams.items())
            margins.append(odds / math.sqrt(sum(grams.values())))
        sure = [abs(m) / sum(map(abs, margins)) for m in margins]
        loss = [sum(w * math.log1p(math.exp(-max(-700.0, c * m))) for w, c, m in zip(sure, word, margins, strict=True)) for word in code.tolist()]
        best = min(range(len(names)), key=lambda i: (loss[i], i))
        assert r["lang_pred"] == names[best]
        share = 1 / sum(math.exp(loss[best] - other) for other in loss)
        assert math.isclose(r["score"], share, abs_tol=1e-3)


def plain_ngrams(text):
    """Byte n-grams, in the hash buckets that the classifiers count."""
    raw, found = f" {' '.join(text.lower().split())} ".encode(), Counter()
    for n in language_id.NGRAMS:
        for at in range(len(raw) - n + 1):
            value = n
            for byte in raw[at : at + n]:
                value = (value * 257 + byte) % 2**64
            found[(value * 0x9E3779B97F4A7C15 % 2**64 >> 40) % language_id.BUCKETS] += 1
    return found


def test_op10_recovers_known_accuracies():
    """Votes drawn from labellers of known accuracy, without any label."""
    rng, m = np.random.default_rng(8), len(quality.LABELLERS)
    right = np.linspace(0.7, 0.95, m)
    good = rng.random(40_000) < 0.8
    cast = rng.random((40_000, m)) < 0.7
    true = rng.random((40_000, m)) < right
    vote = np.where(cast, np.where(true == good[:, None], quality.GOOD, quality.BAD), quality.ABSTAIN)
    patterns = Counter((vote << 2 * np.arange(m)).sum(1).tolist())
    model = quality.fit_labels(patterns)
    said = np.array([model.posterior(int(p)) for p in (vote << 2 * np.arange(m)).sum(1)])
    assert ((said > 0.5) == good)[(vote > 0).any(1)].mean() > 0.93
    assert abs(model.prior - 0.8) < 0.05
    assert np.abs(model.rates[1, :, quality.GOOD] - 0.7 * right).max() < 0.06
