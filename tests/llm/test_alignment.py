"""Alignment of two tokenizers against whole texts encoded by the libraries, and its perfect hash."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from rollcall.llm import alignment
from rollcall.llm.queries import tokenizer_path

PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
RNG = random.Random(11)
BITS = ["the", "Hello", "don't", "we'LL", "1234", "3.14", "é", "Ünï", "日本語", "😀", "á", "ﬁ", "--", "...", "<|endoftext|>", "<s>", "x" * 30, "▁", "_", "½", "ß", "­", "​", "ˈ", "'s", "''"]
GAPS = [" ", " ", " ", " ", "  ", "\n", "\t ", " \n", " ", "　", "\r\n", "", " ", "\x1c", "\x85"]
SCHEMA = "doc_id long, text string, key string, n long, slice int, part long, _row long"


def messy(n):
    return "".join(RNG.choice(BITS) + RNG.choice(GAPS) for _ in range(n))


TEXTS = [messy(RNG.choice((1, 2, 5, 40))) for _ in range(300)] + [None, "", " ", "\n", "  a  ", "tail ", " head", "x y " * 4000, "a▁b", "words words words"] + ["the same text again"] * 50


def brute(rows):
    both = alignment.Aligner(*PATHS)
    coded, counts, best = [], Counter(), defaultdict(int)
    for doc, text in rows:
        a, b = (both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if b"".join(both.a_bytes[i] for i in a) != whole or b"".join(both.b_bytes[i] for i in b) != whole:
            a, b = [], []
        groups, i, j, at_a, at_b, links = [], 0, 0, 0, 0, []
        ends_b = {}
        for n, t in enumerate(b):
            at_b += len(both.b_bytes[t])
            ends_b[at_b] = n
        for n, t in enumerate(a):
            at_a += len(both.a_bytes[t])
            if at_a in ends_b:
                m = ends_b[at_a]
                links.append((t, b[m]))
                groups.append(",".join(map(str, a[i : n + 1])) + "|" + ",".join(map(str, b[j : m + 1])))
                i, j = n + 1, m + 1
        counts.update(links)
        coded.append((doc, len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted((doc or -1, na, nb, len(links), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest) for doc, na, nb, links, digest in coded)


def aligned(df):
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((r["doc_id"] or -1, *[r[n] for n in names]) for r in alignment.align(df, *PATHS).collect())


def test_segments_align_as_whole_texts_do(spark):
    rows = [(i if i % 50 else None, t) for i, t in enumerate(TEXTS, 1)]
    df = spark.createDataFrame([(*r, "k", 1, 2, 3, 4) for r in rows], "doc_id long, text string, key string, n long, slice int, part long, _row long").repartition(5)
    assert aligned(df) == brute(rows)
    assert alignment.align(df, *PATHS).columns[:6] == ["doc_id", "key", "n", "slice", "part", "_row"]


def test_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert aligned(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_forgetting_segments_and_many_slices_change_nothing(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS[:120], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    pairs = alignment.settle(alignment.pair_counts(df, "text", PATHS))
    want = Counter()
    for r in pairs.collect():
        want[r["key"]] += r["n"]
    old = alignment.SLICE_KEYS
    try:
        alignment.SLICE_KEYS = 15
        index = alignment.index_of(pairs, 10**6)
    finally:
        alignment.SLICE_KEYS = old
    assert len(index.slices) > 2 and sorted(index.keys.tolist()) == sorted(want)
    assert dict(zip(index.keys.tolist(), alignment.summed(pairs, index).tolist(), strict=True)) == want
    with pytest.raises(ValueError, match="vocabularies allow"):
        alignment.index_of(pairs, 3)


def test_a_full_memory_is_forgotten(monkeypatch):
    both = alignment.aligner(*PATHS)
    monkeypatch.setattr(alignment, "SEGMENTS", 3)
    monkeypatch.setattr(alignment, "SLICE_BYTES", 50)
    import pyarrow as pa

    texts, seen = TEXTS[:60], []
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})]
    forgotten = []
    for _, held, numbers, n in alignment._numbered(batches, "text", PATHS, True, lambda b: forgotten.append(len(b.numbers))):
        seen += [int(held.n_a.all[part].sum()) for part in np.split(numbers, np.cumsum(n)[:-1])]
    monkeypatch.undo()
    assert len(forgotten) > 5
    assert seen == [len(both.a.encode(" " + t, add_special_tokens=False).ids) if "▁" not in t else 0 for t in texts]


def test_both_libraries_agree_on_plain_text():
    both = alignment.aligner(*PATHS)
    letters = [chr(c) for c in range(32, 384) if alignment.PLAIN(chr(c))]
    texts = ["".join(RNG.choices(letters, k=RNG.randint(1, 60))) for _ in range(3000)] + [f"a{c}b {c}{c} '{c}1{c}" for c in letters]
    texts += [RNG.choice(["", " ", "  "]).join(RNG.choices(["'s", "'LL", "don't", "été", "  ", "naïve", "über", "12", "x1", "...", "Ĳ", "the", "ing"], k=12)) for _ in range(2000)]
    assert both.a_plain and [both.a_plain(t) for t in texts] == [x.ids for x in both.a.encode_batch_fast(texts, add_special_tokens=False)]


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty, *PATHS).collect() == []
    clashing = alignment.align(spark.createDataFrame([(5, "two words", 6)], "n_a long, text string, N_Best int"), *PATHS)
    assert clashing.columns[:2] == ["n_a_input", "N_Best_input"] and clashing.first()["n_a_input"] == 5


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 1000, 20_000])
def test_perfect_hash_numbers_all_keys_without_gaps(n, monkeypatch):
    keys = np.array(RNG.sample(range(2**50), n), np.int64)
    for levels in (40, 1):
        monkeypatch.setattr(alignment, "LEVELS", levels)
        made = alignment.PerfectHash.of(keys)
        assert made.size == n and sorted(made.number(keys).tolist()) == list(range(n))
        others = np.array(RNG.sample(range(2**50, 2**51), 100), np.int64)
        assert made.number(others).max(initial=0) < max(n, 1)
