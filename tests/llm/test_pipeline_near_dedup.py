"""The pipeline's two dedup stages together against brute force, on the smallest table with planted near copies."""

from __future__ import annotations

import random
import re

import corpus_pipeline
import numpy as np
import xxhash

SMALL = "/root/testdata/sf0.001"
WORDS = [f"word{i}" for i in range(600)]


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_dedup_stages_keep_what_brute_force_keeps(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows, planted = [tuple(r) for r in docs.collect()], []
    for g in range(60):
        rng = random.Random(g)
        base = rng.choices(WORDS, k=300)
        changed = [*base[:90], *rng.choices(WORDS, k=(1, 3, 60)[g % 3]), *base[90 + (1, 3, 60)[g % 3] :]]
        planted += [(10**6 + 2 * g + i, " ".join(t), "en", "planted", len(t)) for i, t in enumerate((base, changed))]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows + planted, docs.schema).repartition(3).write.parquet(path)

    first = {}
    for id_, text, *_ in sorted(rows + planted):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), (id_, fingerprint(text)))
    left = sorted(first.values())
    prints = np.array([f for _, f in left], np.uint64)
    want, seen = set(), set()
    for i, (id_, _) in enumerate(left):
        if i not in seen:
            want.add(id_)
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += np.flatnonzero(np.bitwise_count(prints ^ prints[x]) <= 4).tolist()
    assert {10**6 + 6 * g + i for g in range(20) for i in (4, 5)} <= want  # a fifth is new: both stay
    assert len(want) < len(left)

    stages = dict(corpus_pipeline.STAGES)
    stages["exact_dedup"](spark, spark.read.parquet(path), SMALL).write.parquet(str(tmp_path / "distinct"))
    kept = stages["near_dedup"](spark, spark.read.parquet(str(tmp_path / "distinct")), SMALL)
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == want
