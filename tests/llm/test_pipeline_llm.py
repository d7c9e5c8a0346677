"""The pipeline's stages on the smallest tables, and against what each stage must keep."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
import pytest

from rollcall.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def test_stages_keep_the_columns_and_each_decision_holds(stages):
    raw, good, distinct, near, mixed, encoded = stages
    assert all(s.columns == raw.columns for s in stages[:-1])
    assert 0.5 * raw.count() < good.count() <= raw.count()
    texts = Counter(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in distinct.collect())
    assert set(texts.values()) == {1}
    assert texts.keys() == {re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in good.collect()}
    assert near.count() <= distinct.count()
    assert {r["doc_id"] for r in mixed.select("doc_id").distinct().collect()} <= {r["doc_id"] for r in near.collect()}
    assert max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 2
    assert encoded.count() == mixed.count() and encoded.columns == [*raw.columns, "tokens", "decoded"]


def test_run_is_the_stages_and_repeats_itself(spark, stages):
    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    assert ids(corpus_pipeline.run(spark, SMALL)) == ids(stages[-1])


def test_stages_take_an_empty_table(spark, stages):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, stages[0].limit(0), SMALL).count() == 0


def test_queries_are_numbered():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES] == list(range(1, 14))
