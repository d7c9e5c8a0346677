"""Columns of a caller that have the names operators use inside, or add: nothing is lost, overwritten or refused."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from rollcall.llm import bpe, language_id, licenses, mixing, quality, sharding, substring_dedup
from rollcall.llm.queries import vocabulary_path

SMALL = "/root/testdata/sf0.001"
INSIDE = ["_row", "_row_file", "_row_ordinal", "_words", "_copy", "_source", "_size", "_hash", "_id", "_range", "_n", "_rest", "_raw", "_lines", "row", "id", "name", "all", "size", "hash", "key", "fp", "best", "parts", "one", "dual", "copies", "target", "source_size", "keep", "votes_good", "quality_score", "shard", "slot", "tokens", "decoded", "lang_pred", "score", "license", "notices", "spans", "n_bytes", "kept_sha256", "n_tokens"]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clash") / "docs")
    plain = spark.read.parquet(f"{SMALL}/documents.parquet")
    plain.withColumns({n: F.concat(F.lit(f"{n} of "), F.col("doc_id")) for n in INSIDE}).write.parquet(path)
    return spark.read.parquet(path)


def intact(df, added=()):
    """All of the caller's values are there, under their names or with ``_input``."""
    names = {n: f"{n}_input" if n in added else n for n in INSIDE}
    assert df.where(F.lit(False)).columns == df.columns and set(names.values()) <= set(df.columns)
    wrong = F.lit(False)
    for n, found in names.items():
        wrong = wrong | ~F.col(f"`{found}`").eqNullSafe(F.concat(F.lit(f"{n} of "), F.col("doc_id")))
    assert df.count() and not df.where(wrong).count()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SMALL)
    if name == "encode":
        intact(out, added=("tokens", "decoded"))
    else:
        assert out.columns == docs.columns
        intact(out)


def test_operators(docs):
    sized = docs.withColumns({"bytes": F.octet_length("text").cast("long"), "group": F.xxhash64("text")})
    intact(sharding.shard_by_size(sized, 3, "bytes", "group", "doc_id"), added=("shard", "slot"))
    intact(mixing.mix(sized, "source", "bytes", "doc_id"), added=("copies", "target", "source_size"))
    intact(bpe.encode_digests(docs, vocabulary_path()), added=("n_tokens",))
    intact(bpe.decode_tokens(docs.withColumn("coded", F.array(F.lit(1))), vocabulary_path(), "coded"), added=("decoded",))
    intact(language_id.identify(docs, language_id.fit(docs)), added=("lang_pred", "score"))
    intact(licenses.scan(docs), added=("license", "notices", "_row", "_lines"))
    intact(quality.scored(docs, quality.fit(docs)), added=("votes_good", "quality_score", "keep"))
    intact(substring_dedup.without_repeats(docs), added=("spans", "n_bytes", "kept_sha256", "_row", "_raw"))


def test_very_many_sources(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 5000).cast("string").alias("host"), (1 + F.col("id") % 50).alias("words"))
    got = mixing.mix(df, "host", "words", "doc_id").groupBy("host").agg(F.sum(F.col("copies") * F.col("words")).alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most"))
    assert got.count() == 5000
    assert not got.where((F.abs(F.col("taken") - F.col("target")) > 100) | (F.col("most") > 2)).count()
