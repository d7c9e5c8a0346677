"""The operators as queries over the whole test tables, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import alignment, bpe, embedding_dedup, exact_dedup, language_id, lexical_search, licenses, mixing, quality, sharding, simhash, substring_dedup, warc
from rollcall.llm.storage import documents, numbered, settle, ship

SHARDS = 24


def tokenizer_path(name: str) -> str:
    """A file of the installed public tokenizers; pass another path to the operator if it lies elsewhere."""
    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return str(public_tokenizers.path(name))
    return f"/opt/tokenizers/{name}"


def vocabulary_path() -> str:
    return tokenizer_path("word_bpe_49k.json")


def op1_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce("text", F.lit("")).cast("binary")
    rows = documents(spark, sf_dir).select(
        "doc_id",
        (F.octet_length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64("text").alias("content"),
    )
    placed = sharding.shard_by_size(settle(rows), SHARDS, "size", "content", "doc_id")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_patricia_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(numbered(documents(spark, sf_dir))).drop("_row")


OP2_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
"""


def op3_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(settle(rows), "source", "size", "doc_id")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(documents(spark, sf_dir).select("doc_id", "text"), vocabulary_path())


def op5_p_stable_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0)) THEN e END AS e
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS node, vec_id AS seen FROM v UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
root AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, root.component_id, v.vec_id = root.component_id AS kept
FROM v JOIN root ON root.node = v.vec_id LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) n ON n.a = v.vec_id
"""


def op6_bit_sliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(numbered(documents(spark, sf_dir)))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = language_id.held_out("doc_id")
    model = language_id.fit(docs.where(~held))
    return language_id.identify(docs.select("doc_id", held.alias("held_out"), "text"), model)


def op8_canonical_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "license", F.array_join("notices", ",").alias("notices"), "text_digest")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _op8_sql() -> str:
    low = "lower(line)"
    for old, new in licenses.SPELLINGS:
        low = f"replace({low}, {_quoted(old)}, {_quoted(new)})"
    known = [f"({entire}, {_quoted(name)}, {_quoted(text)})" for entire, name, text in licenses.known_rows()]
    lines = rf"""
  SELECT id, i, line FROM (
    SELECT id, i, CASE WHEN regexp_matches(low, {_quoted(licenses.COPYRIGHT)}) THEN '' ELSE trim(regexp_replace(low, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) END AS line
    FROM (SELECT id, i, {low} AS low FROM (
      SELECT id, unnest(parts) AS line, unnest(range(len(parts))) AS i FROM (SELECT id, regexp_split_to_array(body, '\r\n|[\n\r]') AS parts FROM SOURCE))))
  WHERE line <> ''"""
    return f"""
WITH known(entire, license, raw) AS (VALUES {", ".join(known)}),
known_lines AS ({lines.replace("SOURCE", "(SELECT raw AS id, raw AS body FROM known)")}),
known_digest AS (SELECT DISTINCT k.entire, k.license, l.digest FROM known k JOIN (SELECT id, sha256(string_agg(line, ' ' ORDER BY i)) AS digest FROM known_lines GROUP BY id) l ON l.id = k.raw),
doc_lines AS ({lines.replace("SOURCE", "(SELECT doc_id AS id, text AS body FROM documents)")}),
whole AS (SELECT id, sha256(string_agg(line, ' ' ORDER BY i)) AS text_digest FROM doc_lines GROUP BY id),
noticed AS (SELECT id, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS notices FROM doc_lines JOIN known_digest k ON NOT k.entire AND k.digest = sha256(line) GROUP BY id)
SELECT d.doc_id, k.license, coalesce(n.notices, '') AS notices, w.text_digest
FROM documents d LEFT JOIN whole w ON w.id = d.doc_id
LEFT JOIN known_digest k ON k.entire AND k.digest = w.text_digest LEFT JOIN noticed n ON n.id = d.doc_id
"""


OP8_SQL = _op8_sql()


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digests(documents(spark, sf_dir))


# Every string of LENGTH bytes is grouped, as hex of the text: it shows what the query finds from anchors alone.
OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
starts AS (SELECT r, p, md5(substr(h, 2 * p + 1, 2 * {substring_dedup.LENGTH})) AS s FROM (SELECT r, h, unnest(range(n - {substring_dedup.LENGTH} + 1)) AS p FROM d WHERE n >= {substring_dedup.LENGTH})),
again AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY s) AS times FROM starts) WHERE times > 1),
led AS (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= {substring_dedup.LENGTH} THEN 0 ELSE 1 END AS first FROM again),
runs AS (SELECT r, min(p) AS a, max(p) + {substring_dedup.LENGTH} AS b FROM (SELECT r, p, sum(first) OVER (PARTITION BY r ORDER BY p) AS run FROM led) GROUP BY r, run),
gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS prior FROM runs),
cut AS (
  SELECT g.r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(d.h, 2 * prior + 1, 2 * (a - prior)), '' ORDER BY a) AS head
  FROM gaps g JOIN d ON d.r = g.r GROUP BY g.r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""


def op10_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.scored(docs.select("doc_id", "text"), quality.fit(docs))


def op11_perfect_hash_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return alignment.align(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    read = warc.read_records(warc.write(pages, "page_id", "url", "html"))
    return read.select(
        F.col("key").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


# Base32 of a digest: four letters for each five hex digits.
_DIGIT = "strpos('0123456789abcdef', substr(hex, 5 * (i // 4) + {}, 1)) - 1"
_TWENTY_BITS = "((((" + _DIGIT.format(1) + ") * 16 + " + _DIGIT.format(2) + ") * 16 + " + _DIGIT.format(3) + ") * 16 + " + _DIGIT.format(4) + ") * 16 + " + _DIGIT.format(5)
OP12_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
top AS (SELECT page_id, body, hex, max(page_id) OVER (PARTITION BY body) AS best FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((({_TWENTY_BITS}) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to
FROM top
"""


def op13_block_max_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, n_docs = lexical_search.build_index(documents(spark, sf_dir))
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return lexical_search.search(index, n_docs, asked, k=10).select("item_id", "rank", "doc_id", "score")


_TERMS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + lexical_search.TERM + "')"
OP13_SQL = f"""
WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS.format("text")}) AS term FROM documents) GROUP BY doc_id, term),
n AS (SELECT doc_id, CAST(sum(tf) AS HUGEINT) AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS nn, sum(n) AS ll FROM n),
m AS (SELECT doc_id, CAST(10 + (90 * n * nn) // ll AS BIGINT) AS m FROM n, total),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark),
scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _shipped(f)
    for f in (
        op1_sampled_splitters,
        op2_patricia_owners,
        op3_entropy_mix,
        op4_segment_tree_bpe,
        op5_p_stable_hashing,
        op6_bit_sliced_simhash,
        op7_output_codes,
        op8_canonical_digests,
        op9_suffix_dedup,
        op10_weak_labels,
        op11_perfect_hash_alignment,
        op12_chunked_warc,
        op13_block_max_maxscore,
    )
}

ORACLES = {
    "op2_patricia_owners": OP2_SQL,
    "op5_p_stable_hashing": OP5_SQL,
    "op8_canonical_digests": OP8_SQL,
    "op9_suffix_dedup": OP9_SQL,
    "op12_chunked_warc": OP12_SQL,
    "op13_block_max_maxscore": OP13_SQL,
}
