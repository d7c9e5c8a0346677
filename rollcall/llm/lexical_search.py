"""Ranked lexical search with Block-Max MaxScore over sharded posting lists.

``build_index`` counts terms per document, then each task inverts its documents shard by shard: a shard closes after
``shard_bytes`` of text, so a task's memory does not depend on how much it reads. A posting list is cut into blocks of
``BLOCK`` documents, packed by themselves, with their last document and their greatest contribution; a shard's
documents (identifier and length norm) are one more row. The index is a stored table.

``search`` takes the queries in blocks of bounded size. Each task goes through its shards with one heap of the best
documents per query, which a shard hands on to the next. Lists are ordered by their greatest score; those whose bounds
together stay below the heap's least score are not essential: a document in none of the others can't enter. Candidates
come from the essential lists and are then tried on the rest, best list first: a candidate goes when its score so far,
the block maxima at its place and the bounds of the lists after that can't reach the heap, and only blocks that still
have candidates are unpacked. Heaps of all tasks are merged twice, by lanes and then over lanes.

Score: sum over the query's distinct terms of ``w * ((1e9 * tf) div (1000 * tf + 8 * m))`` with
``w = floor(1000 ln((2N + 2) / (2 df + 1)))`` and ``m = 10 + (90 n N) div L``; N, L count documents with a term and all
terms, n a document's.

Defined cases: a null or blank text has no term and is in no result, as query or as document; equal scores go by
ascending identifier, null last, then by place in the index; repeated identifiers are rows like any other; an empty
table gives no rows; only the identifier and text columns are read, whatever other columns there are; a very long text
is counted piece by piece.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.storage import numbered, settle
from rollcall.llm.streams import tidy

BLOCK = 128
# Text a shard holds. Its lists and its unpacked blocks are what a task holds at a time.
SHARD_BYTES = 16 << 20
# Bytes of query text searched for together.
QUERY_BYTES = 8 << 20
# Rows of the index handed on together.
ROWS = 20_000
# Text whose words are split at a time.
PIECE = 1 << 20
LANES = 64
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Every other byte separates terms; a term's A to Z are lower-cased.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

INDEX = "shard long, term string, block int, n int, last int, top long, data binary"
_INDEX = pa.schema({"shard": pa.int64(), "term": pa.string(), "block": pa.int32(), "n": pa.int32(), "last": pa.int32(), "top": pa.int64(), "data": pa.binary()})


def distinct_terms(text: Column) -> Column:
    """The different terms of a text, as an array."""
    folded = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0)))


def term_counts(text: str | None) -> Counter:
    """Each term of a text, in UTF-8, and how often it occurs."""
    folded, found, at = (text or "").encode().translate(FOLD), Counter(), 0
    while at < len(folded):
        end = len(folded) if at + PIECE >= len(folded) else folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        found.update(folded[at:end].split())
        at = end
    return found


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * norm)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits, low bits first, the last of a number without the eighth bit; and how many bytes
    each has."""
    values = values.astype(np.uint64)
    width = np.ones(len(values), np.int64)
    for i in range(1, 10):
        width += values >> np.uint64(7 * i) > 0
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for i in range(int(width.max(initial=0))):
        has = np.flatnonzero(width > i)
        part = (values[has] >> np.uint64(7 * i)).astype(np.uint8) & np.uint8(127)
        out[ends[has] - width[has] + i] = part | (width[has] > i + 1).astype(np.uint8) << np.uint8(7)
    return out, width


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Documents and counts of a block: gap and count of each posting in turn."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate(([0], ends[:-1] + 1))
    shift = 7 * (np.arange(len(raw)) - np.repeat(starts, ends - starts + 1))
    values = np.add.reduceat((raw & 127).astype(np.int64) << shift, starts)
    return np.cumsum(values[::2] + 1) - 1, values[1::2]


# Building


def corpus_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Documents with at least one term, and terms with their repeats."""

    def run(batches):
        for batch in batches:
            sizes = [term_counts(t.as_py()).total() for t in batch.column(text)]
            yield pa.RecordBatch.from_pydict({"d": [sum(s > 0 for s in sizes)], "t": [sum(sizes)]})

    found = docs.select(text).mapInArrow(tidy(run), "d long, t long").agg(F.sum("d"), F.sum("t")).first()
    return found[0] or 0, found[1] or 0


class _Shard:
    """The postings of documents met so far, in the order of documents."""

    def __init__(self):
        self.terms: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.norms: list[int] = []
        self.sizes, self.numbers, self.tf = array("q"), array("q"), array("q")
        self.bytes = 0

    def add(self, doc_id: int | None, text: str, norm_of) -> None:
        found, terms = term_counts(text), self.terms
        self.bytes += len(text)
        if found:
            self.ids.append(doc_id)
            self.norms.append(norm_of(found.total()))
            self.sizes.append(len(found))
            self.numbers.extend([terms.setdefault(t, len(terms)) for t in found])
            self.tf.extend(found.values())

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """One row on the documents, then the blocks of each term."""
        if not self.ids:
            return
        norms = np.array(self.norms, np.int64)
        known = np.array([i is not None for i in self.ids], np.uint8)
        ids = np.array([i or 0 for i in self.ids], np.int64)
        about = known.tobytes() + ids.tobytes() + norms.tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((shard, "", 0, len(ids), len(ids) - 1, 0, about), _INDEX, strict=True)], schema=_INDEX)
        numbers = np.frombuffer(self.numbers, np.int64)
        order = np.argsort(numbers, kind="stable")
        numbers, tf = numbers[order], np.frombuffer(self.tf, np.int64)[order]
        docs = np.repeat(np.arange(len(ids)), np.frombuffer(self.sizes, np.int64))[order]
        # A block starts with each term, and after every BLOCK postings of one.
        first = np.flatnonzero(np.diff(numbers, prepend=-1))
        place = np.arange(len(numbers)) - np.repeat(first, np.diff(first, append=len(numbers)))
        starts = np.flatnonzero(place % BLOCK == 0)
        gaps = np.diff(docs, prepend=0) - 1
        gaps[starts] = docs[starts]
        data, width = pack(np.stack([gaps, tf], 1).ravel())
        ends = np.concatenate((starts[1:], [len(numbers)]))
        offsets = np.concatenate(([0], np.cumsum(width)))[2 * np.concatenate((starts, ends[-1:]))]
        names = pa.array(list(self.terms), pa.string())
        columns = [
            pa.array(np.full(len(starts), shard)),
            names.take(pa.array(numbers[starts])),
            pa.array((place[starts] // BLOCK).astype(np.int32)),
            pa.array((ends - starts).astype(np.int32)),
            pa.array(docs[ends - 1].astype(np.int32)),
            pa.array(np.maximum.reduceat(impacts(tf, norms[docs]), starts)),
            pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary()),
        ]
        whole = pa.RecordBatch.from_arrays(columns, schema=_INDEX)
        for at in range(0, len(starts), ROWS):
            yield whole.slice(at, ROWS)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """The stored index of ``docs``, and its number of documents. ``docs`` is read twice, so pass a stored table."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n_docs, n_terms = corpus_size(texts)

    def norm_of(n):  # of whole numbers without a limit, as 90 n N may leave 64 bits
        return 10 + 90 * n * n_docs // n_terms

    def run(batches):
        number, shard = TaskContext.get().partitionId() << 24, _Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column("id"), batch.column("text"), strict=True):
                shard.add(doc_id.as_py(), text.as_py() or "", norm_of)
                if shard.bytes >= shard_bytes:
                    yield from shard.rows(number)
                    shard, number = _Shard(), number + 1
        yield from shard.rows(number)

    return settle(texts.mapInArrow(tidy(run), INDEX)), n_docs


# Searching


class _List:
    """One term's blocks in a shard."""

    def __init__(self):
        self.last: list[int] = []
        self.top: list[int] = []
        self.data: list[bytes] = []
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, last: int, top: int, data: bytes) -> None:
        self.last.append(last)
        self.top.append(top)
        self.data.append(data)

    def finish(self, norms: np.ndarray) -> None:
        self.norms, self.bound = norms, max(self.top)
        self.ends, self.tops = np.array(self.last), np.array(self.top, np.int64)

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and contributions, unpacked once per shard."""
        found = self.open.get(i)
        if found is None:
            docs, tf = unpack(self.data[i])
            found = self.open[i] = docs, impacts(tf, self.norms[docs])
        return found

    def everything(self) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.block(i) for i in range(len(self.data))]
        return parts[0] if len(parts) == 1 else tuple(np.concatenate(p) for p in zip(*parts, strict=True))


class _Heap:
    """The best ``k`` documents of one query: larger score first, then smaller identifier (null last), then place."""

    def __init__(self, k: int):
        self.k, self.held = k, []

    @property
    def least(self) -> int:
        """A document needs this score at least."""
        return self.held[0][0] if len(self.held) == self.k else 1

    def offer(self, score: int, known: bool, doc_id: int, place: tuple[int, int]) -> None:
        entry = (score, known, -doc_id, (-place[0], -place[1]))
        if len(self.held) < self.k:
            heapq.heappush(self.held, entry)
        elif entry > self.held[0]:
            heapq.heapreplace(self.held, entry)


def candidates(lists: list[tuple[int, _List]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard that score ``least`` or more, and their scores. ``lists``: weight and list of each term."""
    ordered = sorted(lists, key=lambda x: x[0] * x[1].bound)
    bounds = np.cumsum([w * part.bound for w, part in ordered])
    first = int(np.searchsorted(bounds, least))  # lists before it do not reach ``least`` together
    if first == len(ordered):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gathered = [(w, part.everything()) for w, part in ordered[first:]]
    docs, place = np.unique(np.concatenate([d for _, (d, _) in gathered]), return_inverse=True)
    scores = np.zeros(len(docs), np.int64)
    np.add.at(scores, place, np.concatenate([w * g for w, (_, g) in gathered]))
    for i in range(first - 1, -1, -1):
        w, part = ordered[i]
        before = int(bounds[i - 1]) if i else 0
        block = np.searchsorted(part.ends, docs)
        inside = block < len(part.ends)
        ceiling = scores + before
        ceiling[inside] += w * part.tops[block[inside]]
        keep = ceiling >= least
        docs, scores, block, inside = docs[keep], scores[keep], block[keep], inside[keep]
        if not len(docs):
            break
        for b in np.unique(block[inside]).tolist():
            mine = np.flatnonzero(inside & (block == b))
            there, gains = part.block(b)
            at = np.minimum(np.searchsorted(there, docs[mine]), len(there) - 1)
            hit = there[at] == docs[mine]
            scores[mine[hit]] += w * gains[at[hit]]
    keep = scores >= least
    return docs[keep], scores[keep]


def _search_shard(shard: int, blocks: dict[str, _List], about: tuple, queries: dict[int, list[tuple[int, str]]], by_term: dict[str, list[int]], heaps: dict[int, _Heap]) -> None:
    known, ids, norms = about
    for part in blocks.values():
        part.finish(norms)
    for q in sorted({q for term in blocks for q in by_term[term]}):
        lists = [(w, blocks[term]) for w, term in queries[q] if term in blocks]
        heap = heaps[q]
        docs, scores = candidates(lists, heap.least)
        if len(docs) > heap.k:
            # Scores below the k-th best of these can't enter.
            enough = scores >= np.partition(scores, -heap.k)[-heap.k]
            docs, scores = docs[enough], scores[enough]
        for d, s in zip(docs.tolist(), scores.tolist(), strict=True):
            heap.offer(s, bool(known[d]), int(ids[d]), (shard, d))


def _about(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(data, np.uint8, n), np.frombuffer(data, np.int64, n, n), np.frombuffer(data, np.int64, n, 9 * n)


def _search_block(index: DataFrame, queries: dict[int, list[str]], n_docs: int, k: int) -> DataFrame:
    """The best ``k`` rows of each lane: query, score, id, shard, doc."""
    spark = index.sparkSession
    terms = sorted({t for found in queries.values() for t in found})
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in terms], "term string"))
    counts = {r[0]: r[1] for r in index.select("term", "n").join(wanted, "term").groupBy("term").agg(F.sum("n")).collect()}
    weights = {t: weight(n_docs, df) for t, df in counts.items()}
    weighted = {q: [(weights[t], t) for t in found if weights.get(t, 0) > 0] for q, found in queries.items()}
    weighted = {q: found for q, found in weighted.items() if found}
    by_term: dict[str, list[int]] = {}
    for q, found in weighted.items():
        for _, t in found:
            by_term.setdefault(t, []).append(q)
    shared = spark.sparkContext.broadcast((weighted, by_term))
    needed = F.broadcast(spark.createDataFrame([(t,) for t in ["", *by_term]], "term string"))

    def run(batches):
        weighted, by_term = shared.value
        heaps = {q: _Heap(k) for q in weighted}
        shard, about, blocks = None, None, {}
        for batch in batches:
            for i, (number, term) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("term").to_pylist(), strict=True)):
                n, last, top, data = (batch.column(c)[i].as_py() for c in ("n", "last", "top", "data"))
                if number != shard:
                    if blocks:
                        _search_shard(shard, blocks, about, weighted, by_term, heaps)
                    shard, blocks = number, {}
                if not term:
                    about = _about(n, data)
                else:
                    blocks.setdefault(term, _List()).add(last, top, data)
        if blocks:
            _search_shard(shard, blocks, about, weighted, by_term, heaps)
        found = [(q, s, -i if known else None, -place[0], -place[1]) for q, heap in heaps.items() for s, known, i, place in heap.held]
        columns = zip(*found, strict=True) if found else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "score", "id", "shard", "doc"])

    dealt = index.join(needed, "term").select(*index.columns).repartition("shard").sortWithinPartitions("shard", "term", "block")
    return dealt.mapInArrow(tidy(run), "query long, score long, id long, shard long, doc long")


def search(index: DataFrame, n_docs: int, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The ``k`` best documents of each row of ``queries``: query (row number), its id, rank, doc id, score.

    Queries are dealt over blocks of about ``QUERY_BYTES`` of text by their row number; each block is one search."""
    asked = numbered(queries.select(F.col(id_col).alias("item"), F.col(text_col).alias("body")), "query")
    asked = settle(asked.select("query", "item", F.coalesce(F.octet_length("body"), F.lit(0)).alias("size"), distinct_terms(F.col("body")).alias("terms")))
    blocks = (asked.agg(F.sum("size")).first()[0] or 0) // QUERY_BYTES + 1
    found = []
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).where(F.size("terms") > 0)
        terms = {r["query"]: r["terms"] for r in mine.select("query", "terms").collect()}
        if terms:
            found.append(settle(_search_block(index, terms, n_docs, k)))
    if not found:
        return asked.limit(0).select("query", F.col("item").alias(id_col), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    heaps = found[0]
    for more in found[1:]:
        heaps = heaps.unionByName(more)
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), "shard", "doc"]
    lane = F.pmod(F.xxhash64("shard"), F.lit(LANES))
    best = heaps.withColumn("lane", lane).withColumn("rank", F.row_number().over(Window.partitionBy("query", "lane").orderBy(*order))).where(F.col("rank") <= k)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    named = best.join(asked.select("query", F.col("item").alias(id_col)), "query")
    return named.select("query", id_col, "rank", F.col("id").alias("doc_id"), "score")
