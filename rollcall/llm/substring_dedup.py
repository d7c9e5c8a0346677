"""Substring dedup by a hash-compared suffix sort.

Every repeated string of ``LENGTH`` bytes contains at least one anchor: a position whose hash of ``GRAM`` bytes is
the smallest in a window of ``LENGTH - GRAM + 1`` positions, which depends on these bytes alone. Only anchors that
occur twice or more matter. What is around them is brought together by anchor, and there the suffixes that begin at
the anchor, and the reversed prefixes that end at it, are sorted by mergesort; two are compared by a binary search
for their common extension over prefix polynomial hashes, and each extension found is verified on the bytes. From the
two orders follows for every offset which strings of ``LENGTH`` bytes are equal.

Texts with an equal copy elsewhere are settled by their digest first, and one of them stands for all. A task
resolves equal surroundings among its own rows and hands on one of them, so a passage that a third of all texts share
with the same text around it arrives as one row per ``SEEN`` surroundings of a task. What is different around one anchor
meets in one task, at some 8 KB a member, up to ``CROWD`` members; larger groups are first cut by more of the bytes that
their strings have in common, until they are small or one single string.

Defined cases: a null text is empty; texts shorter than ``LENGTH`` keep every byte; overlapping occurrences count,
also within one text; null or repeated identifiers are rows like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import cmp_to_key, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.storage import clear_of, numbered, settle
from rollcall.llm.streams import sorted_groups, tidy

LENGTH = 400
GRAM = 64
# Bytes of a text whose anchors are sought at once; longer texts are done in overlapping parts.
PART = 1 << 20
# Different surroundings a task remembers before it hands them on and starts anew, and their bytes.
SEEN = 20_000
SEEN_BYTES = 16 << 20
# Members of one anchor that a task sorts together; a larger group is cut finer first.
CROWD = 10_000
BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A well-mixed hash of the ``gram`` bytes from each position on, out of prefix hashes."""
    n = len(raw) - gram + 1
    size = 1 << max(10, int(len(raw) + 1).bit_length())
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(BASE, size)[: len(raw)], out=prefix[1:])
    value = (prefix[gram:] - prefix[:n]) * _powers(INVERSE, size)[:n]
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(32))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by minima from both ends of blocks of that width."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text: hash, position, and the first and last start of the strings each answers for.

    Every start of a string of ``length`` bytes belongs to exactly one anchor, the leftmost smallest in it.
    """
    starts = len(raw) - length + 1
    if starts <= 0:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    hashes, places, firsts, lasts = [], [], [], []
    whole, width = np.frombuffer(raw, np.uint8), length - gram + 1
    for at in range(0, starts, PART):
        part = whole[at : min(len(raw), at + PART + length - 1)]
        value = gram_hashes(part, gram)
        least = sliding_minimum(value, width)
        # Leftmost place of the minimum: the next place at or after the start that holds it.
        place = np.full(len(least), -1, np.int64)
        change = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        ends = np.append(change[1:], len(least))
        for a, b in zip(change.tolist(), ends.tolist(), strict=True):
            spots = np.flatnonzero(value[a : b + width - 1] == least[a]) + a
            place[a:b] = spots[np.searchsorted(spots, np.arange(a, b))]
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.append(first[1:], len(place)) - 1
        hashes.append(value[place[first]])
        places.append(place[first] + at)
        firsts.append(first + at)
        lasts.append(last + at)
    return tuple(map(np.concatenate, (hashes, places, firsts, lasts)))


class Members:
    """The surroundings of one anchor: ``forth[i]`` from the anchor on, ``back[i]`` reversed up to it."""

    def __init__(self, back: list[bytes], forth: list[bytes]):
        self.sides = (back, forth)
        self.hashes = tuple(self._prefixes(side) for side in self.sides)

    @staticmethod
    def _prefixes(texts: list[bytes]) -> list[array]:
        out = []
        for text in texts:
            raw = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
            prefix = np.zeros(len(text) + 1, np.uint64)
            np.cumsum(raw * _powers(BASE, max(2048, len(text)))[: len(text)], out=prefix[1:])
            out.append(array("Q", prefix.tobytes()))
        return out

    def common(self, side: int, i: int, j: int) -> int:
        """Length of the common extension of members i and j, by binary search over prefix hashes, then verified."""
        a, b = self.hashes[side][i], self.hashes[side][j]
        low, high = 0, min(len(a), len(b)) - 1
        if a[high] == b[high]:
            low = high
        while low < high:
            mid = (low + high + 1) // 2
            if a[mid] == b[mid]:
                low = mid
            else:
                high = mid - 1
        x, y = self.sides[side][i], self.sides[side][j]
        if x[:low] != y[:low]:  # equal hashes of unequal bytes
            low = next(k for k in range(low) if x[k] != y[k])
        return low

    def order(self, side: int) -> tuple[list[int], list[int]]:
        """Members in suffix order (list.sort is a mergesort), and what each shares with the one before."""
        texts = self.sides[side]

        def compare(i, j):
            k = self.common(side, i, j)
            x, y = texts[i][k : k + 1], texts[j][k : k + 1]
            return (x > y) - (x < y)

        order = sorted(range(len(texts)), key=cmp_to_key(compare))
        return order, [0, *(self.common(side, i, j) for i, j in zip(order, order[1:], strict=False))]


def repeated_starts(members: Members, low: np.ndarray, high: np.ndarray, twice: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each member the ranges of distances r from string start to anchor, low <= r <= high, at which its string of
    ``length`` bytes also occurs in another member, or anywhere in one that stands for two."""
    n = len(low)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if n == 1:
        if twice[0]:
            out[0].append((int(low[0]), int(high[0])))
        return out
    if n == 2:
        a, b = members.common(0, 0, 1), length - members.common(1, 0, 1)
        for i in (0, 1):
            if twice[i]:
                out[i].append((int(low[i]), int(high[i])))
            elif max(low[i], b) <= min(high[i], a):
                out[i].append((max(int(low[i]), b), min(int(high[i]), a)))
        return out
    (left, left_common), (right, right_common) = members.order(0), members.order(1)
    left_common, right_common = np.array(left_common), np.array(right_common)
    # Classes change only where r passes a common extension; between such distances all strings behave alike.
    events = {int(low.min()), *(low.tolist()), *((high + 1).tolist()), *((left_common + 1).tolist()), *((length - right_common).tolist())}
    edges = sorted(e for e in events if low.min() <= e <= high.max())
    for r, following in zip(edges, [*edges[1:], int(high.max()) + 1], strict=True):
        of = np.empty((2, n), np.int64)
        of[0, left] = np.cumsum(left_common < r)
        of[1, right] = np.cumsum(right_common < length - r)
        here = (low <= r) & (r <= high)
        _, which, count = np.unique(of[0] * (n + 1) + of[1], return_inverse=True, return_counts=True)
        many = np.bincount(which, here * (1 + twice), len(count)) > 1
        for i in np.flatnonzero(many[which] & here).tolist():
            if out[i] and out[i][-1][1] == r - 1:
                out[i][-1] = (out[i][-1][0], following - 1)
            else:
                out[i].append((r, following - 1))
    return out


FOUND = "hash long, _row long, pos long, lo int, hi int, around binary, twice boolean, begin long, stop long"


def _local_candidates(length: int, gram: int):
    """Surroundings of repeated anchors, each distinct one once per task; what a task can tell by itself it tells."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}
        spans: list[tuple[int, int, int]] = []
        size = 0

        def flushed():
            nonlocal size
            out = [*seen.values(), *((None, row, None, None, None, None, None, a, b) for row, a, b in spans)]
            for at in range(0, len(out), 20_000):
                yield _found_batch(out[at : at + 20_000])
            seen.clear()
            spans.clear()
            size = 0

        for batch in batches:
            for row, text, wanted in zip(batch.column("_row").to_pylist(), batch.column("raw"), batch.column("repeated"), strict=True):
                raw = text.as_buffer().to_pybytes()
                known = set(wanted.values.to_pylist())
                value, place, first, last = anchors(raw, length, gram)
                for h, p, a, b in zip(value.view(np.int64).tolist(), place.tolist(), first.tolist(), last.tolist(), strict=True):
                    if h not in known:
                        continue
                    around = raw[a : b + length]
                    key = hashlib.blake2b(b"%d %d %d " % (h, p - a, b - a) + around, digest_size=16).digest()
                    entry = seen.get(key)
                    if entry is None:
                        seen[key] = [h, row, p, p - b, p - a, around, False, None, None]
                        size += len(around)
                        continue
                    if not entry[6]:
                        entry[6] = True
                        spans.append((entry[1], entry[2] - entry[4], entry[2] - entry[3] + length))
                    spans.append((row, a, b + length))
            if len(seen) + len(spans) > SEEN or size > SEEN_BYTES:
                yield from flushed()
        yield from flushed()

    return run


def _found_batch(rows: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.split() for f in FOUND.split(", ")]
    arrays = [pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])


def _resolve(length: int):
    """Per anchor: spans of bytes to remove."""

    def spans_of(group: pa.RecordBatch) -> Iterator[tuple[int, int, int]]:
        data = group.to_pydict()
        texts, lead = data["around"], data["hi"]
        members = Members([t[:k][::-1] for t, k in zip(texts, lead, strict=True)], [t[k:] for t, k in zip(texts, lead, strict=True)])
        low, high, twice = np.array(data["lo"]), np.array(data["hi"]), np.array(data["twice"])
        for i, found in enumerate(repeated_starts(members, low, high, twice, length)):
            if twice[i]:
                continue  # told where it was seen twice
            for a, b in found:
                yield data["_row"][i], data["pos"][i] - b, data["pos"][i] - a + length

    def run(batches):
        out: list[tuple[int, int, int]] = []
        for group in sorted_groups(batches, ["hash"]):
            out.extend(spans_of(group))
            if len(out) > 50_000:
                yield _span_batch(out)
                out = []
        if out:
            yield _span_batch(out)

    return run


def _span_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["_row", "begin", "stop"])


def _uncrowded(members: DataFrame, length: int, gram: int, crowd: int) -> tuple[DataFrame, list[DataFrame]]:
    """``members`` (stored) with groups of more than ``crowd`` cut finer, and the spans found on the way.

    A group answers for distances from string start to anchor in a band [x, y], at first all of them. Whatever the
    distance, its strings hold the bytes from x before the anchor to ``length`` - y behind it, so those that are equal
    agree in this core, and half a band has a longer one. Each member of a crowded group becomes one for either half,
    with the bytes that half needs, grouped by anchor and core; then equal members become one. A band of one distance
    leaves one member for each string, so the rounds are at most the binary logarithm of the distances.
    """
    members = members.withColumn("x", F.lit(0)).withColumn("y", F.lit(length - gram))
    done, spans = [], []
    while True:
        crowded = settle(members.where("x < y").groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("hash"))
        if crowded.isEmpty():
            break
        done.append(members.join(crowded, "hash", "left_anti"))
        middle = F.expr("(x + y) div 2").cast("int")
        halves = F.explode(F.array(F.struct(F.col("x").alias("from"), middle.alias("to")), F.struct((middle + 1).alias("from"), F.col("y").alias("to"))))
        part = members.join(crowded, "hash", "left_semi").select("*", halves.alias("half"))
        part = part.withColumn("least", F.greatest("lo", "half.from")).withColumn("most", F.least("hi", "half.to")).where("least <= most")
        bytes_ = F.substring("around", F.col("hi") - F.col("most") + 1, F.col("most") - F.col("least") + length)
        part = part.select("hash", "_row", "pos", F.col("least").alias("lo"), F.col("most").alias("hi"), bytes_.alias("around"), "twice", F.col("half.from").alias("x"), F.col("half.to").alias("y"))
        core = F.substring("around", F.col("hi") - F.col("x") + 1, F.lit(length) - F.col("y") + F.col("x"))
        part = settle(part.withColumn("hash", F.xxhash64("hash", "x", "y", core)))
        same = ["hash", "x", "y", "lo", "hi", "around"]
        alike = part.groupBy(*same).agg(F.min("_row").alias("_row"), F.min("pos").alias("pos"), F.max("twice").alias("twice"), F.count("*").alias("n"))
        alike = settle(alike.withColumn("twice", F.col("twice") | (F.col("n") > 1)))
        told = part.where("not twice").join(alike.where("n > 1").select(*same), same, "left_semi")
        spans.append(told.select("_row", (F.col("pos") - F.col("hi")).alias("begin"), (F.col("pos") - F.col("lo") + length).alias("stop")))
        members = alike.drop("n")
    for other in done:
        members = members.unionByName(other)
    return members.drop("x", "y"), spans


def _anchor_rows(length: int, gram: int):
    def run(batches):
        for batch in batches:
            grams, flags = [], []
            for text in batch.column("raw"):
                value = anchors(text.as_buffer().to_pybytes(), length, gram)[0].view(np.int64)
                distinct, count = np.unique(value, return_counts=True)
                grams.append(distinct)
                flags.append(np.minimum(count, 2).astype(np.int32))
            columns = [*batch.select(["_row", "n_bytes", "sha"]).columns, pa.array(grams, pa.list_(pa.int64())), pa.array(flags, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "n_bytes", "sha", "grams", "times"])

    return run


def repeated_spans(
    docs: DataFrame, text: str = "text", row_col: str = "_row", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD
) -> tuple[DataFrame, DataFrame]:
    """(_row, spans) for rows of ``docs`` that lose bytes: sorted, disjoint, maximal (begin, stop) pairs; and a stored
    table (_row, n_bytes, sha, copied) of all rows. ``docs`` should be a stored table."""
    texts = docs.select(F.col(row_col).alias("_row"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))
    sized = texts.select("_row", F.octet_length("raw").cast("long").alias("n_bytes"), F.sha2("raw", 256).alias("sha"), "raw")
    marked = settle(sized.mapInArrow(tidy(_anchor_rows(length, gram)), "_row long, n_bytes long, sha string, grams array<long>, times array<int>"))
    same = marked.groupBy("sha", "n_bytes").agg(F.min("_row").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    rows = marked.select("_row", "n_bytes", "sha").join(same, ["sha", "n_bytes"], "left")
    rows = settle(rows.select("_row", "n_bytes", "sha", F.col("first").isNotNull().alias("copied"), F.coalesce(F.col("first") == F.col("_row"), F.lit(True)).alias("stands")))
    # One text stands for its copies.
    standing = marked.select("_row", "grams", "times").join(rows.where("stands").select("_row"), "_row", "left_semi")
    each = settle(standing.select("_row", F.explode(F.arrays_zip("grams", "times")).alias("g")).select("_row", F.col("g.grams").alias("hash"), F.col("g.times").alias("times")))
    repeated = each.groupBy("hash").agg(F.sum("times").alias("times")).where("times > 1").select("hash")
    wanted = each.join(repeated, "hash", "left_semi").groupBy("_row").agg(F.collect_list("hash").alias("repeated"))
    near = texts.join(wanted, "_row")
    found = settle(near.mapInArrow(tidy(_local_candidates(length, gram)), FOUND))
    members, told = _uncrowded(found.where("around is not null").drop("begin", "stop"), length, gram, crowd)
    spans = members.repartition("hash").sortWithinPartitions("hash").mapInArrow(tidy(_resolve(length)), "_row long, begin long, stop long")
    for more in [found.where("around is null").select("_row", "begin", "stop"), *told]:
        spans = spans.unionByName(more)
    own = rows.where(F.col("copied") & (F.col("n_bytes") >= length)).select("_row", F.lit(0).cast("long").alias("begin"), F.col("n_bytes").alias("stop"))
    lost = spans.join(own.select("_row"), "_row", "left_anti").unionByName(own)
    return _merged(lost), rows


def _merged(lost: DataFrame) -> DataFrame:
    """(_row, spans): each row's spans in order, those that touch or overlap made one in a single sweep."""
    sweep = Window.partitionBy("_row").orderBy("begin", "stop")
    reach = F.max("stop").over(sweep.rowsBetween(Window.unboundedPreceding, -1))
    marked = lost.withColumn("first", F.when(reach >= F.col("begin"), 0).otherwise(1)).withColumn("run", F.sum("first").over(sweep))
    runs = marked.groupBy("_row", "run").agg(F.min("begin").alias("begin"), F.max("stop").alias("stop"))
    return runs.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("begin", "stop"))).alias("spans"))


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """``docs`` plus spans (array of removed byte ranges), n_bytes, kept_bytes (binary) and kept_sha256."""
    docs = clear_of(docs, "spans", "n_bytes", "kept_bytes", "kept_sha256", "_row", "_raw")
    rows = numbered(docs)
    spans, sizes = repeated_spans(rows, text, length=length, gram=gram, crowd=crowd)
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    joined = rows.join(sizes.select("_row", "n_bytes"), "_row").join(spans, "_row", "left")
    bounded = joined.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<begin:bigint,stop:bigint>>")))
    return _kept(bounded, raw).drop("_row")


def _kept(df: DataFrame, raw) -> DataFrame:
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s.stop))
    stops = F.concat(F.transform("spans", lambda s: s.begin), F.array(F.col("n_bytes")))
    pieces = F.zip_with(starts, stops, lambda a, b: F.substring(F.col("_raw"), (a + 1).cast("int"), (b - a).cast("int")))
    # Joined as strings, which Spark takes as the bytes they are: each byte is copied once, however many pieces there are.
    whole = F.array_join(F.transform(pieces, lambda x: x.cast("string")), "").cast("binary")
    kept = df.withColumn("_raw", raw).withColumn("kept_bytes", whole).drop("_raw")
    return kept.withColumn("kept_sha256", F.sha2("kept_bytes", 256))


def removal_digests(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256. Only texts that lose a part of
    themselves are read again."""
    rows = numbered(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")))
    spans, sizes = repeated_spans(rows, "text", length=length, gram=gram, crowd=crowd)
    spans = settle(spans)
    entire = (F.size("spans") == 1) & (F.col("spans")[0].stop - F.col("spans")[0].begin == F.col("n_bytes"))
    cut = sizes.select("_row", "n_bytes").join(spans, "_row").where(~entire)
    parts = _kept(rows.select("_row", F.col("text").cast("binary").alias("raw")).join(cut, "_row"), F.col("raw")).select("_row", "kept_sha256")
    out = rows.select("_row", "id").join(sizes.select("_row", "n_bytes", "sha"), "_row").join(spans, "_row", "left").join(parts, "_row", "left")
    removed = F.aggregate(F.coalesce("spans", F.array().cast("array<struct<begin:bigint,stop:bigint>>")), F.lit(0).cast("long"), lambda n, s: n + s.stop - s.begin)
    return out.select(
        F.col("id").alias(id_col),
        "n_bytes",
        removed.alias("n_removed"),
        F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", F.when(F.col("spans").isNotNull(), F.sha2(F.lit(b"").cast("binary"), 256)).otherwise(F.col("sha"))).alias("kept_sha256"),
    )
