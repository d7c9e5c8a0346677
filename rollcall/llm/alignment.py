"""Alignment of two tokenizers over a corpus, with corpus-wide counts of aligned pairs.

A is a byte-level BPE file of the ``tokenizers`` library, B a sentencepiece model that adds a space in front. Where
tokens of both end at the same byte, the text is cut into groups, and the two tokens that end there are linked.

The first pass aligns all texts and stores, per task, its distinct pairs and how often it met them. The distinct pairs
get a minimal perfect hash: a few levels of bit arrays in which a key that is alone in its place has its bit set and
the others go on to the next level; a key's number is the count of set bits before its own. Each task then turns stored
pairs into a dense vector of counts indexed by that number, and the vectors are summed in a tree, slice by slice. The
second pass aligns the texts again and looks each pair up; the key kept at its number tells whether it is that pair.

Linked tokens end together, so the shorter is a suffix of the longer: the pairs can't be more than the bytes of both
vocabularies together (some 600,000 for the usual ones), however large the corpus. That bounds hash, keys and counts,
which are the only things that reach the driver or are broadcast, at about 13 bytes a pair; more is an error.

Tokens never cross a single space between two letters, digits or ASCII signs: A's pattern starts a word there, and B
has no piece with a space inside (checked when it is loaded, or else nothing is cut). So texts are cut there, each
different segment is encoded once by the two libraries, and a task remembers segments within a bound.

Defined cases: a null or empty text, and one whose tokens do not spell it (a text holding U+2581, say), have no tokens
and count nowhere; strings of special tokens are plain text; null or repeated identifiers are rows like any other; an
empty table gives no rows; other columns are carried along, one that has the name of a new one under its name and
``_input``; a very long text is held once, as its string and its segments.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.bpe import byte_symbols
from rollcall.llm.storage import clear_of, settle
from rollcall.llm.streams import sliced, sorted_groups, tidy

# A single space that begins a word for both tokenizers; a space that does not; a character that may stand beside a cut.
CUT = re.compile(r"(?<=[\w!-~]) (?=[\w!-~])")
OTHER_SPACE = re.compile(r" (?![\w!-~])|(?<![\w!-~]) ")
SOLID = re.compile(r"[\w!-~]")
# How A's pre-tokenizer splits text, for the second library that reads its vocabulary.
A_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Printable ASCII and Latin letters, whose classes are the same in all versions of Unicode.
PLAIN = re.compile(r"[ -~À-ÖØ-öø-ſ]*").fullmatch
# Characters of segments encoded as one text.
JOINED = 1 << 16
# Segments a task remembers, and their characters, before it starts anew.
SEGMENTS = 500_000
SEGMENT_CHARS = 16 << 20
SLICE_BYTES = 1 << 20
# Keys a slice of the hash has about, and places a level has per key.
SLICE_KEYS = 32_768
SPARE = 2
# Vectors summed by one task of a tree's level.
FAN_IN = 16
# Rounds after which keys that still collide are numbered by binary search.
LEVELS = 40

COLUMNS = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


# Encoding


class Aligner:
    """Both tokenizers, and what they make of segments."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_file=b_path)
        self.a_plain = _plain_encoder(a_path)
        byte_of = {s: i for i, s in enumerate(byte_symbols())}
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len = np.array([len(t) for t in self.a_bytes])
        self.b_len = np.array([len(t) for t in self.b_bytes])
        # Pieces with a space behind another character could cross a cut.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.marked = [f"{i}{m}" for m in ",|;\n" for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.forget()

    @property
    def most_pairs(self) -> int:
        """No corpus links more different pairs: each is a token and one of its suffixes."""
        return int(self.a_len.sum() + self.b_len.sum())

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.chars = 0
        # Of each segment: tokens of A and of B, groups (-1 where the bytes differ), links' keys, groups as text.
        self.n_a, self.n_b, self.n = (_Grown(np.int32) for _ in range(3))
        self.keys = _Grown(np.int64)
        self.groups: list[str] = []

    def segments(self, text: str) -> list[str]:
        """``text`` cut into segments; each has a space before it."""
        if not self.cuts:
            return [text]
        return CUT.split(text) if OTHER_SPACE.search(text) else text.split(" ")

    def learn(self, fresh: list[str], alone: set[str], groups: bool) -> None:
        """Aligns new segments. Those of many are encoded as one text, but for the ones ``alone``, whose first or last
        character may not stand beside a cut; ``groups``: as text too."""
        plain, other, single = [], [], []
        for segment in fresh:
            if not self.cuts or segment in alone:
                single.append([segment])
            else:
                (plain if PLAIN(segment) else other).append(segment)
        self._learn(_joined(plain), groups, self.a_plain)
        self._learn(_joined(other), groups)
        self._learn(single, groups)

    def _learn(self, parts: list[list[str]], groups: bool, encoder=None) -> None:
        if not parts:
            return
        texts = [" ".join(p) for p in parts]
        if encoder:
            a = [encoder(" " + t) for t in texts]
        else:
            a = [x.ids for x in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        spelt = [self._spells(self.a_bytes, x, t) and self._spells(self.b_bytes, y, t) for x, y, t in zip(a, b, texts, strict=True)]
        if not all(spelt):
            single = [[s] for p, good in zip(parts, spelt, strict=True) if not good and len(p) > 1 for s in p]
            for (segment,) in [p for p, good in zip(parts, spelt, strict=True) if not good and len(p) == 1]:
                self._add([segment], *[np.array([-1])] * 3, np.empty(0, np.int64), [""] if groups else [])
            a, b, parts = ([x for x, good in zip(part, spelt, strict=True) if good] for part in (a, b, parts))
            self._learn(single, groups)
        segments = list(chain.from_iterable(parts))
        if not segments:
            return
        flat_a, flat_b = _flat(a), _flat(b)
        ends_a, ends_b = np.cumsum(self.a_len[flat_a]), np.cumsum(self.b_len[flat_b])
        last = np.cumsum([1 + (len(s) if s.isascii() else len(s.encode())) for s in segments])
        at = np.searchsorted(ends_b, ends_a)
        cut_a = ends_b[at] == ends_a
        cut_b = np.zeros(len(flat_b), bool)
        cut_b[at[cut_a]] = True
        if not np.isin(last, ends_a[cut_a]).all():
            raise ValueError("a token crosses a cut")
        n_a, n_b, n = (np.bincount(np.searchsorted(last, ends), minlength=len(last)) for ends in (ends_a, ends_b, ends_a[cut_a]))
        text = self._groups(flat_a, flat_b, cut_a, cut_b, np.cumsum(n_b) - 1) if groups else []
        self._add(segments, n_a, n_b, n, flat_a[cut_a] << 32 | flat_b[cut_b], text)

    def _add(self, segments: list[str], n_a, n_b, n, keys, groups: list[str]) -> None:
        self.numbers.update(zip(segments, range(len(self.numbers), len(self.numbers) + len(segments)), strict=True))
        self.chars += sum(map(len, segments))
        for grown, found in ((self.n_a, n_a), (self.n_b, n_b), (self.n, n), (self.keys, keys)):
            grown.extend(found)
        self.groups += groups

    @staticmethod
    def _spells(tokens: list[bytes], ids: list[int], text: str) -> bool:
        return b"".join([tokens[i] for i in ids]) == b" " + text.encode()

    def _groups(self, a, b, cut_a, cut_b, last) -> list[str]:
        """Each segment's groups as text. ``last``: position of the last token of B of each segment."""
        order = np.argsort(np.concatenate((2 * (np.cumsum(cut_a) - cut_a), 2 * (np.cumsum(cut_b) - cut_b) + 1)), kind="stable")
        end_b = 2 * cut_b
        end_b[last] = 3
        marks = np.concatenate((1 * cut_a, end_b)) * (len(self.marked) // 4)
        return "".join(map(self.marked.__getitem__, (marks + np.concatenate((a, b)))[order].tolist())).split("\n")[:-1]

    def full(self) -> bool:
        return len(self.numbers) > SEGMENTS or self.chars > SEGMENT_CHARS


def _plain_encoder(path: str):
    """A's encoder of ``PLAIN`` text by the quicker library, as classes of characters can't differ there; None unless the
    file's merges come in the order of their ids, as that library takes ids for ranks."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, byte_of = model["vocab"], {s: i for i, s in enumerate(byte_symbols())}
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if merged != list(range(256, 256 + len(merged))) or {t for t, i in vocab.items() if i < 256} != set(byte_of):
        return None
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if i < 256 + len(merged)}
    return tiktoken.Encoding("plain", pat_str=A_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _joined(segments: list[str]) -> list[list[str]]:
    out, size = [], JOINED + 1
    for segment in segments:
        if size > JOINED:
            out.append([])
            size = 0
        out[-1].append(segment)
        size += len(segment) + 1
    return out


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64)


class _Grown:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.held, self.size = np.empty(1024, kind), 0

    def extend(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self.held):
            self.held = np.concatenate((self.held[: self.size], np.empty(max(len(values), self.size), self.held.dtype)))
        self.held[self.size : self.size + len(values)] = values
        self.size += len(values)

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.size]


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _numbered(batches, text: str, paths: tuple[str, str], groups: bool, forgotten) -> Iterator[tuple[pa.RecordBatch, Aligner, np.ndarray, np.ndarray]]:
    """Batches with the numbers of all texts' segments in a row and how many each text has: none if it has no tokens.
    ``forgotten`` is called before the remembered segments go."""
    both = aligner(*paths)
    both.forget()
    for batch in sliced(batches, text, SLICE_BYTES):
        cut = [both.segments(t) if t else [] for t in batch.column(text).to_pylist()]
        flat = list(chain.from_iterable(cut))
        fresh = set(flat).difference(both.numbers)
        if fresh:
            ends = {s for c in cut if c for s in (c[0], c[-1])}
            both.learn(list(fresh), {s for s in ends if not (SOLID.match(s) and SOLID.match(s[-1]))}, groups)
        found, n = np.fromiter(map(both.numbers.__getitem__, flat), np.int64, len(flat)), np.array([len(c) for c in cut], np.int64)
        text_of = np.repeat(np.arange(len(n)), n)
        bad = np.unique(text_of[both.n_a.all[found] < 0])
        if len(bad):
            found = found[~np.isin(text_of, bad)]
            n[bad] = 0
        yield batch, both, found, n
        if both.full():
            forgotten(both)
            both.forget()
    forgotten(both)
    both.forget()


# Counting


def pair_counts(df: DataFrame, text: str, paths: tuple[str, str]) -> DataFrame:
    """Distinct pairs of each task (key: A's id in the upper, B's in the lower 32 bits) and how often it met them."""

    def run(batches):
        met, ready = np.zeros(0, np.int64), []  # occurrences of each segment

        def forgotten(both):
            nonlocal met
            found, place = np.unique(both.keys.all, return_inverse=True)
            times = np.zeros(len(both.numbers), np.int64)
            times[: len(met)] = met
            counts = np.bincount(place, np.repeat(times, np.maximum(both.n.all, 0)), len(found)).astype(np.int64)
            some = counts > 0
            ready.append(pa.RecordBatch.from_arrays([pa.array(found[some]), pa.array(counts[some])], names=["key", "n"]))
            met = np.zeros(0, np.int64)

        for _, both, found, _ in _numbered(batches, text, paths, False, forgotten):
            more = np.bincount(found, minlength=len(both.numbers))
            more[: len(met)] += met
            met = more
            yield from ready
            ready.clear()
        yield from ready

    return df.select(text).mapInArrow(tidy(run), "key long, n long")


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each key; another one for each seed."""
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class PerfectHash:
    """Numbers distinct keys from 0, without a gap. ``levels``: bit arrays as 64-bit words; ``rest``: sorted keys that
    collided in every level."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest, self.ranks, at = levels, rest, [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(at + np.cumsum(ones) - ones)
            at += int(ones.sum())
        self.size = at + len(rest)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys) and len(levels) < LEVELS:
            words = -(-len(keys) * SPARE // 64)
            place = (mixed(keys, len(levels)) % np.uint64(64 * words)).astype(np.int64)
            alone = np.bincount(place, minlength=64 * words) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            keys = keys[~alone[place]]
        return cls(levels, np.sort(keys))

    def number(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number, below ``size``; some number for a key it was not made of, 0 if it was made of none."""
        out, left = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            place = mixed(keys[left], level) % np.uint64(64 * len(words))
            word, bit = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            hit = words[word] >> bit & np.uint64(1) == 1
            below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (ranks[word] + np.bitwise_count(below))[hit]
            left = left[~hit]
        if len(self.rest):
            out[left] = self.size - len(self.rest) + np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
        return out


class PairIndex:
    """Perfect hashes of slices of the pairs, one after the other, and the key kept at each number."""

    def __init__(self, slices: list[PerfectHash], keys: np.ndarray):
        self.slices, self.keys = slices, keys
        self.starts = np.cumsum([0, *[s.size for s in slices]])

    def number(self, keys: np.ndarray) -> np.ndarray:
        """Each pair's number; -1 for a pair that is not in the index."""
        out = np.full(len(keys), -1, np.int64)
        place = slice_of(keys, len(self.slices))
        for i, part in enumerate(self.slices):
            mine = np.flatnonzero(place == i)
            if part.size and len(mine):
                out[mine] = self.starts[i] + part.number(keys[mine])
        known = out >= 0
        known[known] = self.keys[out[known]] == keys[known]
        return np.where(known, out, -1)


def slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    return (mixed(keys, 1 << 20) % np.uint64(slices)).astype(np.int64)


def index_of(pairs: DataFrame, most: int) -> PairIndex:
    """The hash of all distinct keys of ``pairs``. Slices are built apart, one group each, and put together here."""
    distinct = settle(pairs.select("key").distinct())
    n = distinct.count()
    if n > most:
        raise ValueError(f"{n} pairs, where the vocabularies allow {most}")
    slices = n // SLICE_KEYS + 1

    def dealt(batches):
        for batch in batches:
            keys = batch.column("key")
            yield pa.RecordBatch.from_arrays([pa.array(slice_of(keys.to_numpy(), slices)), keys], names=["slice", "key"])

    def build(batches):
        for group in sorted_groups(batches, ["slice"], least=1):
            keys = group.column("key").to_numpy()
            made = PerfectHash.of(keys)
            kept = np.empty(len(keys), np.int64)
            kept[made.number(keys)] = keys
            levels = pa.array([[w.tobytes() for w in made.levels]], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([group.column("slice").slice(0, 1), levels, pa.array([made.rest.tobytes()]), pa.array([kept.tobytes()])], names=["slice", "levels", "rest", "keys"])

    keyed = distinct.mapInArrow(tidy(dealt), "slice long, key long").repartition("slice").sortWithinPartitions("slice")
    built = {r["slice"]: r for r in keyed.mapInArrow(tidy(build), "slice long, levels array<binary>, rest binary, keys binary").collect()}
    empty = np.empty(0, np.int64)
    hashes = [PerfectHash([np.frombuffer(w, np.uint64) for w in built[i]["levels"]], np.frombuffer(built[i]["rest"], np.int64)) if i in built else PerfectHash([], empty) for i in range(slices)]
    keys = [np.frombuffer(built[i]["keys"], np.int64) if i in built else empty for i in range(slices)]
    return PairIndex(hashes, np.concatenate(keys))


def summed(pairs: DataFrame, index: PairIndex) -> np.ndarray:
    """How often each pair of ``index`` occurs: dense vectors of all tasks, summed slice by slice in a tree."""
    shared = pairs.sparkSession.sparkContext.broadcast(index)

    def vectors(batches):
        index = shared.value
        counts, any_ = np.zeros(len(index.keys), np.int64), False
        for batch in batches:
            any_ = True
            np.add.at(counts, index.number(batch.column("key").to_numpy()), batch.column("n").to_numpy())
        if any_:
            parts = [counts[a:b].tobytes() for a, b in zip(index.starts[:-1], index.starts[1:], strict=True)]
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"slice": np.arange(len(parts)), "part": np.full(len(parts), part, np.int64), "counts": parts})

    def add(batches):
        held, total = None, None
        for batch in batches:
            for s, p, raw in zip(*(batch.column(c) for c in ("slice", "part", "counts")), strict=True):
                key, counts = (s.as_py(), p.as_py()), np.frombuffer(raw.as_buffer(), np.int64)
                if key != held:
                    if held:
                        yield _slice(held, total)
                    held, total = key, counts.copy()
                else:
                    total += counts
        if held:
            yield _slice(held, total)

    schema, lanes = "slice long, part long, counts binary", pairs.rdd.getNumPartitions()
    level, last = pairs.mapInArrow(tidy(vectors), schema), False
    while not last:
        lanes = -(-lanes // FAN_IN)
        last = lanes <= 1
        above = F.lit(0).cast("long") if last else F.floor(F.col("part") / FAN_IN)
        level = level.withColumn("part", above).repartition("slice", "part").sortWithinPartitions("slice", "part").mapInArrow(tidy(add), schema)
    found = {r["slice"]: np.frombuffer(r["counts"], np.int64) for r in level.collect()}
    shared.unpersist()
    return np.concatenate([found.get(i, np.zeros(b - a, np.int64)) for i, (a, b) in enumerate(zip(index.starts[:-1], index.starts[1:], strict=True))])


def _slice(key: tuple[int, int], counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"slice": [key[0]], "part": [key[1]], "counts": [counts.tobytes()]})


# Both passes


def align(df: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """``df`` without ``text``, plus n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair is the most frequent
    of its B token, ties included), count_sum (of the links' counts) and groups_sha256 (of ``a1,a2|b1;a3|b2``; '' for
    none). ``df`` is read twice, so pass a stored table."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    df = clear_of(df, *names)
    kept = [c for c in df.columns if c != text]
    paths = (a_path, b_path)
    pairs = settle(pair_counts(df, text, paths))
    index = index_of(pairs, aligner(*paths).most_pairs)
    counts = summed(pairs, index)
    b_ids = index.keys & 0xFFFFFFFF
    best = np.zeros(int(b_ids.max()) + 1 if len(b_ids) else 0, np.int64)
    np.maximum.at(best, b_ids, counts)
    shared = df.sparkSession.sparkContext.broadcast((index, counts, best[b_ids] == counts))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema)

    def run(batches):
        index, counts, is_best = shared.value
        best, total = _Grown(np.int64), _Grown(np.int64)  # of each segment's links

        def look_up(both):
            sizes = np.maximum(both.n.all[best.size :], 0)
            if len(sizes):
                found = index.number(both.keys.all[both.keys.size - int(sizes.sum()) :])
                there, ends = found >= 0, np.concatenate(([0], np.cumsum(sizes)))
                for grown, values in ((best, is_best), (total, counts)):
                    run = np.concatenate(([0], np.cumsum(np.where(there, values[found], 0) if len(values) else 0 * found)))
                    grown.extend(np.diff(run[ends]))

        def forgotten(_):
            best.size = total.size = 0

        for batch, both, found, n in _numbered(batches, text, paths, True, forgotten):
            look_up(both)
            ends = np.concatenate(([0], np.cumsum(n)))
            sums = [np.diff(np.concatenate(([0], np.cumsum(g.all[found], dtype=np.int64)))[ends]) for g in (both.n_a, both.n_b, both.n, both.n, best, total)]
            numbers, groups = found.tolist(), both.groups
            digests = [hashlib.sha256(";".join([groups[i] for i in numbers[a:b]]).encode()).hexdigest() if b > a else "" for a, b in pairwise(ends.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, *map(pa.array, sums), pa.array(digests, pa.string())], names=[*kept, *names])

    return df.mapInArrow(tidy(run), f"{schema}, {COLUMNS}" if schema else COLUMNS)
