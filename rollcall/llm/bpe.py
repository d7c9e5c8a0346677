"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of the tree are the pairs of neighbouring symbols, each with the rank of its merge; the root is the
smallest rank, leftmost first. A merge changes at most three leaves, each updated along one path, until the root
holds no rank. Short words are merged many at a time, one tree per row of an array; long ones alone. A task keeps
the words it has met, within a bound.

The vocabulary file is a parameter: a tokenizer file with NFC, white-space and lower-case normalisation, a split
pattern, byte symbols and an end-of-word suffix. Its special tokens are found in the raw text. Latin-1 text is cut
into words by a plain pattern, other text by the normaliser and the split of the tokenizers library, whose Unicode
version decides what is a letter; merging and decoding are done here for both. The file must be readable where Python
runs; without it on the executors, ship it with ``SparkContext.addFile``.

Defined cases: a null text counts as empty and gives no tokens; rows are independent, so repeated rows and
identifiers do not matter; an empty table gives an empty result; a column that has the name of a new one is carried
along under its name and ``_input``; a very long text is held once, with its words and its ids, and cut into words a
part at a time.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from contextlib import contextmanager
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rollcall.llm.storage import clear_of
from rollcall.llm.streams import sliced, tidy

# Words a task remembers before it starts anew.
CACHED_WORDS = 60_000
# Longer words are merged one by one.
BATCH_WIDTH = 32
BATCH_WORDS = 4_000
# Characters of text whose new words are merged together.
BATCH_CHARS = 500_000
# Bytes of text encoded before their rows are handed on.
SLICE_BYTES = 1 << 20
NONE = np.int64(1) << 62
# Segments between spaces of other than Latin-1 text whose words are remembered, and their longest length.
SEGMENTS = 60_000
SEGMENT_CHARS = 64
# White space at which such text is cut first: no word crosses it and nothing composes with it.
SPACES = str.maketrans("\n\u3000", "  ")
# Letters and numbers of lower-case Latin-1 text, as ranges of a character class.
LATIN_LETTERS = "a-zªµºß-öø-ÿ"
LATIN_NUMBERS = "0-9²³¹¼-¾"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte, as byte-level vocabularies define it."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """The tokenizer of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # What comes before the merges, as the library reads it; it needs some model to be a tokenizer.
        self.cutting = {**spec, "pre_tokenizer": spec["pre_tokenizer"]["pretokenizers"][0]}
        self.cutting |= {"added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}
        pattern = self.cutting["pre_tokenizer"]["pattern"]["Regex"]
        # The same pattern for lower-case Latin-1 text, where the plain engine is faster. No two alternatives but the
        # apostrophe's begin alike, so runs of letters may be tried first.
        latin = pattern.replace(r"\s", r"\x09-\x0d\x20\x85\xa0").replace(r"\p{L}", LATIN_LETTERS).replace(r"\p{N}", LATIN_NUMBERS)
        self.latin_words = re.compile(f"[{LATIN_LETTERS}]+|{latin}")
        self.cut = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.names = {i: t for t, i in (*self.vocab.items(), *self.special.items())}
        symbols = byte_symbols()
        self.inner = np.array([self.vocab[s] for s in symbols])
        self.last = np.array([self.vocab[s + self.suffix] for s in symbols])
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([self.vocab[a] << 32 | self.vocab[b] for a, b in pairs])
        made = np.array([self.vocab[a + b] for a, b in pairs])
        self.merges = {int(k): (r, int(i)) for r, (k, i) in reversed(list(enumerate(zip(keys, made, strict=True))))}
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made[order]
        self.cache: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}
        self.segments: dict[str, list[str]] = {}

    @cached_property
    def cutter(self):
        """The library's normaliser and split, without a vocabulary; loaded only where other than Latin-1 text occurs."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(json.dumps(self.cutting))

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return [word for segment in text.translate(SPACES).split(" ") for word in self.segments.get(segment) or self.cut_segment(segment)]
        return self.latin_words.findall(text.lower())

    def cut_segment(self, segment: str) -> list[str]:
        words = [w for w, _ in self.cutter.pre_tokenizer.pre_tokenize_str(self.cutter.normalizer.normalize_str(segment))] if segment else []
        if len(segment) <= SEGMENT_CHARS:
            if len(self.segments) >= SEGMENTS:
                self.segments.clear()
            self.segments[segment] = words
        return words

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens in order."""
        if self.cut is None or "<|" not in text and not self.cut.search(text):
            return self.split(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += self.split(text[at : m.start()])
            out.append("\0" + m[0])
            at = m.end()
        return out + self.split(text[at:])

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[at] == key
        return np.where(known, self.ranks[at], NONE), self.made[at]

    def merge_batch(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has. Words have 2 to ``width`` bytes, ``width`` is a power
        of two; row w of each array belongs to word w."""
        n, rows = len(words), np.arange(len(words))
        length = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        symbol = self.inner[raw]
        symbol[rows, length - 1] = self.last[raw[rows, length - 1]]
        place = np.arange(width)
        after = np.where(place[None, :] + 1 < length[:, None], place[None, :] + 1, width)
        before = np.tile(place - 1, (n, 1))
        rank, made = self.lookup(symbol[:, :-1], symbol[:, 1:])
        alive = place[None, : width - 1] + 1 < length[:, None]
        shift = width.bit_length()
        tree = np.full((n, 2 * width), NONE)
        tree[:, width : 2 * width - 1] = np.where(alive & (rank < NONE), rank << shift | place[: width - 1], NONE)
        product = np.zeros((n, width), np.int64)
        product[:, : width - 1] = made
        for level in range(width - 1, 0, -1):
            tree[:, level] = np.minimum(tree[:, 2 * level], tree[:, 2 * level + 1])

        def set_leaf(r, p, value):
            node = p + width
            tree[r, node] = value
            while node[0] > 1:
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        def rank_of(r, p, q):
            new_rank, product[r, p] = self.lookup(symbol[r, p], symbol[r, q])
            return np.where(new_rank < NONE, new_rank << shift | p, NONE)

        busy = rows[tree[:, 1] < NONE]
        while len(busy):
            p = tree[busy, 1] & ((1 << shift) - 1)
            q = after[busy, p]
            symbol[busy, p] = product[busy, p]
            symbol[busy, q] = -1
            nxt = after[busy, p] = after[busy, q]
            right = np.full(len(busy), NONE)
            more = np.flatnonzero(nxt < width)
            before[busy[more], nxt[more]] = p[more]
            right[more] = rank_of(busy[more], p[more], nxt[more])
            set_leaf(busy, q, NONE)
            set_leaf(busy, p, right)
            prev = before[busy, p]
            some = np.flatnonzero(prev >= 0)
            if len(some):
                r = busy[some]
                set_leaf(r, prev[some], rank_of(r, prev[some], p[some]))
            busy = busy[tree[busy, 1] < NONE]
        kept = (symbol >= 0) & (place[None, :] < length[:, None])
        return symbol[kept], kept.sum(1)

    def merge_long(self, word: bytes) -> list[int]:
        """One word of any length: n log n steps."""
        symbol = [int(self.inner[b]) for b in word]
        symbol[-1] = int(self.last[word[-1]])
        n = len(symbol)
        size = 1 << max(1, (n - 1).bit_length())
        none = (1 << 62, 0)
        merges = self.merges

        def leaf(p, q):
            found = merges.get(symbol[p] << 32 | symbol[q])
            return (found[0], p) if found else none

        tree = [none] * (2 * size)
        for p in range(n - 1):
            tree[size + p] = leaf(p, p + 1)
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def update(p, value):
            node = p + size
            tree[node] = value
            while node > 1:
                node >>= 1
                best = min(tree[2 * node], tree[2 * node + 1])
                if best == tree[node]:
                    break
                tree[node] = best

        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        while tree[1] is not none and tree[1] != none:
            p = tree[1][1]
            q = after[p]
            symbol[p] = merges[symbol[p] << 32 | symbol[q]][1]
            symbol[q] = -1
            update(q, none)
            nxt = after[p] = after[q]
            if nxt >= 0:
                before[nxt] = p
            update(p, leaf(p, nxt) if nxt >= 0 else none)
            if before[p] >= 0:
                update(before[p], leaf(before[p], p))
        return [s for s in symbol if s >= 0]

    def remember(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        ends = np.cumsum(counts).tolist()
        raw, names, at = ids.astype("<u4").tobytes(), [self.names[i] for i in ids.tolist()], 0
        for word, end in zip(words, ends, strict=True):
            self.cache[word] = raw[4 * at : 4 * end]
            self.shown[word] = " ".join(names[at:end])
            at = end

    def learn(self, words: set[str]) -> None:
        fresh = words - self.cache.keys()
        if len(self.cache) + len(fresh) > CACHED_WORDS:
            self.cache.clear()
            self.shown.clear()
            fresh = words
        by_width: dict[int, list[str]] = {}
        for word in fresh:
            n = len(word) if word.isascii() else len(word.encode())
            if word[0] == "\0" and word[1:] in self.special:
                ids = [self.special[word[1:]]]
            elif n == 1:
                ids = [int(self.last[ord(word)])]
            elif n > BATCH_WIDTH:
                ids = self.merge_long(word.encode())
            else:
                by_width.setdefault(max(4, 1 << (n - 1).bit_length()), []).append(word)
                continue
            self.remember([word], np.array(ids), np.array([len(ids)]))
        for width, found in by_width.items():
            for at in range(0, len(found), BATCH_WORDS):
                part = found[at : at + BATCH_WORDS]
                self.remember(part, *self.merge_batch([w.encode() for w in part], width))

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian unsigned 32-bit integers and its decoded text."""
        gc.disable()  # nothing here makes cycles, and walking the remembered words again and again is slow
        out, part, size = [], [], 0
        for i, text in enumerate(texts):
            part.append(self.pieces(text) if text else [])
            size += len(text or "")
            if size > BATCH_CHARS or i + 1 == len(texts):
                self.learn(set().union(*part))
                out += [(b"".join(map(self.cache.__getitem__, p)), " ".join(map(self.shown.__getitem__, p))) for p in part]
                part, size = [], 0
        gc.enable()
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.names[i] for i in ids if i in self.names])


@lru_cache(maxsize=2)
def _loaded(path: str) -> WordBpe:
    return WordBpe(path)


@contextmanager
def tokenizer(path: str):
    """The tokenizer of a worker process, which other tasks use too; the words it met are forgotten afterwards."""
    bpe = _loaded(path)
    try:
        yield bpe
    finally:
        bpe.cache.clear()
        bpe.shown.clear()
        bpe.segments.clear()


def _add(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def encode_digests(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` without ``text``, plus n_tokens, ids_sha256 and decoded_sha256."""
    df = clear_of(df, "n_tokens", "ids_sha256", "decoded_sha256")
    kept = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema)

    def run(batches):
        with tokenizer(path) as bpe:
            for batch in sliced(batches, text, SLICE_BYTES):
                coded = bpe.encode(batch.column(text).to_pylist())
                yield _add(
                    batch.select(kept),
                    {
                        "n_tokens": pa.array([len(ids) // 4 for ids, _ in coded], pa.int64()),
                        "ids_sha256": pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in coded]),
                        "decoded_sha256": pa.array([hashlib.sha256(shown.encode()).hexdigest() for _, shown in coded]),
                    },
                )

    return df.mapInArrow(tidy(run), f"{schema}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_tokens(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` plus ``tokens`` (array of ids) and ``decoded``."""
    df = clear_of(df, "tokens", "decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches):
        with tokenizer(path) as bpe:
            for batch in sliced(batches, text, SLICE_BYTES):
                coded = bpe.encode(batch.column(text).to_pylist())
                tokens = pa.array([np.frombuffer(ids, "<i4") for ids, _ in coded], pa.list_(pa.int32()))
                yield _add(batch, {"tokens": tokens, "decoded": pa.array([shown for _, shown in coded], pa.string())})

    return df.mapInArrow(tidy(run), f"{schema}, tokens array<int>, decoded string")


def decode_tokens(df: DataFrame, path: str, tokens: str = "tokens") -> DataFrame:
    """``df`` plus ``decoded``; null or unknown ids are left out."""
    df = clear_of(df, "decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches):
        with tokenizer(path) as bpe:
            for batch in batches:
                yield _add(batch, {"decoded": pa.array([bpe.decode(ids or []) for ids in batch.column(tokens).to_pylist()], pa.string())})

    return df.mapInArrow(tidy(run), f"{schema}, decoded string")
