"""Language identification by error-correcting output codes.

Every language has a codeword; bit b of the codewords splits the languages in two, and one binary classifier per bit
tells the halves apart from hashed byte n-grams. Their weights are smoothed log odds of n-gram frequencies, from one
grouped count over the training rows. Decoding weighs each bit's loss by how sure its classifier is and takes the
nearest codeword; a small gap to the second nearest is flagged.

Defined cases: a text that is null or has no letters is ``und`` with score 0; null languages and ``und`` are not
learned from; without any training row every text is ``und``; with one language every text with letters is that
language, score 1; ties go to the first language in code point order; null or repeated identifiers are rows like any
other; an empty table gives an empty result. What reaches the driver is one count per language and n-gram bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.storage import clear_of
from rollcall.llm.streams import tidy

UNKNOWN = "und"
# Hash buckets of n-grams, and the lengths counted.
BUCKETS = 1 << 16
NGRAMS = (1, 2, 3, 4)
# Bytes of a text counted at once; longer ones are counted in parts.
CHUNK = 1 << 16
# Above five languages the code has this many bits per binary digit of their number.
BITS_PER_DIGIT = 12
# A gap between the two nearest codewords below this share of a bit's loss is ambiguous.
AMBIGUOUS = 0.1
SMOOTHING = 0.5


def codebook(n: int) -> np.ndarray:
    """Codewords of +1 and -1, one row per language: all splits for up to five, else random ones that differ widely."""
    if n < 2:
        return np.ones((n, 0), int)
    if n <= 5:
        splits = np.arange(2 ** (n - 1) - 1)
        return np.vstack([np.ones(len(splits), int), *(np.where(splits >> i & 1, 1, -1) for i in range(n - 1))])
    bits, rng = BITS_PER_DIGIT * int(np.ceil(np.log2(n))), np.random.default_rng(n)
    best, distance = None, -1
    for _ in range(50):
        code = rng.choice([-1, 1], (n, bits))
        code[0, np.abs(code.sum(0)) == n] *= -1  # a bit must tell some languages apart
        apart = (bits - code @ code.T) // 2
        least = apart[~np.eye(n, dtype=bool)].min()
        if least > distance:
            best, distance = code, least
    return best


def ngram_counts(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets that occur, and how often."""
    raw = (" " + " ".join(text.lower().split()) + " ").encode("utf-8", "replace")
    total = np.zeros(buckets, np.int64) if len(raw) > CHUNK else None
    found = []
    for at in range(0, len(raw), CHUNK):
        part = np.frombuffer(raw[at : at + CHUNK + max(NGRAMS) - 1], np.uint8).astype(np.uint64)
        fresh = min(CHUNK, len(raw) - at)
        hashes = []
        for n in NGRAMS:
            size = min(fresh, len(part) - n + 1)
            if size > 0:
                value = np.full(size, n, np.uint64)
                for i in range(n):
                    value = value * np.uint64(257) + part[i : i + size]
                value *= np.uint64(0x9E3779B97F4A7C15)
                hashes.append((value >> np.uint64(40)).astype(np.int64) % buckets)
        if hashes:
            where, count = np.unique(np.concatenate(hashes), return_counts=True)
            if total is not None:
                total[where] += count
            else:
                found = where, count
    if total is not None:
        where = np.flatnonzero(total)
        return where, total[where]
    return found if len(found) else (np.zeros(0, int), np.zeros(0, int))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # one row per bit
    bias: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (0 to 1), and whether the decision is ambiguous."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        where, count = ngram_counts(text)
        # Log odds of all n-grams of the text; the square root tempers how fast they pile up.
        margin = self.weights[:, where] @ count / np.sqrt(count.sum()) + self.bias
        sure = np.abs(margin) / (1e-9 + np.abs(margin).sum())
        loss = np.logaddexp(0, -self.code * margin) @ sure
        order = np.argsort(loss, kind="stable")
        share = np.exp(loss[order[0]] - loss)
        return self.languages[order[0]], float(share[order[0]] / share.sum()), bool(loss[order[1]] - loss[order[0]] < AMBIGUOUS)


def fit(training: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS) -> Model:
    """Learn from every row of ``training`` that has a language and a text."""

    def run(batches):
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
                where, count = ngram_counts(t.as_py(), buckets)
                seen.setdefault(name, np.zeros(buckets, np.int64))[where] += count
        for name, total in seen.items():
            where = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(where)), pa.array(where), pa.array(total[where])], names=["lang", "bucket", "n"])

    rows = training.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.col(lang) != UNKNOWN))
    counted = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang")).mapInArrow(tidy(run), "lang string, bucket long, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("cells"))
    found = {r["lang"]: r["cells"] for r in table.collect()}
    languages = sorted(found)
    counts = np.zeros((len(languages), buckets))
    for i, name in enumerate(languages):
        cells = np.array([tuple(c) for c in found[name]], np.int64)
        counts[i, cells[:, 0]] = cells[:, 1]
    code = codebook(len(languages))
    # Each language counts alike, however much of it there is.
    share = counts / np.maximum(1, counts.sum(1, keepdims=True)) if languages else counts
    weights = np.zeros((code.shape[1], buckets), np.float32)
    for b in range(code.shape[1]):
        halves = [share[code[:, b] == side].mean(0) for side in (1, -1)]
        odds = [np.log(h + SMOOTHING / max(1.0, counts.sum())) for h in halves]
        weights[b] = odds[0] - odds[1]
    return Model(languages, code, weights, np.zeros(code.shape[1]))


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` without ``text``, plus lang_pred, score, ambiguous."""
    df = clear_of(df, "lang_pred", "score", "ambiguous")
    kept = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema)
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most bits x BUCKETS numbers

    def run(batches):
        for batch in batches:
            said = [shared.value.predict(t.as_py()) for t in batch.column(text)]
            names, scores, doubts = zip(*said, strict=True) if said else ((), (), ())
            columns = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(doubts, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, *columns], names=[*kept, "lang_pred", "score", "ambiguous"])

    return df.mapInArrow(tidy(run), f"{schema}, lang_pred string, score double, ambiguous boolean")


def held_out(id_col: str) -> Column:
    """Rows kept from training: a third by the checksum of the identifier (null: trained on)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
