"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over the counts
of vote patterns (at most three to the number of labellers) estimates how often each labeller is right, without any
gold label. The posterior labels then train a hashed linear scorer: logistic regression on the shapes of a text, its
letters, digits and marks, on a bounded sample that grows with nothing but the parameter.

Defined cases: null and blank texts are rejected with score 0; labellers abstain on very short texts; null or
repeated identifiers are rows like any other; an empty table gives an empty result; with one kind of document only,
all of it is kept.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.storage import clear_of
from rollcall.llm.streams import sliced, tidy

# Rows the scorer is trained on; more add nothing to so small a model.
TRAINING_ROWS = 4000
FEATURES = 1 << 12
EM_STEPS = 100
PRIOR_GOOD = 0.8
# Documents are kept from this score on.
KEEP = 0.5
CHUNK = 1 << 16
SHAPE_GRAMS = (2, 3, 4)
ABSTAIN, BAD, GOOD = 0, 1, 2


SPACE, LOWER, UPPER, DIGIT, MARK = range(5)
_CLASS = np.array([SPACE if b in b" \t\n\r\v\f" else LOWER if 97 <= b < 123 or b >= 128 else UPPER if 65 <= b < 91 else DIGIT if 48 <= b < 58 else MARK for b in range(256)], np.uint8)


@dataclass(frozen=True)
class Measures:
    """What the labellers look at. Shares are of words unless they say otherwise."""

    words: int
    upper: float  # of ASCII letters
    letters: float  # of bytes that are not white space
    marked: float  # end in two or more marks
    lone: float  # are a single mark
    exclaimed: float  # marks of exclamation per word
    commonest: float  # are the most frequent word
    fresh: float  # start a word triple that is new

    @classmethod
    def of(cls, text: str) -> Measures:
        raw = text.encode("utf-8", "replace")
        kind = np.zeros(len(raw) + 2, np.uint8)
        kind[1:-1] = _CLASS[np.frombuffer(raw, np.uint8)]
        n = np.bincount(kind[1:-1], minlength=5)
        space, mark = kind == SPACE, kind == MARK
        words = raw.split()
        total = max(1, len(words))
        triples = set(zip(words, words[1:], words[2:], strict=False))
        return cls(
            words=len(words),
            upper=n[UPPER] / max(1, n[UPPER] + n[LOWER]),
            letters=(n[UPPER] + n[LOWER]) / max(1, len(raw) - n[SPACE]),
            marked=(mark[:-2] & mark[1:-1] & space[2:]).sum() / total,
            lone=(space[:-2] & mark[1:-1] & space[2:]).sum() / total,
            exclaimed=raw.count(b"!") / total,
            commonest=max(Counter(words).values(), default=0) / total,
            fresh=len(triples) / max(1, len(words) - 2),
        )


# Each looks for one fault and else says nothing, or vouches for one side of ordinary prose.
LABELLERS = (
    lambda m: BAD if m.marked > 0.2 else ABSTAIN,
    lambda m: BAD if m.lone > 0.2 else ABSTAIN,
    lambda m: BAD if m.letters < 0.75 else ABSTAIN,
    lambda m: BAD if m.upper > 0.4 else ABSTAIN,
    lambda m: BAD if m.exclaimed > 0.4 else ABSTAIN,
    lambda m: BAD if m.commonest > 0.3 and m.words >= 12 else ABSTAIN,
    lambda m: BAD if m.fresh < 0.5 and m.words >= 12 else ABSTAIN,
    lambda m: GOOD if m.letters > 0.9 and m.upper < 0.2 else ABSTAIN,
    lambda m: GOOD if m.fresh > 0.8 and m.commonest < 0.25 else ABSTAIN,
)
LEAST_WORDS = 6


def votes(text: str | None) -> int:
    """The labellers' votes as one number, two bits each; 0 when all abstain."""
    if not text:
        return 0
    m = Measures.of(text)
    if m.words < LEAST_WORDS:
        return 0
    return sum(label(m) << 2 * i for i, label in enumerate(LABELLERS))


@dataclass(frozen=True)
class LabelModel:
    """``rates[c, i, v]``: chance that labeller i votes v on a document of class c (0 bad, 1 good). Each class's rates
    tell how accurate the labeller is; they are known from its overlap with the others alone."""

    prior: float
    rates: np.ndarray

    def posterior(self, pattern: int) -> float:
        """Chance that a document with these votes is good; without votes nothing is known but the prior."""
        if not pattern:
            return self.prior
        v = np.array([pattern >> 2 * i & 3 for i in range(self.rates.shape[1])])
        logs = np.log(self.rates[:, np.arange(len(v)), v]).sum(1) + np.log([1 - self.prior, self.prior])
        return float(1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500))))


def fit_labels(patterns: dict[int, int]) -> LabelModel:
    """Expectation-maximisation over counts of vote patterns, started from the votes themselves.

    Imagined votes keep every labeller better than chance, so the classes cannot change places.
    """
    m = len(LABELLERS)
    patterns = {k: n for k, n in patterns.items() if k}
    keys = np.array(sorted(patterns), np.int64).reshape(-1)
    n = np.array([patterns[k] for k in sorted(patterns)], float)
    v = (keys[:, None] >> 2 * np.arange(m)) & 3
    good = np.where((v == BAD).any(1), 0.05, 0.95)
    total = n.sum() + 100
    imagined = np.array([[[0.5, 0.45, 0.05]], [[0.5, 0.02, 0.48]]]) * 0.01 * total
    prior, rates = PRIOR_GOOD, np.ones((2, m, 3))
    for _ in range(EM_STEPS):
        for c, weight in ((0, n * (1 - good)), (1, n * good)):
            cast = np.array([[weight @ (v[:, i] == vote) for vote in (ABSTAIN, BAD, GOOD)] for i in range(m)]) + imagined[c]
            rates[c] = cast / cast.sum(1, keepdims=True)
        prior = float((n @ good + 0.01 * PRIOR_GOOD * total) / (n.sum() + 0.01 * total))
        logs = np.log(rates)[:, np.arange(m), v].sum(2).T + np.log([1 - prior, prior])
        good = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
    return LabelModel(prior, rates)


# Marks stand for themselves, everything else for its class.
_SHAPE = np.where(_CLASS == MARK, np.arange(256), _CLASS).astype(np.uint8)


# Slots beyond the hashed ones: how much of the text repeats itself.
SLOTS = FEATURES + 2
# Bytes of text that count as much as knowing nothing.
LITTLE = 40


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values: roots of the shares of hashed shape n-grams, and repetition; near 0 for very short texts."""
    raw = text.encode("utf-8", "replace")
    total = np.zeros(FEATURES, np.int64)
    for at in range(0, len(raw), CHUNK):
        part = _SHAPE[np.frombuffer(raw[at : at + CHUNK + max(SHAPE_GRAMS) - 1], np.uint8)].astype(np.uint32)
        for n in SHAPE_GRAMS:
            size = min(CHUNK, len(raw) - at, len(part) - n + 1)
            if size > 0:
                value = np.full(size, n, np.uint32)
                for i in range(n):
                    value = value * np.uint32(131) + part[i : i + size]
                total += np.bincount((value * np.uint32(2654435761)) >> np.uint32(20), minlength=FEATURES)
    where = np.flatnonzero(total)
    m = Measures.of(text)
    few = m.words / (m.words + 2 * LEAST_WORDS)
    values = np.sqrt(total[where] / max(1, total.sum())) * (len(raw) / (len(raw) + LITTLE))
    return np.append(where, [FEATURES, FEATURES + 1]), np.append(values, [(1 - m.fresh) * few, m.commonest * few])


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        """Chance that a text is good; 0 for a blank one."""
        if not text or text.isspace():
            return 0.0
        where, x = features(text)
        return float(1 / (1 + np.exp(np.clip(-(self.weights[where] @ x) - self.bias, -500, 500))))


def fit_scorer(rows: list[tuple[list[int], list[float], float]], steps: int = 300, rate: float = 2.0, decay: float = 1e-4) -> Scorer:
    """Logistic regression on (slots, values, posterior) rows by full gradient steps with momentum."""
    # Fixed: what is said of a text too short to tell.
    weights, bias = np.zeros(SLOTS), float(np.log(PRIOR_GOOD / (1 - PRIOR_GOOD)))
    if not rows:
        return Scorer(weights, bias)
    at = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    col = np.concatenate([np.array(r[0], np.int64) for r in rows])
    x = np.concatenate([np.array(r[1]) for r in rows])
    y = np.array([r[2] for r in rows])
    speed = np.zeros(SLOTS)
    for _ in range(steps):
        z = np.bincount(at, x * weights[col], len(rows)) + bias
        gap = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / len(rows)
        speed = 0.9 * speed - rate * (np.bincount(col, gap[at] * x, SLOTS) + decay * weights)
        weights = weights + speed
    return Scorer(weights, bias)


def vote_counts(docs: DataFrame, text: str = "text") -> dict[int, int]:
    """How many documents show each pattern of votes, over the whole table."""

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            seen.update(votes(t.as_py()) for t in batch.column("text"))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(tidy(run), "pattern long, n long")
    return {r["pattern"]: r["n"] for r in counted.groupBy("pattern").agg(F.sum("n").alias("n")).collect()}


def training_sample(docs: DataFrame, labels: LabelModel, text: str = "text", rows: int = TRAINING_ROWS, total: int | None = None) -> list:
    """Features and posteriors of about ``rows`` documents, chosen by the hash of their text. Undecided ones are left out."""
    total = docs.count() if total is None else total
    pick = F.pmod(F.xxhash64(text), F.lit(1 << 30)) < F.lit(int(min(1.0, rows / max(total, 1)) * (1 << 30)))

    def run(batches):
        for batch in sliced(batches, "text"):
            out = []
            for t in batch.column("text"):
                pattern = votes(t.as_py())
                if pattern:
                    where, x = features(t.as_py())
                    out.append((where.tolist(), x.tolist(), labels.posterior(pattern)))
            if out:
                a, b, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.list_(pa.int32())), pa.array(b, pa.list_(pa.float32())), pa.array(c)], names=["slots", "values", "good"])

    # Equal texts are one row here: copies would only crowd the sample.
    sample = docs.where(F.col(text).isNotNull() & pick).select(F.col(text).alias("text")).distinct()
    return [tuple(r) for r in sample.mapInArrow(tidy(run), "slots array<int>, `values` array<float>, good double").collect()]


def fit(docs: DataFrame, text: str = "text") -> tuple[LabelModel, Scorer]:
    patterns = vote_counts(docs, text)
    labels = fit_labels(patterns)
    return labels, fit_scorer(sorted(training_sample(docs, labels, text, total=sum(patterns.values())), key=repr))


def scored(df: DataFrame, model: tuple[LabelModel, Scorer], text: str = "text", keep_text: bool = False) -> DataFrame:
    """``df`` (without ``text`` unless kept) plus votes_good (posterior of the labellers), quality_score, keep."""
    df = clear_of(df, "votes_good", "quality_score", "keep")
    kept = [c for c in df.columns if keep_text or c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        labels, scorer = shared.value
        for batch in sliced(batches, text):
            texts = batch.column(text).to_pylist()
            weak = [labels.posterior(votes(t)) for t in texts]
            score = [scorer.score(t) for t in texts]
            columns = [pa.array(weak, pa.float64()), pa.array(score, pa.float64()), pa.array([s >= KEEP for s in score], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, *columns], names=[*kept, "votes_good", "quality_score", "keep"])

    return df.mapInArrow(tidy(run), f"{schema}, votes_good double, quality_score double, keep boolean")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without those the scorer rejects, columns as they are."""
    marked = scored(docs, fit(docs, text), text, keep_text=True).where("keep")
    own = marked.columns[: len(docs.columns)]
    return marked.select(*[F.col(f"`{c}`").alias(name) for c, name in zip(own, docs.columns, strict=True)])
