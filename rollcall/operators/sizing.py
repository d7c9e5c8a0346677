"""Size-checked broadcasting.

A relation is broadcast only after its rows were counted and their bytes added up, in one pass. Whole rows are broadcast
up to ``MAX_BROADCAST_BYTES``; of a wider relation of few rows only the keys are, as an early semi-join, and its columns
are attached by a shuffled join. Beyond both limits the same result comes from shuffled joins alone.

The keys of a stored relation of very few rows go into the scan as literals instead, where Parquet skips the row groups
whose range or Bloom filter excludes them all: a lookup of one tax id then does not read the keys of whole tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.session import MAX_LITERAL_KEYS, settle

# Key rows (a few columns wide) that every executor can hold many times over.
MAX_BROADCAST_ROWS = 1_000_000
# Bytes of whole rows broadcast at most, as ``row_bytes`` counts them.
MAX_BROADCAST_BYTES = 64 << 20


def row_bytes(df: DataFrame) -> Column:
    """About what a row takes in memory: eight bytes a column, sixteen a decimal, and texts in full."""
    sizes = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            sizes.append(F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) + 8)
        else:
            sizes.append(F.lit(16 if isinstance(f.dataType, T.DecimalType) else 8))
    return sum(sizes, F.lit(8)).cast("long")


@dataclass(frozen=True)
class Measured:
    """A relation known to have at most ``rows`` rows, or too many or an unknown number (``None``).

    ``bytes`` is their size; unknown only where ``rows`` is. ``kept`` relations are stored, so reading their keys
    costs nothing but these rows.
    """

    frame: DataFrame
    rows: int | None
    bytes: int | None = None
    kept: bool = False
    _literals: dict[str, list] = field(default_factory=dict, compare=False, repr=False)

    @property
    def small(self) -> bool:
        return self.rows is not None

    @property
    def light(self) -> bool:
        """Whether whole rows may be broadcast."""
        return self.small and self.bytes is not None and self.bytes <= MAX_BROADCAST_BYTES

    def narrow(self, big: DataFrame, big_key: str, key: str | None = None) -> DataFrame:
        """Rows of ``big`` whose key occurs here, found by a map-side semi-join when this is small, or by the scan
        when this is stored and has at most ``MAX_LITERAL_KEYS`` rows.

        A large relation returns ``big`` as it is: the join that follows does the matching anyway, so
        this is only ever an early reduction.
        """
        if not self.small:
            return big
        if self.kept and self.rows <= MAX_LITERAL_KEYS:
            return big.where(F.col(big_key).isin(self._few(key or big_key)))
        keys = self.frame.select(F.col(key or big_key).alias(big_key)).distinct()
        return big.join(F.broadcast(keys), big_key, "left_semi")

    def _few(self, key: str) -> list:
        """The different values of ``key``, which are at most ``rows``; NULL matches nothing and is left out."""
        if key not in self._literals:
            self._literals[key] = sorted({r[0] for r in self.frame.select(key).collect()} - {None})
        return self._literals[key]

    def hinted(self) -> DataFrame:
        """The frame, marked for broadcast only when its rows are few and light."""
        return F.broadcast(self.frame) if self.light else self.frame


def measure(df: DataFrame, max_rows: int | None = None, keep: bool = False) -> Measured:
    """Count ``df``; nothing but the count reaches the driver.

    ``keep`` writes the relation to the checkpoint folder and counts it in that same pass, so that neither
    the count nor the joins built on it compute it again. Use it for what is expected to be a small part of a
    large table.
    """
    sizes = [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("bytes")]
    if keep:
        # Counted while it is written; a task that ran twice can only make the figures too large.
        seen = Observation()
        frame = settle(df.observe(seen, *sizes))
        found = seen.get
    else:
        frame, found = df, df.agg(*sizes).first()
    rows = found["rows"]
    return Measured(frame, rows, found["bytes"], keep) if rows <= _limit(max_rows) else Measured(frame, None)


def measure_keys(keys: DataFrame, max_rows: int | None = None) -> Measured:
    """Distinct non-NULL values of a one-column frame, measured.

    The number of rows bounds the number of keys and is cheap to count, so the keys themselves are only
    counted when there are too many rows to tell.
    """
    distinct = keys.where(F.col(keys.columns[0]).isNotNull()).distinct()
    found = keys.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row_bytes(keys)), F.lit(0)).alias("bytes")).first()
    if found["rows"] <= _limit(max_rows):
        return Measured(distinct, found["rows"], found["bytes"])
    return measure(distinct, max_rows)


def _limit(max_rows: int | None) -> int:
    return MAX_BROADCAST_ROWS if max_rows is None else max_rows
