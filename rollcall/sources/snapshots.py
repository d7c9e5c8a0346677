"""Monthly registry snapshots.

All months of a table live in one logical table partitioned by ``anomes_ods``; the benefit views are
partitioned by ``RF_FOLHA``. Picking a month is a filter on the partition column, so only that month's
files are listed and read.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from rollcall.params import Month
from rollcall.registry import Registry
from rollcall.schemas import TABLES, conform

MONTH_COLUMN = "anomes_ods"
VIEW_MONTH_COLUMN = "RF_FOLHA"
MONTHLY_VIEWS = ("VW_FOLHA_PAGAMENTO", "VW_PRE_HABILITACAO_PBF")

# Columns a stored table is clustered by inside a month, so that filters on them skip row groups.
CLUSTERED_BY = {
    "TB_FAMILIA_01": ("CO_MUNIC_IBGE_2_FAM", "CO_MUNIC_IBGE_5_FAM", "CO_FAMILIAR_FAM"),
    "TB_PESSOA_04": ("CO_FAMILIAR_FAM", "CO_CHV_NATURAL_PESSOA"),
    "TB_DOCUMENTO_05": ("NU_CPF_PESSOA", "CO_CHV_NATURAL_PESSOA"),
    "TB_ESCOLARIDADE_07": ("CO_CHV_NATURAL_PESSOA",),
    "TB_CONTATO_09": ("CO_FAMILIAR_FAM",),
    "TB_PESSOA_EXCLUIDA_19": ("CO_CHV_NATURAL_PESSOA",),
    "VW_FOLHA_PAGAMENTO": ("CO_FAMILIAR",),
    "VW_PRE_HABILITACAO_PBF": ("CO_FAMILIAR",),
}

# Keys looked up by which a stored table is not sorted first: a Bloom filter in each row group tells whether one is there.
BLOOM_KEYS = {
    "TB_FAMILIA_01": ("CO_FAMILIAR_FAM",),
    "TB_PESSOA_04": ("CO_CHV_NATURAL_PESSOA",),
    "TB_DOCUMENTO_05": ("CO_CHV_NATURAL_PESSOA", "NU_CPF_PESSOA"),
}

# Key whose buckets a catalogue table is stored in: tables that meet by family stay in place when they are joined, and a
# document joined to its person moves the persons only.
BUCKETED_BY = {
    "TB_FAMILIA_01": "CO_FAMILIAR_FAM",
    "TB_PESSOA_04": "CO_FAMILIAR_FAM",
    "TB_DOCUMENTO_05": "CO_CHV_NATURAL_PESSOA",
    "TB_ESCOLARIDADE_07": "CO_CHV_NATURAL_PESSOA",
    "TB_CONTATO_09": "CO_FAMILIAR_FAM",
    "TB_PESSOA_EXCLUIDA_19": "CO_CHV_NATURAL_PESSOA",
    "VW_FOLHA_PAGAMENTO": "CO_FAMILIAR",
    "VW_PRE_HABILITACAO_PBF": "CO_FAMILIAR",
}


@dataclass(frozen=True)
class SnapshotStore:
    """Where the tables come from: a function from table name to the frame holding all its months."""

    open_table: Callable[[str], DataFrame]

    @classmethod
    def parquet(cls, spark: SparkSession, root: str) -> SnapshotStore:
        """``root/<table name>`` directories of Parquet files."""
        return cls(lambda name: spark.read.parquet(f"{root.rstrip('/')}/{name}"))

    @classmethod
    def catalog(cls, spark: SparkSession, database: str | None = None) -> SnapshotStore:
        """Tables of the session catalogue."""
        return cls(lambda name: spark.table(f"{database}.{name}" if database else name))

    @classmethod
    def frames(cls, frames: Mapping[str, DataFrame]) -> SnapshotStore:
        return cls(lambda name: frames[name])

    def at(self, anomes_ods: int) -> Snapshot:
        return Snapshot(self, Month(anomes_ods))


@dataclass(frozen=True)
class Snapshot:
    """One month of a store."""

    store: SnapshotStore
    month: Month

    def table(self, name: str) -> DataFrame:
        """A registry table at this month, or a benefit view with all its months."""
        return conform(self._rows(name), TABLES[name], name)

    def _rows(self, name: str) -> DataFrame:
        rows = self.store.open_table(name)
        return rows if name in MONTHLY_VIEWS else rows.where(F.col(MONTH_COLUMN) == self.month.yyyymm)

    def registry(self) -> Registry:
        return Registry(self._rows)


def _clustered(df: DataFrame, name: str) -> DataFrame:
    keys = CLUSTERED_BY[name]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def _with_bloom_filters(writer: DataFrameWriter, name: str) -> DataFrameWriter:
    """The writer with a filter for each key in ``BLOOM_KEYS``, as large as the row group's keys need."""
    for key in BLOOM_KEYS.get(name, ()):
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    return writer.option("parquet.bloom.filter.adaptive.enabled", "true")


def write_snapshot_table(df: DataFrame, root: str, name: str, anomes_ods: int) -> None:
    """Store one month of a registry table, replacing that month only."""
    target = f"{root.rstrip('/')}/{name}/{MONTH_COLUMN}={Month(anomes_ods).yyyymm}"
    writer = _clustered(conform(df, TABLES[name], name), name).write.mode("overwrite")
    _with_bloom_filters(writer, name).parquet(target)


def write_monthly_view(df: DataFrame, root: str, name: str) -> None:
    """Store a benefit view partitioned by month, replacing the months present in ``df``."""
    keys = (VIEW_MONTH_COLUMN, *CLUSTERED_BY[name])
    rows = conform(df, TABLES[name], name)
    (
        rows.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(VIEW_MONTH_COLUMN)
        .parquet(f"{root.rstrip('/')}/{name}")
    )


def write_bucketed(
    df: DataFrame, name: str, buckets: int, anomes_ods: int | None = None, database: str | None = None, path: str | None = None
) -> None:
    """Store a table in the session catalogue, in ``buckets`` buckets of its join key, sorted by it.

    A registry table replaces one month (``anomes_ods``), a benefit view the months present in ``df``; other
    months stay. Use the same number of buckets for all tables, about one for each 128 MB of the largest
    month. ``path`` keeps a new table's files there instead of in the warehouse. Read it with
    ``SnapshotStore.catalog``.
    """
    spark, table, key = df.sparkSession, f"{database}.{name}" if database else name, BUCKETED_BY[name]
    rows, month = conform(df, TABLES[name], name), VIEW_MONTH_COLUMN
    if name not in MONTHLY_VIEWS:
        if anomes_ods is None:
            raise ValueError(f"{name} is stored by snapshot month: give anomes_ods")
        rows, month = rows.withColumn(MONTH_COLUMN, F.lit(Month(anomes_ods).yyyymm)), MONTH_COLUMN
    # The month goes last, as the partition column does in the stored table. Each task writes whole buckets.
    rows = rows.select(*[c for c in rows.columns if c != month], month).repartition(buckets, key)
    if spark.catalog.tableExists(table):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").insertInto(table)
    else:
        writer = _with_bloom_filters(rows.write.format("parquet"), name).partitionBy(month).bucketBy(buckets, key).sortBy(key)
        (writer.option("path", path) if path else writer).saveAsTable(table)
