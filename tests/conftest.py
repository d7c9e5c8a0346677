"""One Spark session for all tests, and a builder for small hand-made frames."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from oracle_check import session  # noqa: E402

from rollcall.registry import Registry  # noqa: E402
from rollcall.schemas import TABLES  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session()
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """frame(schema, rows): rows are dicts; columns left out are NULL."""

    def build(schema, rows):
        names = [f.name for f in schema.fields]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)

    return build


@pytest.fixture(scope="session")
def registry(frame):
    """registry(TB_PESSOA_04=[...], ...): tables left out are empty."""

    def build(**tables):
        frames = {name: frame(schema, tables.get(name, [])) for name, schema in TABLES.items()}
        return Registry(frames.__getitem__)

    return build
