from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cases import SCHEMA, messy  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(messy(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
