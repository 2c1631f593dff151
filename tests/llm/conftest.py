"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

import pytest
from awkward_rows import ROWS, awkward


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward(), ROWS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], ROWS)


@pytest.fixture(scope="session")
def views(duck):
    """Views of an Arrow table for SQL."""

    def register(**frames):
        for name, df in frames.items():
            duck.register(f"{name}_rows", df.toArrow())
            duck.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {name}_rows")
        return duck

    return register
