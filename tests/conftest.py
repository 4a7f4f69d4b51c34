import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from netloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Build a frame from tuples and DDL."""
    return lambda data, ddl: spark.createDataFrame(list(data), ddl)


def values(df, *columns):
    """Rows as a sorted list of tuples, for comparisons."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
