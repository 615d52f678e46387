import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from odd import ODD, SCHEMA, rows_of  # noqa: E402


@pytest.fixture(scope="session")
def documents(spark):
    return lambda pairs: spark.createDataFrame(rows_of(pairs), SCHEMA)


@pytest.fixture(scope="session")
def odd(documents):
    return documents(ODD)


@pytest.fixture(scope="session")
def empty(documents):
    return documents([])
