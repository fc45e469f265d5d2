import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from touchstone.settings import local_session

    session = local_session(4, "tests")
    yield session
    session.stop()


@pytest.fixture()
def split(spark):
    """Force the range-partitioned paths that large groups take."""
    from touchstone.settings import SMALL_BYTES, SPLIT_ROWS

    spark.conf.set(SMALL_BYTES, "0")
    spark.conf.set(SPLIT_ROWS, "3")
    yield
    spark.conf.unset(SMALL_BYTES)
    spark.conf.unset(SPLIT_ROWS)
