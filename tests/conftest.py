import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from txnrisk.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=4, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def hot(spark):
    """Split keys from ten rows on, so that small data takes the salted paths."""
    from txnrisk.functions.scale import HOT_ROWS_CONF

    spark.conf.set(HOT_ROWS_CONF, "10")
    yield
    spark.conf.unset(HOT_ROWS_CONF)
