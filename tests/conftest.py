"""One small local session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rankloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cores=4, shuffle_partitions=4, **{"spark.driver.memory": "4g"})
    yield session
    session.stop()
