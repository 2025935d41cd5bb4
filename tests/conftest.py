import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelcast.session import build_session  # noqa: E402


def pytest_addoption(parser):
    parser.addoption("--all-queries", action="store_true", help="check every registered query against its SQL")


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
