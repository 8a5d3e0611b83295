import os
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]


@pytest.fixture(scope="session")
def spark():
    from tallyforge.session import build_session

    session = build_session("tests", cpus=int(os.environ.get("TEST_CPUS", "4")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def smallest():
    return "/root/testdata/sf0.001"
