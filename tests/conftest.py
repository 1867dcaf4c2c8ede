import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from stratopoint.session import local_session, ship_package  # noqa: E402
from stratopoint.sources.points import register  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", "4", 4)
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    register(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
