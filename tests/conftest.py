import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from fleetwatt.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(os.environ.get("FLEETWATT_CPUS", "8"), "fleetwatt-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("FLEETWATT_SF_DIR", "/root/testdata/sf0.001")
