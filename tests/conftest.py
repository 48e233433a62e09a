import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetlake.session import local_session, prepare  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = prepare(local_session("8", "fleetlake-tests"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duckdb_tables():
    from compare import duck

    return duck(SF)
