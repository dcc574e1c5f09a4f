import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from gridcast.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="4g", partitions=4)
    ship_package(session)
    yield session
    from gridcast.scratch import drop_scratch

    drop_scratch(session)
    session.stop()
