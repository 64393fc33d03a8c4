import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from sensorloom.session import local_session

    session = local_session(cpus=2, shuffle_partitions=3, app="tests")
    yield session
    session.stop()
