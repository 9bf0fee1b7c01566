import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from gaugeworks.session import local_session

    s = local_session(4, 4, "4g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    """The smallest driver tables, where they are installed."""
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    return d
