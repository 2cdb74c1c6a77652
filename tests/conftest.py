import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools"), os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark():
    from eventide.session import local_session

    session = local_session(4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
