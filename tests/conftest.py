import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pairloom.session import local_session, release  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests")
    yield session
    release(session)
    session.stop()
