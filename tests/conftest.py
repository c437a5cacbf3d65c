from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.session import test_session  # noqa: E402

test_session.__test__ = False


@pytest.fixture(scope="session")
def spark():
    session = test_session()
    yield session
    session.stop()
