import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from framewright.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def testdata():
    folder = os.environ.get("TESTDATA_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip(f"no test tables at {folder}")
    return folder
