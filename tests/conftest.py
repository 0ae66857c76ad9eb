import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from stayrisk.session import get_session
    s = get_session("local[4]", 4)
    yield s


@pytest.fixture(scope="session")
def sf():
    return SF_SMALL
