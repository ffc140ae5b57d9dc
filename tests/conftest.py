import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chatloom import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.build("local[8]", 8, "tests")
    s.conf.set(session.PARTS, "8")
    yield s
    s.stop()
