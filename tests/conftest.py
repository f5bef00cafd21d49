import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pytest

from quarry.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, 8, "8g")
    s.sparkContext.setLogLevel("OFF")
    return s
