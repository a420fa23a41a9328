import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from millrace import get_session

    shared = tmp_path_factory.mktemp("shared")
    s = get_session("local[4]", "tests", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__checkpoint__dir=f"file://{shared}", spark__sql__warehouse__dir=str(shared / "warehouse"), spark__driver__memory="8g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
