import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quillspan.session import session

    shared = tmp_path_factory.mktemp("shared")
    s = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__checkpoint__dir=str(shared), spark__driver__memory="4g", spark__sql__warehouse__dir=str(shared / "warehouse"))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
