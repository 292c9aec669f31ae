import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tracewright.runtime import session

    s = session("tests", 8)
    s.sparkContext.setLogLevel("ERROR")
    return s


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not Path(SMALL).exists():
        pytest.skip("no test tables here")
    return SMALL
