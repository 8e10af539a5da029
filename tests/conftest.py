import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from ledgerlake.session import session

    scratch = tempfile.mkdtemp(prefix="spark-")
    s = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__sql__warehouse__dir=f"{scratch}/warehouse", spark__checkpoint__dir=f"{scratch}/shared", spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    from ledgerlake.shipping import ship

    yield ship(s)
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
