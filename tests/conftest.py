import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = Path(os.environ.get("LACUNA_TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    from lacuna.session import build_session

    s = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    path = DATA / "sf0.001"
    if not path.exists():
        pytest.skip("no test data here")
    return str(path)
