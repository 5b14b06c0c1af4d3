import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    import os

    os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
    from quaywise.session import local_session

    return local_session(4, partitions=4)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
