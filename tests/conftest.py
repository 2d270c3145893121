import os
import sys
from pathlib import Path

import pytest

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")  # its threads don't survive the fork that starts the JVM

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import local_session

    s = local_session(4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    from tessera.storage import clear

    clear(s)
    s.stop()
