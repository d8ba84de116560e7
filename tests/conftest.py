import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from terravane.runtime import local_session

    session = local_session(int(os.environ.get("TEST_CPUS", "8")), 8)
    yield session
    session.stop()
