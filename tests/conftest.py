import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from weftline.runtime import local_session  # noqa: E402

TESTDATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, memory="4g", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    """The smallest of the given inputs."""
    if not TESTDATA.exists():
        pytest.skip("no test data here")
    return str(TESTDATA / "sf0.001")
