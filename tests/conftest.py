import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from netpulse.session import local_session

    s = local_session("*", shuffle_partitions=8, app="netpulse-tests")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="np-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="np-test-")
